"""A stream of facts into an evaluated program: each micro-batch is folded in as a delta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..ir import RuleError
from ..plans import fixpoint
from ..scratch import write_once


class Feed:
    """Keeps a model up to date with one growing relation.

    A batch that only adds conclusions is resumed from; where a negation reads what grows, conclusions
    may have to go, and the program is evaluated again. A question asked between batches is answered from
    exactly the facts of the batches before it. Batches are sets of facts: a batch that is replayed
    after a failure changes nothing.
    """

    def __init__(self, model: fixpoint.Model, relation: str, flavor: str = "bare", wanted: list[str] | None = None):
        self.model, self.key, self.wanted = model, (relation, flavor), wanted
        self.resumed = self.recomputed = 0

    def add(self, rows: DataFrame, batch_id: int = 0) -> None:
        if rows.isEmpty():
            return
        try:
            self.model = fixpoint.resume(self.model, self.key, rows)
            self.resumed += 1
        except RuleError:
            facts = dict(self.model.facts)
            kept = write_once(rows.distinct(), "batch")
            facts[self.key] = facts[self.key].unionByName(kept).distinct() if self.key in facts else kept
            self.model = fixpoint.evaluate(rows.sparkSession, self.model.rules, facts, self.wanted, self.model.limits, self.model.test)
            self.recomputed += 1

    def attach(self, stream: DataFrame, checkpoint: str, places: Callable[[DataFrame], DataFrame] = lambda df: df, **trigger) -> StreamingQuery:
        """Start folding a stream in; ``places`` projects its rows to x1..xN."""
        return stream.writeStream.foreachBatch(lambda df, n: self.add(places(df), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
