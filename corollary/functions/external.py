"""Computed predicates: a registry of Python backends, used as vectorised columns and for plain values.

A backend answers true, false or None (unavailable) for one tuple of plain operands, or takes a batch.
"""

from __future__ import annotations

import json
import socket
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms
from ..ir import RuleError

Batch = Callable[[list[tuple]], list[bool | None]]


@dataclass
class Registry:
    known: dict[str, Batch] = field(default_factory=dict)
    #: Names that have facts or rules; a knowledge base fills this in.
    taken: Callable[[], set[str]] = set

    def register(self, name: str, one: Callable[..., bool | None] | None = None, batch: Batch | None = None, used: set[str] = frozenset()) -> None:
        """Dispatch ``name`` to a backend. Refused where facts or rules of that name exist already."""
        if name in used or name in self.taken():
            raise RuleError(f"{name} has facts and cannot be computed")
        if (one is None) == (batch is None):
            raise RuleError("one backend function wanted")
        self.known[name] = batch or (lambda rows, f=one: [f(*r) for r in rows])

    def decide(self, name: str, operands: list[object]) -> bool | None:
        return self.known[name]([tuple(operands)])[0]

    def column(self, name: str) -> Callable[..., Column]:
        """A nullable boolean column of tagged operands, computed in Arrow batches over distinct tuples."""
        backend = self.known[name]

        def run(*args: pd.Series) -> pd.Series:
            rows = list(zip(*(a.tolist() for a in args)))
            distinct = list(dict.fromkeys(rows))
            found = dict(zip(distinct, backend([tuple(map(terms.decode, r)) for r in distinct])))
            return pd.Series([found[r] for r in rows], dtype="boolean")

        def made(*args: Column) -> Column:
            marks = [pd.Series] * len(args)
            names = ", ".join(f"a{i}: S" for i in range(len(marks)))
            scope = {"S": pd.Series, "run": run}
            exec(f"def f({names}) -> S:\n    return run({', '.join(f'a{i}' for i in range(len(marks)))})", scope)  # noqa: S102
            return F.pandas_udf(scope["f"], "boolean")(*args)

        return made


def line_backend(host: str, port: int, relation: str, timeout: float = 5.0) -> Batch:
    """A backend behind a TCP port: one JSON request and one JSON answer per line. Any fault is "unavailable"."""

    def ask(rows: list[tuple]) -> list[bool | None]:
        out: list[bool | None] = []
        try:
            with socket.create_connection((host, port), timeout) as link, link.makefile("rw", encoding="utf-8") as lines:
                for row in rows:
                    args = [{"type": "number" if isinstance(v, float) else "constant", "value": v} for v in row]
                    lines.write(json.dumps({"relation": relation, "args": args}) + "\n")
                    lines.flush()
                    answer = json.loads(lines.readline() or "{}").get("result")
                    out.append(answer if isinstance(answer, bool) else None)
        except (OSError, ValueError):
            pass
        return out + [None] * (len(rows) - len(out))

    return ask
