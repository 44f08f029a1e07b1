"""Stratum by stratum, semi-naive: the least model of a stratified program as DataFrames.

A round joins only what the last round added (once for each recursive atom), drops what is known by an
anti join, and writes the rest; a relation is the set of Parquet folders its rounds wrote, so a plan
never grows with the number of rounds and a lost executor costs the current round's task only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import Atom, Rule, RuleError
from ..scratch import write_path
from ..functions.numeric import condition
from . import bodies, demand, strata

Key = tuple[str, str]

#: Rows of a round that are broadcast to the next; rows that a task tells new from known ones at once.
FEW = 10_000
SHARE = 1_000_000


class ResourceExceeded(RuntimeError):
    """A bound on rounds or tuples was met: the answer is unknown, never partial."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


@dataclass
class Limits:
    max_rounds: int = 200
    max_tuples: int | None = None


@dataclass
class Model:
    """Relations by (name, flavor); derived ones also tell the round in which a row came."""

    spark: SparkSession
    facts: dict[Key, DataFrame]
    rules: list[Rule]
    limits: Limits = field(default_factory=Limits)
    paths: dict[Key, list[str]] = field(default_factory=dict)
    schemas: dict[Key, object] = field(default_factory=dict)
    rounds: dict[str, int] = field(default_factory=dict)
    views: dict[Key, DataFrame] = field(default_factory=dict)
    test: object = condition
    #: Where the answers of bound goals are, by relation and bound places.
    answers: dict[tuple[Key, str], Key] = field(default_factory=dict)
    #: Places that are a key of a relation, known from the data.
    keys: dict[Key, tuple[int, ...]] = field(default_factory=dict)
    #: Rows of the folders that rounds wrote.
    counts: dict[str, int] = field(default_factory=dict)
    #: The rows of views before they were made distinct, for what does not mind rows that stand there twice.
    repeated: dict[Key, DataFrame] = field(default_factory=dict)

    def relation(self, key: Key, repeated: bool = False) -> DataFrame | None:
        """Rows of a relation so far: its facts and what was derived; None if there can be none. ``repeated`` allows equal rows."""
        parts = [self.facts[key]] if key in self.facts else []
        if self.paths.get(key):
            read = self.spark.read.schema(self.schemas[key]).parquet(*self.paths[key])
            parts.append(read.drop("round"))
        if key in self.views:
            parts.append(self.repeated.get(key, self.views[key]) if repeated else self.views[key])
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def distinct(self, key: Key) -> DataFrame | None:
        """The relation as a set; what was derived alone is one already."""
        rows = self.relation(key)
        return rows.distinct() if rows is not None and key in self.facts else rows

    def derived(self, key: Key) -> DataFrame | None:
        """Derived rows with the round that made them."""
        if not self.paths.get(key):
            return None
        return self.spark.read.schema(self.schemas[key]).parquet(*self.paths[key])

    def lookup(self, a: Atom, repeated: bool = False) -> DataFrame | None:
        """The relation that holds all matches of an atom."""
        return self.relation(self.answers.get((a.key, demand.pattern(a)), a.key), repeated)


def evaluate(spark: SparkSession, rules: Iterable[Rule], facts: dict[Key, DataFrame], wanted: Iterable[str] | None = None, limits: Limits | None = None, test=condition, goals: Iterable[Atom] = (), keys: dict[Key, tuple[int, ...]] | None = None) -> Model:
    """The model of ``rules`` over ``facts``, restricted to the relations that ``wanted`` depends on.

    Of the relations of ``goals`` only what their constants ask for is derived; ``lookup`` of a goal finds it.
    Without ``wanted``, goals are all that is wanted; without either, everything is.

    ``keys`` are places of facts that are known to be a key of their relation.

    Relations that are not recursive stay lazy plans, joined into what reads them; recursive groups are
    iterated. Raises RuleError for a program that is refused, ResourceExceeded past the limits.
    """
    rules = [r.validate() for r in dict((r.identity(), r) for r in rules).values()]
    order = strata.stratify(rules)
    asked, seeds = None, {}
    if goals := list(goals):
        asked = demand.bound(rules, goals)
        direct = {g.relation for g in goals if (g.key, demand.pattern(g)) not in asked.answers}
        need = strata.demanded(rules, {*(wanted or ()), *direct})
        rules = list(dict((r.identity(), r) for r in (*asked.rules, *(r for r in rules if any(h.relation in need for h in r.heads)))).values())
        order = strata.stratify(rules)
        for key, rows in asked.seeds.items():
            seeds[key] = spark.createDataFrame(sorted(rows, key=str), [f"x{i}" for i in range(1, len(next(iter(rows))) + 1)])
    elif wanted is not None:
        need = strata.demanded(rules, wanted)
        rules = [r for r in rules if any(h.relation in need for h in r.heads)]
    model = Model(spark, dict(facts) | seeds, rules, limits or Limits(), test=test, answers=asked.answers if asked else {}, keys=keys or {})
    graph = strata.edges(rules)
    for group in order:
        inside = set(group)
        own = [r for r in rules if any(h.relation in inside for h in r.heads)]
        if not own:
            continue
        if len(group) > 1 or group[0] in graph.get(group[0], {}):
            _iterate(model, own, inside)
        else:
            _plain(model, own, inside)
    return model


def _plain(model: Model, rules: list[Rule], inside: set[str]) -> None:
    """A relation that does not depend on itself: the union of its rules' plans. Rules that are cases of one are gathered."""
    made: dict[Key, list[DataFrame]] = {}
    sets: set[Key] = set()
    alike: dict[object, list[Rule]] = {}
    for r in rules:
        alike.setdefault(r.identity() if r.invents else r.heads, []).append(r)
    for group in alike.values():
        got = bodies.gathered([r.body for r in group], lambda a: model.lookup(a, repeated=True)) if len(group) > 1 else None
        if got is not None:
            sets |= {h.key for h in group[0].heads if len(rules) == len(group) and len(group[0].heads) == 1 and h.variables() == set(got[1])}
        for r, found in [(group[0], got)] if got is not None else [(r, bodies.conjunction(r.body, model.lookup, test=model.test, keys=model.keys)) for r in group]:
            if found is not None:
                for key, rows in bodies.heads(r, *found).items():
                    if key[0] in inside:
                        made.setdefault(key, []).append(rows)
    for key, parts in made.items():
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        own = [(r, h) for r in rules for h in r.heads if h.key == key]
        model.views[key] = rows if key in sets or len(own) == 1 and _once(model, *own[0]) else rows.distinct()
        model.repeated[key] = rows


def _once(model: Model, r: Rule, head: Atom) -> bool:
    """Whether a rule concludes each row once: its head's variables settle all others by the keys of the relations that it reads."""
    atoms = r.positive()
    if r.invents or not all(a.key in model.keys for a in atoms):
        return False
    return set().union(*(a.variables() for a in atoms)) <= bodies.closed(head.variables(), atoms, model.keys)


def _dealt(model: Model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows in one partition before they are counted: nearly all rows of a relation differ, so that counting before the shuffle only takes memory."""
    number = model.rounds.get("tuples", 0) // SHARE + 1
    enough = number <= int(model.spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(*columns) if enough else rows.repartition(number, *columns)


def _new_rows(model: Model, made: dict[Key, list[DataFrame]], number: int) -> dict[Key, str]:
    """Write, for each relation, the rows of a round that are not known; {} when nothing is new."""
    out = {}
    for key, parts in made.items():
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        known = model.relation(key)
        if known is None:
            rows = _dealt(model, rows, rows.columns).distinct()
        else:  # one aggregation tells new rows from known ones: no join, no sort
            columns = rows.columns
            both = rows.withColumn("known", F.lit(0)).unionByName(known.select(*columns).withColumn("known", F.lit(1)))
            rows = _dealt(model, both, columns).groupBy(*columns).agg(F.max("known").alias("known")).where("known = 0").drop("known")
        rows = rows.withColumn("round", F.lit(number))
        path = write_path(rows, "delta")
        model.schemas.setdefault(key, rows.schema)
        size = model.spark.read.schema(model.schemas[key]).parquet(path).count()  # footers only
        if size:
            out[key] = path
            model.counts[path] = size
        _budget(model, size)
    for key, path in out.items():
        model.paths.setdefault(key, []).append(path)
    return out


def _budget(model: Model, more: int) -> None:
    model.rounds["tuples"] = model.rounds.get("tuples", 0) + more
    if model.limits.max_tuples is not None and model.rounds["tuples"] > model.limits.max_tuples:
        raise ResourceExceeded("memory", f"more than {model.limits.max_tuples} derived tuples")


def _step(model: Model, rules: list[Rule], inside: set[str], delta: dict[Key, str] | None) -> dict[Key, list[DataFrame]]:
    made: dict[Key, list[DataFrame]] = {}
    for r in rules:
        atoms = r.positive()
        leads = [None] if delta is None else [i for i, a in enumerate(atoms) if a.key in delta]
        for lead in leads:
            rows = None if lead is None else model.spark.read.schema(model.schemas[atoms[lead].key]).parquet(delta[atoms[lead].key]).drop("round")
            small = None if lead is None else model.counts.get(delta[atoms[lead].key], FEW + 1) <= FEW
            got = bodies.conjunction(r.body, model.lookup, lead, rows, model.test, small=small)
            if got is not None:
                for key, found in bodies.heads(r, *got).items():
                    if key[0] in inside:
                        made.setdefault(key, []).append(found)
    return made


def _iterate(model: Model, rules: list[Rule], inside: set[str], start: dict[Key, str] | None = None) -> None:
    """Rounds of a recursive group until one adds nothing."""
    if any(r.invents for r in rules):
        raise RuleError(f"a rule that invents terms is recursive: {sorted(inside)}")
    delta = _new_rows(model, _step(model, rules, inside, start), 1)
    number = 1
    while delta:
        number += 1
        if number > model.limits.max_rounds:
            raise ResourceExceeded("depth", f"more than {model.limits.max_rounds} rounds for {sorted(inside)}")
        delta = _new_rows(model, _step(model, rules, inside, delta), number)
    model.rounds[",".join(sorted(inside))] = number


def resume(model: Model, key: Key, rows: DataFrame) -> Model:
    """The model after facts were added to one relation, by what they lead to; the old model stays as it was.

    Refused (RuleError) where some rule's negation reads a relation that the new rows can reach: then
    conclusions may go, and only evaluating again is right.
    """
    graph = strata.edges(model.rules)
    reached = {key[0]}
    while True:
        more = {h for h, out in graph.items() if h not in reached and any(b in reached for b in out)}
        if not more:
            break
        reached |= more
    for r in model.rules:
        for n in r.negative():
            if n.atom.relation in reached:
                raise RuleError(f"{n.atom.relation} is negated in {r} and can grow: evaluate again")
    old = model.relation(key)
    if old is not None:
        on = F.lit(True)
        for c in rows.columns:
            on &= F.col(c) == F.col(f"k_{c}")
        rows = rows.distinct().join(old.select(*[F.col(c).alias(f"k_{c}") for c in rows.columns]), on, "left_anti")
    path = write_path(rows.withColumn("round", F.lit(0)), "delta")
    added = model.spark.read.parquet(path)
    facts = dict(model.facts)
    facts[key] = facts[key].unionByName(added.drop("round")) if key in facts else added.drop("round")
    new = Model(model.spark, facts, model.rules, model.limits, {k: list(v) for k, v in model.paths.items()}, dict(model.schemas), dict(model.rounds), test=model.test, keys={k: v for k, v in model.keys.items() if k != key})
    new.schemas[key] = added.schema
    for group in strata.stratify(model.rules):
        inside = set(group)
        own = [r for r in model.rules if any(h.relation in inside for h in r.heads)]
        if not own:
            continue
        if len(group) > 1 or group[0] in graph.get(group[0], {}):
            grown = ({b for h in inside for b in graph.get(h, {})} - inside) & reached
            if not grown:
                continue
            start = {key: path} if grown == {key[0]} else None
            _iterate(new, own, inside, start)
        else:
            _plain(new, own, inside)
    return new
