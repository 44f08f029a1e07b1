"""Rule bodies as DataFrame plans: joins for atoms, filters for conditions, anti joins for negation.

Relations are DataFrames with columns x1..xN, sets of rows without nulls. Each use of a relation is
projected to columns of its own, so that a relation can meet itself and its own earlier versions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import condition
from ..ir import Atom, Check, Const, Literal, Not, Rule, RuleError, Term, Var

_fresh = itertools.count()

#: Rows of one value that meet in one task, where a value may have many rows on both sides of a join; pairs for each task.
BLOCK = 1000
PAIRS = 20_000_000

#: Rows that one task gathers by their values.
GATHERED = 1_000_000

Lookup = Callable[[Atom], DataFrame | None]


def column(t: Term, names: dict[str, str]) -> Column:
    return F.col(names[t.name]) if isinstance(t, Var) else F.lit(t.value)


def scan(a: Atom, relation: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The atom's matches: one uniquely named column for each variable. Constants and repeats become filters."""
    mark = f"a{next(_fresh)}"
    if len(a.args) != len([c for c in relation.columns if c.startswith("x")]):
        raise RuleError(f"{a.relation} has {len(relation.columns)} places, not {len(a.args)}")
    names: dict[str, str] = {}
    shown, kept = [], None
    for i, t in enumerate(a.args, 1):
        here = F.col(f"x{i}")
        if isinstance(t, Const):
            test = here == F.lit(t.value)
        elif t.name in names:
            test = here == F.col(f"x{[j for j, u in enumerate(a.args, 1) if u == t][0]}")
        else:
            names[t.name] = f"{mark}_{i}"
            shown.append(here.alias(names[t.name]))
            continue
        kept = test if kept is None else kept & test
    rows = relation if kept is None else relation.where(kept)
    return rows.select(*shown) if shown else rows.select(F.lit(1).alias(f"{mark}_0")).limit(1), names


def ordered(atoms: list[Atom], first: int | None = None) -> list[Atom]:
    """Atoms so that each, where it can, shares a variable with those before it. ``first`` leads."""
    rest = list(atoms)
    out = [rest.pop(first if first is not None else max(range(len(rest)), key=lambda i: (sum(isinstance(t, Const) for t in rest[i].args), -i)))]
    known = set(out[0].variables())
    while rest:
        best = max(range(len(rest)), key=lambda i: (len(rest[i].variables() & known), -i))
        out.append(rest.pop(best))
        known |= out[-1].variables()
    return out


def closed(known: set[str], atoms: list[Atom], keys: dict) -> set[str]:
    """The variables that have one value once ``known`` have theirs, by the keys of the atoms' relations."""
    known = set(known)
    while True:
        more = {v for a in atoms if all(isinstance(a.args[i - 1], Const) or a.args[i - 1].name in known for i in keys[a.key]) for v in a.variables()}
        if more <= known:
            return known
        known |= more


def clusters(atoms: list[Atom], keys: dict) -> list[list[Atom]]:
    """Atoms in groups: inside a group each join finds one row at the most for each row of one side, so none multiplies rows."""
    groups = [[a] for a in atoms]
    variables = lambda g: set().union(*(a.variables() for a in g))
    while True:
        for g, h in itertools.combinations(groups, 2):
            shared = variables(g) & variables(h)
            if shared and any(variables(x) <= closed(shared, x, keys) for x in (g, h)):
                groups = [x for x in groups if x is not g and x is not h] + [g + h]
                break
        else:
            return groups


def dealt(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The equi-join of sides that may both have many rows of one value: its rows meet as pairs of blocks of BLOCK rows.

    A task holds one block at a time, and takes PAIRS pairs or so. Counting the rows of each value is a job of its own.
    """
    mark = f"d{next(_fresh)}"
    count = lambda rows, columns, n: rows.groupBy(*(F.col(c).alias(f"{n}_{i}") for i, c in enumerate(columns))).agg(F.count(F.lit(1)).alias(n))
    lefts, rights = [l for l, _ in on], [r for _, r in on]
    a, b = count(left, lefts, f"{mark}a"), count(right, rights, f"{mark}b")
    same = F.lit(True)
    for i in range(len(on)):
        same &= F.col(f"{mark}a_{i}") == F.col(f"{mark}b_{i}")
    met = a.join(b, same)
    pairs = met.agg(F.sum(F.col(f"{mark}a").cast("double") * F.col(f"{mark}b"))).first()[0] or 0
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = met.select(*(F.col(f"{mark}a_{i}").alias(f"{mark}v_{i}") for i in range(len(on))), blocks(f"{mark}a").alias(f"{mark}m"), blocks(f"{mark}b").alias(f"{mark}n"))
    number = int(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS)))

    def blocked(rows: DataFrame, columns: list[str], own: str, other: str, side: str) -> DataFrame:
        known = F.lit(True)
        for i, c in enumerate(columns):
            known &= F.col(c) == F.col(f"{mark}v_{i}")
        cells = {own: F.pmod(F.xxhash64(*rows.columns), F.col(f"{mark}{own}")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{mark}{other}") - 1))}
        out = rows.join(sizes, known).select(*rows.columns, *(cells[x].alias(f"{side}{x}") for x in (own, other)))
        return out.repartition(number, *columns, f"{side}m", f"{side}n")

    left = blocked(left, lefts, "m", "n", f"{mark}l")
    right = blocked(right, rights, "n", "m", f"{mark}r")
    test = F.lit(True)
    for l, r in [*on, (f"{mark}lm", f"{mark}rm"), (f"{mark}ln", f"{mark}rn")]:
        test &= F.col(l) == F.col(r)
    return left.join(right.hint("merge"), test).drop(*(f"{mark}{s}{x}" for s in "lr" for x in "mn"), *rights)


def _multiplied(groups: list[list[Atom]], checks: list[Check], lookup: Lookup, test) -> tuple[DataFrame, dict[str, str]] | None:
    """Bindings of groups of atoms, each joined by itself first, then with one another in blocks."""
    rows, names = None, {}
    for group in groups:
        inside = [c for c in checks if c.variables() <= set().union(*(a.variables() for a in group))]
        got = conjunction((*group, *inside), lookup, test=test)
        if got is None:
            return None
        part, own = got
        if rows is None:
            rows, names = part, own
        else:
            shared = [v for v in own if v in names]
            rows = dealt(rows, part, [(names[v], own[v]) for v in shared]) if shared else rows.crossJoin(part)
            names = names | {v: c for v, c in own.items() if v not in names}
        checks = [c for c in checks if c not in inside]
        for c in [c for c in checks if c.variables() <= set(names)]:
            rows = rows.where(test(c, names))
            checks.remove(c)
    if checks:
        raise RuleError(f"unbound variables in {checks[0]}")
    return rows, names


def conjunction(literals: tuple[Literal, ...], lookup: Lookup, lead: int | None = None, lead_rows: DataFrame | None = None, test=condition, keys: dict | None = None, small: bool | None = None) -> tuple[DataFrame, dict[str, str]] | None:
    """(bindings, variable -> column) of a conjunction; None where a relation that it needs is empty.

    ``lead`` is the positive atom (by number) that reads ``lead_rows`` in place of its relation: the
    delta of a semi-naive round. Shared variables make equi-joins, none a cross join; conditions are
    applied as soon as their variables are bound; negated atoms last, as anti joins on the variables
    that they share with the rest. ``keys`` names places that are a key of a relation, which is a set then:
    joins that multiply rows come last, and in blocks. ``small`` tells of a round whether its delta is known to be
    small: it alone is broadcast then, in any other round nothing is, since each round would send it anew.
    """
    atoms = [x for x in literals if isinstance(x, Atom)]
    checks = [x for x in literals if isinstance(x, Check)]
    rows: DataFrame | None = None
    names: dict[str, str] = {}
    numbered = {id(a): i for i, a in enumerate(atoms)}
    groups = clusters(atoms, keys) if keys and lead is None and all(a.key in keys for a in atoms) else []
    if len(groups) > 1:
        got = _multiplied(groups, checks, lookup, test)
        if got is None:
            return None
        rows, names = got
        atoms, checks = [], []
    for a in ordered(atoms, lead) if atoms else []:
        source = lead_rows if numbered[id(a)] == lead and lead_rows is not None else lookup(a)
        if source is None:
            return None
        part, own = scan(a, source)
        if rows is None:
            rows, names = part, own
        else:
            shared = [v for v in own if v in names]
            if shared:
                on = F.lit(True)
                for v in shared:
                    on &= F.col(names[v]) == F.col(own[v])
                if small is not None:
                    rows, part = (F.broadcast(rows), part) if small else (rows, part.hint("merge"))
                    small = False
                rows = rows.join(part, on, "inner").drop(*[own[v] for v in shared])
            else:
                rows = rows.crossJoin(part)
            names |= {v: c for v, c in own.items() if v not in names}
        ready = [c for c in checks if c.variables() <= set(names)]
        for c in ready:
            rows = rows.where(test(c, names))
            checks.remove(c)
    if rows is None:
        raise RuleError("a body without a positive atom has no plan")
    if checks:
        raise RuleError(f"unbound variables in {checks[0]}")
    for n in (x for x in literals if isinstance(x, Not)):
        source = lookup(n.atom)
        if source is None:
            continue
        part, own = scan(n.atom, source)
        on = F.lit(True)
        for v in own:
            if v in names:
                on &= F.col(names[v]) == F.col(own[v])
        rows = rows.join(part.distinct() if not own else part, on, "left_anti")
    return rows, names


def rows_read(df: DataFrame) -> int:
    """Rows of the Parquet files behind a plan, from their footers; 0 where it reads none. Projections, filters and sets of them have no more rows."""
    files = [f for f in df.inputFiles() if f.endswith(".parquet")]
    return df.sparkSession.read.schema("none int").option("recursiveFileLookup", "true").parquet(*files).count() if files else 0


def gathered(cases: list[tuple[Literal, ...]], lookup: Lookup) -> tuple[DataFrame, dict[str, str]] | None:
    """Bindings that satisfy one or more of several conjunctions, each once; None unless all their literals are atoms over the same variables.

    Each relation is read once, for all cases, and may hold a row several times. Rows of one binding meet in one aggregation, which tells the relations
    that have it, without joins or sorts. It is dealt by the number of rows: AQE would merge partitions by their bytes, which say little of packed keys.
    """
    literals = [x for c in cases for x in c]
    if not all(isinstance(x, (Atom, Not)) for x in literals):
        return None
    variables = sorted(literals[0].variables())
    if not variables or any(x.variables() != set(variables) for x in literals):
        return None
    sources: dict[Atom, DataFrame] = {}
    for a in dict.fromkeys(x.atom if isinstance(x, Not) else x for x in literals):
        found = lookup(a)
        if found is not None:
            sources[a] = found
    cases = [c for c in cases if all(x in sources for x in c if isinstance(x, Atom))]
    used = list(dict.fromkeys(a for c in cases for x in c for a in [x.atom if isinstance(x, Not) else x] if a in sources))
    if len(cases) < 2 or len(used) > 62 or not all(any(isinstance(x, Atom) for x in c) for c in cases):
        return None
    mark = f"g{next(_fresh)}"
    names = {v: f"{mark}_{i}" for i, v in enumerate(variables)}
    columns = list(names.values())
    rows, number = None, 0
    for i, a in enumerate(used):
        part, own = scan(a, sources[a])
        part = part.select(*(F.col(own[v]).alias(names[v]) for v in variables), F.lit(1 << i).cast("bigint").alias(mark))
        if rows is not None and part.dtypes != rows.dtypes:
            return None
        number += rows_read(sources[a])
        rows = part if rows is None else rows.unionByName(part)
    number = number // GATHERED + 1
    enough = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(*columns) if number == 1 else rows.repartition(max(number, min(4 * number, enough)), *columns)
    test = F.lit(False)
    for c in cases:
        has = sum(1 << used.index(x) for x in dict.fromkeys(c) if isinstance(x, Atom))
        lacks = sum(1 << used.index(a) for a in dict.fromkeys(x.atom for x in c if isinstance(x, Not)) if a in used)
        if not has & lacks:
            test |= F.col(mark).bitwiseAND(F.lit(has | lacks).cast("bigint")) == has
    return rows.groupBy(*columns).agg(F.bit_or(mark).alias(mark)).where(test).drop(mark), names


def heads(r: Rule, rows: DataFrame, names: dict[str, str]) -> dict[tuple[str, str], DataFrame]:
    """Rows that the rule concludes, by (relation, flavor). Invented terms are hashes of what they depend on."""
    out: dict[tuple[str, str], DataFrame] = {}
    invented = {v: F.concat(F.lit(f"k:{v}:"), F.sha2(F.concat_ws("\x1f", F.lit(r.identity()), *[F.col(c).cast("string") for _, c in sorted(names.items())]), 256)) for v in r.invents}
    for head in r.heads:
        cells = [(invented[t.name] if isinstance(t, Var) and t.name in invented else column(t, names)).alias(f"x{i}") for i, t in enumerate(head.args, 1)]
        made = rows.select(*cells)
        out[head.key] = out[head.key].unionByName(made) if head.key in out else made
    return out
