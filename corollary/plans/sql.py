"""Rule programs as SQL text: an independent reading of the same program for a relational database.

Each derived relation is a common table expression, in the order of the strata; a relation that refers to
itself once in a rule is a recursive one. Mutual and non-linear recursion, invented terms and computed
predicates of a backend have no such text and are refused.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.numeric import TOLERANCE
from ..ir import ARITHMETIC, COMPARISONS, Atom, Check, Const, Not, Rule, RuleError, Var
from . import strata

Key = tuple[str, str]


def literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def quoted(key: Key) -> str:
    return '"' + f"{key[0]} {key[1]}".replace('"', '""') + '"'


def _columns(n: int) -> str:
    return ", ".join(f"x{i}" for i in range(1, n + 1))


def _matched(a: Atom, mark: str, names: dict[str, str]) -> list[str]:
    """Conditions that tie an atom's columns to constants and to what is known; new variables are added to ``names``."""
    out = []
    for i, t in enumerate(a.args, 1):
        cell = f"{mark}.x{i}"
        if isinstance(t, Const):
            out.append(f"{cell} = {literal(t.value)}")
        elif t.name in names:
            out.append(f"{cell} = {names[t.name]}")
        else:
            names[t.name] = cell
    return out


def _condition(c: Check, names: dict[str, str]) -> str:
    x, *rest = [names[t.name] if isinstance(t, Var) else literal(t.value) for t in c.args]
    if c.op == "equal":
        test = f"{x} = {rest[0]}"
    elif c.op in COMPARISONS:
        test = f"{x} {dict(greater='>', less='<', num_equal='=')[c.op]} {rest[0]}"
    elif c.op in ARITHMETIC:
        a, b = (f"CAST({r} AS DOUBLE)" for r in rest)
        value = {"product": f"({a} * {b})", "sum": f"({a} + {b})", "quotient": f"({a} / NULLIF({b}, 0))"}[c.op]
        test = f"COALESCE(ABS({x} - {value}) <= {TOLERANCE!r} * GREATEST(ABS({x}), ABS({value})), FALSE)"
    else:
        raise RuleError(f"{c.op} has no SQL")
    return f"NOT ({test})" if c.negated else f"({test})"


def body_sql(r: Rule, head: Atom, known: set[Key]) -> str | None:
    """SELECT of a rule's conclusions; None if it needs a relation that is empty."""
    if r.invents:
        raise RuleError(f"{r} invents terms")
    names: dict[str, str] = {}
    tables, tests = [], []
    for i, a in enumerate(r.positive()):
        if a.key not in known:
            return None
        tables.append(f"{quoted(a.key)} AS t{i}")
        tests += _matched(a, f"t{i}", names)
    tests += [_condition(c, names) for c in r.checks()]
    for i, n in enumerate(r.negative()):
        if n.atom.key in known:
            inner = _matched(n.atom, f"n{i}", dict(names))
            tests.append(f"NOT EXISTS (SELECT 1 FROM {quoted(n.atom.key)} AS n{i}" + (f" WHERE {' AND '.join(inner)}" if inner else "") + ")")
    cells = ", ".join(f"{names[t.name] if isinstance(t, Var) else literal(t.value)} AS x{i}" for i, t in enumerate(head.args, 1))
    return f"SELECT {cells} FROM {', '.join(tables)}" + (f" WHERE {' AND '.join(tests)}" if tests else "")


def program_sql(rules: Iterable[Rule], tables: dict[Key, str], goal: Atom) -> str:
    """One query with the rows of ``goal``'s relation that match it, a column for each of its variables.

    ``tables`` has, for each relation with facts, a SELECT of its columns x1..xN.
    """
    rules = [r.validate() for r in rules]
    need = strata.demanded(rules, [goal.relation])
    graph = strata.edges(rules)
    parts, known = [], set(tables)
    given = {key: sql for key, sql in tables.items() if key[0] in need}
    derived = {h.key for r in rules for h in r.heads}
    for key, sql in given.items():
        if key not in derived:
            parts.append(f"{quoted(key)} AS ({sql})")
    for group in strata.stratify(rules):
        if len(group) > 1:
            raise RuleError(f"{sorted(group)} refer to each other: no SQL")
        name = group[0]
        if name not in need:
            continue
        own = sorted(k for k in derived if k[0] == name)
        turning = name in graph.get(name, {})
        if turning and len(own) > 1:
            raise RuleError(f"{name} of several flavors refers to itself: no SQL")
        for key in own:
            base, steps = [tables[key]] if key in tables else [], []
            for r in rules:
                for head in (h for h in r.heads if h.key == key):
                    uses = sum(a.key == key for a in r.positive())
                    if uses > 1:
                        raise RuleError(f"{r} refers to itself twice: no SQL")
                    made = body_sql(r, head, known | ({key} if uses else set()))
                    if made is not None:
                        (steps if uses else base).append(made)
            if not base:
                continue
            first = " UNION ".join(f"SELECT * FROM ({b}) AS b{i}" for i, b in enumerate(base))
            again = " UNION ALL ".join(f"SELECT * FROM ({b}) AS s{i}" for i, b in enumerate(steps))
            parts.append(f"{quoted(key)} AS (SELECT * FROM ({first}) AS base{f' UNION SELECT * FROM ({again}) AS step' if again else ''})")
            known.add(key)
    names: dict[str, str] = {}
    tests = _matched(goal, "g", names)
    shown = ", ".join(f"{c} AS {v}" for v, c in names.items()) or "1 AS found"
    if goal.key not in known:
        return f"SELECT {', '.join(f'NULL AS {v}' for v in names) or '1 AS found'} WHERE FALSE"
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + f"SELECT DISTINCT {shown} FROM {quoted(goal.key)} AS g" + (f" WHERE {' AND '.join(tests)}" if tests else "")
