"""Integrity: conjunctions that must not hold, and disjunctions that must have a case left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Atom, Literal, RuleError
from ..plans import bodies


@dataclass(frozen=True)
class Constraint:
    """``body`` must have no binding; with ``cases``, no binding for which every case is denied."""

    label: str
    body: tuple[Literal, ...]
    cases: tuple[Atom, ...] = ()


def violations(constraint: Constraint, lookup, denied=None) -> DataFrame | None:
    """(kind, label, detail) of each binding that violates the constraint; None where nothing can.

    ``denied`` looks up explicit negative facts: a disjunction is violated where the body holds and each
    case is denied. Absence is no denial.
    """
    got = bodies.conjunction(constraint.body, lookup)
    if got is None:
        return None
    rows, names = got
    for case in constraint.cases:
        source = denied(case) if denied else None
        if source is None:
            return None
        part, own = bodies.scan(case, source)
        if set(own) - set(names):
            raise RuleError(f"{case} has variables that the constraint does not bind")
        on = F.lit(True)
        for v, c in own.items():
            on &= F.col(names[v]) == F.col(c)
        rows = rows.join(part, on, "left_semi")
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{v}="), F.col(c).cast("string")) for v, c in sorted(names.items())])
    kind = "disjunction" if constraint.cases else "integrity"
    return rows.select(F.lit(kind).alias("kind"), F.lit(constraint.label).alias("label"), shown.alias("detail")).distinct()
