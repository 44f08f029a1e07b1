"""Numeric built-ins: exact comparisons and tolerant arithmetic, as columns and as plain values.

Verdicts have three values. A comparison or an arithmetic check is undecided on operands that are not
finite (and, for arithmetic, on results that are not); a quotient by zero of finite operands is false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ir import COMPARISONS, EXTERNAL, Check, Const, Var

TOLERANCE = 1e-9


def finite(c: Column) -> Column:
    value = c.cast("double")
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(TOLERANCE) * F.greatest(F.abs(a), F.abs(b))


def compared(op: str, a: Column, b: Column) -> Column:
    """True, false, or null where an operand is not finite."""
    test = {"greater": a > b, "less": a < b, "num_equal": a == b}[op]
    return F.when(finite(a) & finite(b), test)


def computed(op: str, x: Column, a: Column, b: Column) -> Column:
    """Whether x = a op b within TOLERANCE; null where undecided."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    known = finite(x) & finite(a) & finite(b)
    if op == "quotient":
        value = F.try_divide(a, b)
        return F.when(known & (b == 0), F.lit(False)).when(known & finite(value), close(x, value))
    value = a * b if op == "product" else a + b
    return F.when(known & finite(value), close(x, value))


def powered(op: str, x: Column, a: Column, b: Column) -> Column:
    """Whether x is a to the power b, or the logarithm of a to the base b; null where undecided."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    value = F.pow(a, b) if op == "exponential" else F.log(a) / F.log(b)
    return F.when(finite(x) & finite(a) & finite(b) & finite(value), close(x, value))


def condition(c: Check, names: dict[str, str], read=None, external=None) -> Column:
    """The filter of a built-in condition over bound columns. Undecided rows are no answers either way.

    ``read`` turns an operand's column into a number; ``external`` maps names to column functions of a backend.
    """
    args = [F.col(names[t.name]) if isinstance(t, Var) else F.lit(t.value) for t in c.args]
    if c.op == "equal":
        test = args[0] == args[1]
    elif external and c.op in external:
        test = external[c.op](*args)
    else:
        args = [read(a) for a in args] if read else args
        if c.op in COMPARISONS:
            test = compared(c.op, *args)
        else:
            test = powered(c.op, *args) if c.op in EXTERNAL else computed(c.op, *args)
    return ~test if c.negated else test


def decide(op: str, values: list[object]) -> bool | None:
    """The same for plain numbers; None is undecided. Operands that are no numbers have no built-in meaning."""
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in values):
        raise TypeError(f"{op} needs numbers")
    numbers = [float(v) for v in values]
    if not all(map(math.isfinite, numbers)):
        return None
    if op in COMPARISONS:
        a, b = numbers
        return a > b if op == "greater" else a < b if op == "less" else a == b
    x, a, b = numbers
    if op == "quotient":
        if b == 0:
            return False
        value = a / b
    elif op in ("product", "sum"):
        value = a * b if op == "product" else a + b
    else:
        try:
            value = a**b if op == "exponential" else math.log(a, b)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None
    if isinstance(value, complex) or not math.isfinite(value):
        return None
    return abs(x - value) <= TOLERANCE * max(abs(x), abs(value))


def constant_check(c: Check) -> bool | None:
    """The value of a condition without variables, or None."""
    if all(isinstance(t, Const) for t in c.args):
        got = c.args[0].value == c.args[1].value if c.op == "equal" else decide(c.op, [t.value for t in c.args])
        return None if got is None else got != c.negated
    return None
