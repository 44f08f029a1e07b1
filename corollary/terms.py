"""Tagged terms of text knowledge bases: one flat string for each place, never null.

Tags: ``c:`` name or quoted string, ``d:`` definite description, ``n:`` number, ``u:`` unspecified,
``a:`` reified proposition, ``k:`` generated witness. Two terms are equal if their strings are.

A number has one spelling, whether it comes from text, from Python or from a table: all digits of a whole
number, and ".0"; else the shortest decimal that reads back as the same double, with an exponent below 0.001.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSPECIFIED = "u:"


def name(text: str) -> str:
    """A rigid name: case and underscores do not count."""
    return "c:" + text.lower().replace("_", " ")


def text(value: str) -> str:
    return "c:" + value


def number(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError(f"{value} is no term")
    if isinstance(value, int) or value.is_integer() and abs(value) < 1 << 63:
        return f"n:{int(value)}.0"
    digits, exponent = f"{Decimal(repr(value)):e}".lower().split("e")
    if 1e-3 <= abs(value) < 1e7:
        return f"n:{value!r}"
    whole, _, rest = digits.partition(".")
    return f"n:{whole}.{rest.rstrip('0') or '0'}E{int(exponent)}"


def numbers(c: Column, kind: str) -> Column:
    """The terms of a numeric column of a table: number() for columns. Whole numbers never pass through a double.

    Decimals with more than 15 digits and a fraction are read as doubles. NaN and infinities are terms that no comparison decides.
    """
    whole = lambda x: F.concat(F.lit("n:"), x.cast("string"), F.lit(".0"))
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.endswith(",0)"):
        return whole(c)
    real = c.cast("double")
    fits = (F.abs(real) < F.lit(float(1 << 63))) & (real == F.floor(real))
    if kind.startswith("decimal"):
        return F.when(c == F.floor(c), whole(F.floor(c))).otherwise(F.concat(F.lit("n:"), real.cast("string")))
    if kind == "float":  # its own digits, not those of the double of the same value
        real = c.cast("string").cast("double")
    return F.when(fits, whole(real.cast("bigint"))).otherwise(F.concat(F.lit("n:"), real.cast("string")))


def description(predicate: str) -> str:
    return "d:" + predicate


def encode(value: object) -> str:
    """The term of a plain Python value; tagged strings are made by the functions above."""
    if isinstance(value, bool):
        return text(str(value).lower())
    return number(value) if isinstance(value, (int, float)) else UNSPECIFIED if value is None else text(str(value))


def decode(term: str) -> object:
    tag, body = term[:2], term[2:]
    if tag == "n:":
        whole = body.endswith(".0") and len(body) > 17  # beyond what a double holds
        return int(body[:-2]) if whole else float(body)
    return None if tag == "u:" else f"the {body}" if tag == "d:" else body if tag == "c:" else term


def as_number(c: Column) -> Column:
    """The number of a tagged column, null for other terms."""
    return F.when(c.startswith("n:"), F.substring(c, 3, 64).try_cast("double"))
