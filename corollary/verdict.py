"""Answers with four values, and how connectives combine them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Verdict:
    """TRUE, FALSE, UNKNOWN (with a reason) or RESOURCE_EXCEEDED (with the bound that was met)."""

    value: str
    reason: str = ""

    def __str__(self) -> str:
        return self.value + (f" ({self.reason})" if self.reason else "")

    def __bool__(self) -> bool:
        return self.value == "TRUE"

    @property
    def definite(self) -> bool:
        return self.value in ("TRUE", "FALSE")


TRUE, FALSE = Verdict("TRUE"), Verdict("FALSE")
REASONS = ("non-finite", "backend-unavailable", "naf-dependent", "incomplete", "cycle-cut")
RESOURCES = ("depth", "memory", "cancelled")


def unknown(reason: str) -> Verdict:
    return Verdict("UNKNOWN", reason)


def exceeded(kind: str) -> Verdict:
    return Verdict("RESOURCE_EXCEEDED", kind)


def of(found: bool | None, reason: str = "non-finite") -> Verdict:
    return unknown(reason) if found is None else TRUE if found else FALSE


def _weaker(a: Verdict, b: Verdict) -> Verdict:
    """Of two verdicts that are not definite the stronger warning: a resource bound, else the left one."""
    return next((v for v in (a, b) if v.value == "RESOURCE_EXCEEDED"), a if not a.definite else b)


def both(a: Verdict, b: Verdict) -> Verdict:
    if FALSE in (a, b):
        return FALSE
    return TRUE if a == b == TRUE else _weaker(a, b)


def either(a: Verdict, b: Verdict) -> Verdict:
    if TRUE in (a, b):
        return TRUE
    return FALSE if a == b == FALSE else _weaker(a, b)


def negated(a: Verdict) -> Verdict:
    if a.value == "UNKNOWN":
        return unknown("naf-dependent")
    return FALSE if a == TRUE else TRUE if a == FALSE else a
