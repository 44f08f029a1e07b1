"""Syntax trees of claims and terms."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Det:
    """some, every, the, no or exactly (with ``n``); ``definite`` for "every the" and "exactly n the"."""

    kind: str
    n: int = 0
    definite: bool = False


@dataclass(frozen=True)
class Restrictor:
    units: tuple
    args: tuple = ()
    selector: str = ""
    negated: bool = False
    clauses: tuple = ()  # (("where" | "also"), claim or bare (negated, units))


@dataclass(frozen=True)
class Term:
    """kind: name, number, string, var, any, none, key, abstraction, det."""

    kind: str
    value: object = None
    det: Det | None = None
    restrictor: Restrictor | None = None
    clauses: tuple = ()


@dataclass(frozen=True)
class Pred:
    """``units``: predicate names, or tuples of them for bracketed groups; the last is the head."""

    units: tuple
    args: tuple  # of (label or "", Term)
    tags: tuple = ()  # of (predicate, Term)


@dataclass(frozen=True)
class Equal:
    left: Term
    right: Term


@dataclass(frozen=True)
class Op:
    """op: ->, <->, ^, |, &, ~, or a flavor."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Prenex:
    variables: tuple
    body: object


@dataclass(frozen=True)
class Block:
    det: Det
    restrictor: Restrictor
    variable: str
    body: object
