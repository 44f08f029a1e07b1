"""Declared predicates: names, places, and converted aliases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .ir import RuleError


@dataclass(frozen=True)
class Predicate:
    name: str
    places: tuple[str, ...]


@dataclass
class Vocabulary:
    """Closed unless ``open``: an unknown predicate, a place too many or an unknown label is an error.

    An open vocabulary takes the arity of a predicate from its first use.
    """

    open: bool = False
    known: dict[str, Predicate] = field(default_factory=dict)
    aliases: dict[str, tuple[str, int]] = field(default_factory=dict)

    def declare(self, text: str) -> Vocabulary:
        """``name(place, place, ...)``, several separated by semicolons."""
        for part in filter(None, map(str.strip, text.split(";"))):
            m = re.fullmatch(r"([a-z][a-z0-9_]*(?:\+[a-z][a-z0-9_]*)*)\s*\(\s*([a-z0-9_,\s]*)\)", part)
            if not m:
                raise RuleError(f"not a declaration: {part}")
            places = tuple(p.strip() for p in m[2].split(",") if p.strip())
            old = self.known.get(m[1])
            if old and len(old.places) != len(places):
                raise RuleError(f"{m[1]} is declared with {len(old.places)} places")
            self.known[m[1]] = Predicate(m[1], places)
        return self

    def alias(self, name: str, target: str, swap: int) -> Vocabulary:
        """``name`` is ``target`` with its first and its ``swap``-th place exchanged."""
        if swap < 2 or swap > len(self.lookup(target).places):
            raise RuleError(f"{target} has no place {swap} to exchange")
        self.aliases[name] = (target, swap)
        return self

    def lookup(self, name: str, arity: int | None = None) -> Predicate:
        if name not in self.known:
            if not self.open or arity is None:
                raise RuleError(f"unknown predicate: {name}")
            self.known[name] = Predicate(name, tuple(f"x{i}" for i in range(1, max(1, arity) + 1)))
        return self.known[name]

    def resolve(self, name: str, arity: int) -> tuple[Predicate, int]:
        """(predicate, swapped place or 0) of a name as written."""
        target, swap = self.aliases.get(name, (name, 0))
        p = self.lookup(target, arity)
        if arity > len(p.places):
            raise RuleError(f"{name} has {len(p.places)} places, not {arity}")
        return p, swap

    def places(self, name: str, arity: int = 1) -> tuple[str, ...]:
        """Place labels in the order in which the name, alias or not, takes them."""
        p, swap = self.resolve(name, arity)
        out = list(p.places)
        if swap:
            out[0], out[swap - 1] = out[swap - 1], out[0]
        return tuple(out)
