"""The rule language's intermediate form: terms, literals, rules.

A rule body is a conjunction of positive atoms, negated atoms and built-in conditions over variables
and constants. Atoms carry a flavor (bare, or a tense or deontic mark), which is part of what they
match: facts of one flavor never answer for another.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Names of flavors and of built-in conditions.
FLAVORS = ("bare", "past", "now", "future", "must", "may")
COMPARISONS = ("greater", "less", "num_equal")
ARITHMETIC = ("product", "sum", "quotient")
EXTERNAL = ("exponential", "logarithm")


class RuleError(ValueError):
    """A program that is refused as a whole: unsafe, unstratifiable or ill-formed."""


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"${self.name}"


@dataclass(frozen=True)
class Const:
    """A constant as the relation stores it: a native value, or a tagged string in text knowledge bases."""

    value: object

    def __str__(self) -> str:
        return repr(self.value)


Term = Var | Const


def term(x: object) -> Term:
    """``"$x"`` is a variable; other values are constants; terms stay as they are."""
    if isinstance(x, (Var, Const)):
        return x
    if isinstance(x, str) and x.startswith("$"):
        return Var(x[1:])
    return Const(x)


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Term, ...]
    flavor: str = "bare"

    @property
    def key(self) -> tuple[str, str]:
        return self.relation, self.flavor

    def variables(self) -> set[str]:
        return {a.name for a in self.args if isinstance(a, Var)}

    def __str__(self) -> str:
        mark = "" if self.flavor == "bare" else self.flavor + " "
        return f"{mark}{self.relation}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Not:
    """Negation as failure of an atom; variables that occur nowhere else are existential inside it."""

    atom: Atom

    def variables(self) -> set[str]:
        return self.atom.variables()

    def __str__(self) -> str:
        return f"~{self.atom}"


@dataclass(frozen=True)
class Check:
    """A built-in condition: equal, greater, less, num_equal (two operands) or product, sum, quotient (three)."""

    op: str
    args: tuple[Term, ...]
    negated: bool = False

    def variables(self) -> set[str]:
        return {a.name for a in self.args if isinstance(a, Var)}

    def __str__(self) -> str:
        return f"{'~' * self.negated}{self.op}({', '.join(map(str, self.args))})"


Literal = Atom | Not | Check


def atom(relation: str, *args: object, flavor: str = "bare") -> Atom:
    return Atom(relation, tuple(term(a) for a in args), flavor)


def naf(relation: str, *args: object, flavor: str = "bare") -> Not:
    return Not(atom(relation, *args, flavor=flavor))


def check(op: str, *args: object, negated: bool = False) -> Check:
    return Check(op, tuple(term(a) for a in args), negated)


@dataclass(frozen=True)
class Rule:
    """All heads hold for every binding of the body. Priority and forward only choose the proof shown."""

    heads: tuple[Atom, ...]
    body: tuple[Literal, ...]
    label: str = ""
    priority: int = 0
    forward: bool = False
    invents: tuple[str, ...] = field(default=())

    def positive(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom)]

    def negative(self) -> list[Not]:
        return [x for x in self.body if isinstance(x, Not)]

    def checks(self) -> list[Check]:
        return [x for x in self.body if isinstance(x, Check)]

    def validate(self) -> Rule:
        """Refuse rules whose head or conditions use a variable that no positive atom binds."""
        bound = set().union(*(a.variables() for a in self.positive())) if self.positive() else set()
        loose = set().union(*(h.variables() for h in self.heads)) - bound - set(self.invents)
        if loose:
            raise RuleError(f"not range-restricted: {sorted(loose)} in the head of {self}")
        for c in self.checks():
            if c.variables() - bound:
                raise RuleError(f"not range-restricted: {sorted(c.variables() - bound)} in {c} of {self}")
        return self

    def identity(self) -> str:
        """The rule up to the names of its variables: equal for rules that say the same."""
        names: dict[str, str] = {}

        def renamed(t: Term) -> str:
            return names.setdefault(t.name, f"v{len(names)}") if isinstance(t, Var) else f"={t.value!r}"

        def shown(x: Literal) -> str:
            if isinstance(x, Not):
                return "~" + shown(x.atom)
            if isinstance(x, Check):
                return f"{'~' * x.negated}{x.op}?{','.join(map(renamed, x.args))}"
            return f"{x.flavor}:{x.relation}({','.join(map(renamed, x.args))})"

        return " & ".join(map(shown, self.body)) + " -> " + " & ".join(map(shown, self.heads))

    def __str__(self) -> str:
        return f"{' & '.join(map(str, self.body)) or 'true'} -> {' & '.join(map(str, self.heads))}"


def rule(head: Atom | tuple[Atom, ...], *body: Literal, label: str = "") -> Rule:
    heads = head if isinstance(head, tuple) else (head,)
    return Rule(heads, tuple(body), label).validate()
