"""Proofs: why a ground claim holds, as a trace that can be checked without the knowledge base."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import functions as F

from . import terms
from .functions import numeric
from .ir import Atom, Check, Const, Not, Rule, RuleError, Var
from .kb import KB
from .language import parser
from .language.formula import And, Leaf, Neg, Some
from .language.lower import Lowering
from .plans import bodies, strata
from .verdict import Verdict
from .vocab import Predicate, Vocabulary

#: asserted, table, denied and absent are leaves; a check is computed; a plan is a part that only its plan answers.
KINDS = ("asserted", "table", "denied", "rule", "equality", "check", "absent", "plan", "and")
LEAVES = ("asserted", "table", "denied", "absent", "check", "plan")


@dataclass(frozen=True)
class Step:
    """One conclusion. ``premises`` are numbers of earlier steps; ``cites`` a statement's id or a rule's label.

    ``literal`` is the conclusion as data; of a rule step, ``rule`` has the heads and the body and
    ``values`` what its variables stand for, so that the step can be checked by itself.
    """

    kind: str
    conclusion: str
    premises: tuple[int, ...] = ()
    cites: str = ""
    literal: tuple | None = None
    rule: dict | None = None
    values: dict | None = None


@dataclass
class Trace:
    """Steps in order, each after its premises; the last one is the claim."""

    claim: str
    verdict: str
    steps: list[Step] = field(default_factory=list)
    vocabulary: dict = field(default_factory=dict)

    @property
    def naf_dependent(self) -> bool:
        """Whether some step rests on the absence of a fact."""
        return any(s.kind == "absent" for s in self.steps)

    @property
    def cwa_false(self) -> bool:
        """Whether the verdict is FALSE for want of a proof, not by a denial."""
        return self.verdict == "FALSE" and not any(s.kind == "denied" for s in self.steps)

    def json(self) -> str:
        return json.dumps({"claim": self.claim, "verdict": self.verdict, "naf_dependent": self.naf_dependent, "cwa_false": self.cwa_false, "vocabulary": self.vocabulary, "steps": [asdict(s) for s in self.steps]})


def data(x) -> list:
    """A literal as plain data: sign, name, flavor, arguments; variables are {"var": name}."""
    if isinstance(x, Not):
        return ["-", *data(x.atom)[1:]]
    cells = [{"var": t.name} if isinstance(t, Var) else t.value for t in x.args]
    return ["+", x.relation, x.flavor, cells] if isinstance(x, Atom) else ["~?" if x.negated else "?", x.op, "", cells]


def _filled(literal: list, values: dict) -> list:
    return [*literal[:3], [values.get(c["var"]) if isinstance(c, dict) else c for c in literal[3]]]


def _matches(pattern: list, literal: list, values: dict) -> bool:
    """Whether a literal is an instance of a pattern; ``values`` takes what the variables stand for."""
    if list(pattern[:3]) != list(literal[:3]) or len(pattern[3]) != len(literal[3]):
        return False
    return all(values.setdefault(p["var"], c) == c if isinstance(p, dict) else p == c for p, c in zip(pattern[3], literal[3]))


def _claimed(text: str, vocabulary: dict) -> list | None:
    """The literals that a claim conjoins, or None for a claim of another form."""
    words = Vocabulary(open=vocabulary.get("open", True), known={n: Predicate(n, tuple(p)) for n, p in vocabulary.get("places", {}).items()}, aliases={k: tuple(v) for k, v in vocabulary.get("aliases", {}).items()})
    f = Lowering(words, frozenset(vocabulary.get("external", ()))).claim(parser.parse_one(text))
    while isinstance(f, Some):
        f = f.part
    out, canon = [], vocabulary.get("canon") or {}
    for p in f.parts if isinstance(f, And) else (f,):
        inner = p.part if isinstance(p, Neg) else p
        if not isinstance(inner, Leaf):
            return None
        literal = data(inner.item)
        literal[3] = [c if isinstance(c, dict) else canon.get(c, c) for c in literal[3]]
        out.append([{"+": "-", "-": "+", "?": "~?", "~?": "?"}[literal[0]], *literal[1:]] if isinstance(p, Neg) else literal)
    return out


def validate(text: str) -> list[str]:
    """Faults of a trace's JSON, without any knowledge base.

    The steps must come in order, each rule step must be an instance of the rule that it shows with the
    rule's body as its premises, computed conditions must come out, and the last step must be the claim.
    What a leaf says of the knowledge base cannot be checked here.
    """
    faults = []
    try:
        trace = json.loads(text)
        steps, verdict = trace["steps"], trace["verdict"]
        wanted = _claimed(trace["claim"], trace.get("vocabulary") or {})
        kinds = [s["kind"] for s in steps]
    except (ValueError, KeyError, TypeError) as e:
        return [f"no trace: {e}"]
    literal = lambda i: steps[i].get("literal")
    for i, s in enumerate(steps):
        premises = s.get("premises") or ()
        if s["kind"] not in KINDS:
            faults.append(f"step {i}: unknown kind {s['kind']}")
        if any(not isinstance(p, int) or p < 0 or p >= i for p in premises):
            faults.append(f"step {i}: a premise does not come before")
            continue
        if s["kind"] in LEAVES and premises:
            faults.append(f"step {i}: a leaf with premises")
        if s["kind"] in ("asserted", "table", "denied", "absent", "check", "rule", "equality") and not s.get("literal"):
            faults.append(f"step {i}: no literal")
        elif s["kind"] == "rule":
            r, values = s.get("rule") or {}, s.get("values") or {}
            if not r.get("body") or not any(_filled(h, values) == s["literal"] for h in r.get("heads", ())):
                faults.append(f"step {i}: no instance of its rule")
            elif [_filled(x, values) for x in r["body"]] != [literal(p) for p in premises] and not _absences(r["body"], values, [literal(p) for p in premises]):
                faults.append(f"step {i}: its premises are not its rule's body")
        elif s["kind"] == "equality" and (len(premises) != 1 or literal(premises[0])[:3] != s["literal"][:3]):
            faults.append(f"step {i}: equal names of something else")
        elif s["kind"] == "absent" and s["literal"][0] != "-" or s["kind"] in ("asserted", "table") and s["literal"][0] != "+":
            faults.append(f"step {i}: a literal of another sign")
        elif s["kind"] == "check" and _computed(s["literal"]) is False:
            faults.append(f"step {i}: the condition does not hold")
    if verdict == "TRUE":
        if not steps:
            faults.append("TRUE without a proof")
        elif wanted is not None and "plan" not in kinds:
            ends = [literal(p) for p in steps[-1]["premises"]] if kinds[-1] == "and" else [literal(len(steps) - 1)]
            values: dict = {}
            if len(ends) != len(wanted) or not all(e and _matches(w, e, values) for w, e in zip(wanted, ends)):
                faults.append("the last step is not the claim")
    if trace.get("naf_dependent") != ("absent" in kinds):
        faults.append("naf_dependent does not agree with the steps")
    if trace.get("cwa_false") != (verdict == "FALSE" and "denied" not in kinds):
        faults.append("cwa_false does not agree with the verdict")
    return faults


def _absences(body: list, values: dict, premises: list) -> bool:
    """Whether premises are the body's instances where negated atoms may keep variables of their own."""
    if len(body) != len(premises):
        return False
    return all(p is not None and _matches(x, p, dict(values)) or p == _filled(x, values) or x[0] == "-" and p == [*x[:3], [values.get(c["var"], c) if isinstance(c, dict) else c for c in x[3]]] for x, p in zip(body, premises))


def _computed(literal: list) -> bool | None:
    """The value of a condition on constants; None where it needs a backend or is undecided."""
    sign, op, _, cells = literal
    try:
        got = cells[0] == cells[1] if op == "equal" else numeric.decide(op, [terms.decode(c) for c in cells])
    except (TypeError, ValueError, KeyError, IndexError):
        return None
    return None if got is None else got != (sign == "~?")


class Prover:
    """Rebuilds one derivation from the evaluated model, backwards; each goal is a point lookup or one join.

    Among rules the one of higher priority comes first. In a recursive group only premises of earlier
    rounds are taken, so that what is found first is a proof, and no goal is met again on the way.
    """

    def __init__(self, kb: KB, model, canon: dict[str, str]):
        self.kb, self.model, self.canon = kb, model, canon
        self.steps: list[Step] = []
        self.done: dict[str, int] = {}
        self.group = {x: i for i, part in enumerate(strata.components(strata.edges(model.rules))) for x in part}

    def add(self, step: Step) -> int:
        if step.conclusion not in self.done:
            self.steps.append(step)
            self.done[step.conclusion] = len(self.steps) - 1
        return self.done[step.conclusion]

    def prove(self, goal: Atom) -> int | None:
        name = shown(goal)
        if name in self.done:
            return self.done[name]
        canon = self.canon
        for s in self.kb.live():
            for a in s.content.facts:
                if a.key == goal.key and tuple(canon.get(t.value, t.value) for t in a.args) == tuple(t.value for t in goal.args):
                    own = self.add(Step("asserted", shown(a), cites=str(s.id), literal=data(a)))
                    return own if a.args == goal.args else self.add(Step("equality", name, (own,), "substitution", data(goal)))
        if goal.key in self.kb.bound and self.model.facts[goal.key].where(_same(goal)).limit(1).count():
            return self.add(Step("table", name, cites=goal.relation, literal=data(goal)))
        rules = sorted((r for r in self.model.rules if any(h.key == goal.key for h in r.heads)), key=lambda r: (-r.priority, not r.forward))
        for r in rules:
            for head in (h for h in r.heads if h.key == goal.key):
                got = self.by_rule(goal, r, head)
                if got is not None:
                    return got
        return None

    def by_rule(self, goal: Atom, r: Rule, head: Atom) -> int | None:
        values: dict[str, Const] = {}
        for t, v in zip(head.args, goal.args):
            if isinstance(t, Const) and t != v or isinstance(t, Var) and values.setdefault(t.name, v) != v:
                return None
        values = {k: v for k, v in values.items() if k not in r.invents}
        body = tuple(_put(x, values) for x in r.body)
        got = bodies.conjunction(body, self.model.lookup, test=self.kb._test)
        if got is None:
            return None
        rows, names = got
        row = self.earlier(goal, body, rows, names).limit(1).collect()
        if not row:
            return None
        full = values | {v: Const(row[0][c]) for v, c in names.items()}
        premises = []
        for x in (_put(x, full) for x in body):
            if isinstance(x, Atom):
                premises.append(self.prove(x))
                if premises[-1] is None:
                    raise RuleError(f"{shown(x)} is in the model without a derivation")
            elif isinstance(x, Not):
                premises.append(self.add(Step("absent", f"~{shown(x.atom)}", literal=data(x))))
            else:
                premises.append(self.add(Step("check", str(x), literal=data(x))))
        made = {"heads": [data(h) for h in r.heads], "body": [data(x) for x in r.body]}
        told = {v: t.value for v, t in full.items()} | {t.name: v.value for t, v in zip(head.args, goal.args) if isinstance(t, Var) and t.name in r.invents}
        return self.add(Step("rule", shown(goal), tuple(premises), f"{r.label}: {r}", data(goal), made, told))

    def earlier(self, goal: Atom, body: tuple, rows, names: dict[str, str]):
        """The bindings whose premises in the goal's own recursive group came in an earlier round than the goal."""
        derived = self.model.derived(goal.key)
        own = derived.where(_same(goal)).agg(F.min("round")).first()[0] if derived is not None else None
        for i, a in enumerate(x for x in body if isinstance(x, Atom)):
            known = self.model.derived(a.key)
            if own is None or known is None or self.group.get(a.relation) != self.group.get(goal.relation):
                continue
            known = known.select(*(F.col(f"x{k}").alias(f"e{i}_{k}") for k in range(1, len(a.args) + 1)), F.col("round").alias(f"e{i}_round"))
            on = F.lit(True)
            for k, t in enumerate(a.args, 1):
                on &= F.col(f"e{i}_{k}") == (F.col(names[t.name]) if isinstance(t, Var) else F.lit(t.value))
            rows = rows.join(known, on, "left").where(F.coalesce(F.col(f"e{i}_round"), F.lit(0)) < own)
        return rows


def _put(x, values: dict[str, Const]):
    if isinstance(x, Not):
        return Not(_put(x.atom, values))
    return replace(x, args=tuple(values.get(t.name, t) if isinstance(t, Var) else t for t in x.args))


def _same(goal: Atom):
    test = F.lit(True)
    for i, t in enumerate(goal.args, 1):
        test &= F.col(f"x{i}") == t.value
    return test


def shown(a: Atom) -> str:
    cells = []
    for t in a.args:
        value = str(t) if isinstance(t, Var) else terms.decode(t.value)
        cells.append("_" if value is None else str(value))
    while len(cells) > 1 and cells[-1] == "_":
        cells.pop()
    mark = "" if a.flavor == "bare" else a.flavor + " "
    return f"{mark}{a.relation}({', '.join(cells)})"


def explain(kb: KB, text: str) -> Trace:
    """The verdict of a claim and, where it is TRUE, a proof: of its ground atoms, equations and conditions step by step, of quantified parts by their plan."""
    verdict: Verdict = kb.holds(text)
    words = {"open": kb.vocabulary.open, "places": {p.name: list(p.places) for p in kb.vocabulary.known.values()}, "aliases": {k: list(v) for k, v in kb.vocabulary.aliases.items()}, "external": sorted(kb.external.known)}
    trace = Trace(text.strip(), verdict.value, vocabulary=words)
    f = kb._question(text)
    while isinstance(f, Some):
        f = f.part
    canon = kb._canon()
    if verdict.value == "FALSE" and isinstance(f, Leaf) and isinstance(f.item, Atom):
        for s in kb.live():
            for a in s.content.denials:
                if a.key == f.item.key and tuple(canon.get(t.value, t.value) for t in a.args) == tuple(t.value if isinstance(t, Const) else None for t in f.item.args):
                    trace.steps.append(Step("denied", f"~{shown(a)}", cites=str(s.id), literal=data(Not(a))))
                    return trace
    if verdict.value != "TRUE":
        return trace
    prover = Prover(kb, kb.model(kb._relations(f)), canon)
    parts = f.parts if isinstance(f, And) else (f,)
    ground: dict[str, Const] = {}
    got = kb.rows(f, prover.model)
    if got is not None and got.names:
        row = got.rows.limit(1).collect()[0]
        ground = {v: Const(row[c]) for v, c in got.names.items()}
    premises = []
    for p in parts:
        inner = p.part if isinstance(p, Neg) else p
        item = _put(inner.item, ground) if isinstance(inner, Leaf) else None
        if isinstance(item, Check):
            item = replace(item, negated=item.negated != isinstance(p, Neg))
            premises.append(prover.add(Step("check", str(item), literal=data(item))))
        elif isinstance(item, Atom) and isinstance(p, Neg):
            premises.append(prover.add(Step("absent", f"~{shown(item)}", literal=data(Not(item)))))
        elif isinstance(item, Atom):
            premises.append(prover.prove(item))
        else:
            premises.append(prover.add(Step("plan", "quantified part, by its plan")))
    if len(parts) > 1:
        prover.add(Step("and", text.strip(), tuple(premises)))
    trace.steps = prover.steps
    if merged := {v: r for v, r in canon.items() if v != r}:
        trace.vocabulary["canon"] = merged  # what the claim's names stand for, as leaves do for facts
    return trace


def certify(kb: KB, text: str) -> str:
    """The trace as JSON, refused if it does not validate."""
    out = explain(kb, text).json()
    faults = validate(out)
    if faults:
        raise RuleError(f"no certificate: {faults[0]}")
    return out


def english(trace: Trace) -> str:
    """A trace in sentences."""
    lines = [f"{trace.claim} is {trace.verdict.lower()}."]
    for i, s in enumerate(trace.steps):
        why = {"asserted": f"was stated (statement {s.cites})", "table": f"stands in the table {s.cites}", "absent": "holds since nothing says otherwise", "check": "is computed", "equality": "follows by equal names", "and": "follows", "denied": f"was stated (statement {s.cites})", "plan": "is answered by a plan"}.get(s.kind, f"follows by rule {s.cites}")
        because = f" from {', '.join(str(p + 1) for p in s.premises)}" if s.premises else ""
        lines.append(f"{i + 1}. {s.conclusion} {why}{because}.")
    return "\n".join(lines)
