"""Knowledge bases: statements in, complete answers out.

A knowledge base is a log of statements; relations are what the statements that are not retracted
entail. Facts written as text live on the driver and become local DataFrames; tables bound as relations
stay where they are. Nothing is derived before a question needs it, and only what it needs.
"""

from __future__ import annotations

import copy
import json
import math
import re
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms, verdict
from .functions import numeric
from .functions.external import Registry
from .ir import COMPARISONS, Atom, Check, Const, Not, Rule, RuleError, Var
from .language import ast, parser, render
from .language.compile import MAX_CLAUSES, Compiler, Content
from .language.formula import And, Count, Every, Leaf, Neg, Or, Some, free, simple
from .language.lower import Lowering
from .operators import aggregates, constraints, equality
from .operators.constraints import Constraint
from .plans import bodies, demand, fixpoint, strata
from .sources import rdf
from .sources.tables import relation
from .verdict import Verdict
from .vocab import Predicate, Vocabulary


#: How the log marks a fact that was told by plain values; violations that one statement warns of.
_FACT = "#fact "
_UNDECIDED = "undecided for some bindings:"
WARNED = 100


class Incomplete(RuntimeError):
    """The set of answers cannot be told whole: some condition is undecided."""


@dataclass
class Config:
    """``strict`` rejects statements that violate a constraint; ``existential_import`` lets ``every x`` assume an x."""

    strict: bool = False
    existential_import: bool = False
    max_rounds: int = 200
    max_tuples: int | None = 2_000_000_000


@dataclass(frozen=True)
class Statement:
    id: int
    text: str
    content: Content
    retracted: bool = False


@dataclass
class Bindings:
    """Rows of a formula, and the columns of its variables."""

    rows: DataFrame
    names: dict[str, str]


def _written(text: str) -> str:
    """A log entry as a statement; a fact that no statement can say stays a comment."""
    if not text.startswith(_FACT):
        return text
    relation, cells, flavor = json.loads(text[len(_FACT) :])
    shown = []
    for c in cells:
        if c[:2] not in ("c:", "n:", "u:") or "\n" in c or c[:2] == "n:" and ("E" in c or "-" in c):
            return text
        shown.append("_" if c[:2] == "u:" else '"' + c[2:].replace("\\", "\\\\").replace('"', '\\"') + '"' if c[:2] == "c:" else c[2:].removesuffix(".0"))
    return f"{'' if flavor == 'bare' else flavor + ' '}{relation}({', '.join(shown)})."


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(p.getName()[8:]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class KB:
    def __init__(self, spark: SparkSession, vocabulary: Vocabulary | None = None, config: Config | None = None):
        self.spark = spark
        self.vocabulary = vocabulary or Vocabulary(open=True)
        self.config = config or Config()
        self.log: list[Statement] = []
        self.bound: dict[tuple[str, str], DataFrame] = {}
        self.external = Registry(taken=self._used)
        self.constraints: list[Constraint] = []
        self.registered: dict[int, tuple[str, str]] = {}
        self.derived_only: set[str] = set()
        self.admitted: set[str] | None = None
        self.settings: dict[str, dict] = {}
        self.sorts: list[tuple[str, str]] = []
        self.entity_sorts: dict[str, str] = {}
        self.place_sorts: dict[str, tuple[str, ...]] = {}
        self.warnings: list[str] = []
        self._model: tuple | None = None

    def _used(self) -> set[str]:
        """Relations that have facts, rules or a table."""
        out = {name for name, _ in self.bound}
        for s in self.live():
            out |= s.content.relations() | {h.relation for r in s.content.rules for h in r.heads}
        return out

    # -- statements
    def _lowered(self, claim):
        self.lowering = Lowering(self.vocabulary, frozenset(self.external.known))
        return self.lowering.claim(claim)

    def compile(self, text: str) -> list[Content]:
        """What each statement of a text would add, without adding it."""
        return [Compiler(str(len(self.log) + i), render.claim(c)).statement(self._lowered(c)) for i, c in enumerate(parser.parse(text))]

    def tell(self, text: str) -> list[int]:
        """Add the statements of a text, all or none; returns their ids."""
        before = (list(self.log), set(self.derived_only), None if self.admitted is None else set(self.admitted), copy.deepcopy(self.vocabulary.known))
        ids = []
        try:
            for claim in parser.parse(text):
                if self._declaration(claim):
                    continue
                content = Compiler(str(len(self.log)), render.claim(claim)).statement(self._lowered(claim))
                if self.config.existential_import:
                    content.facts += self._imports(claim, content)
                ids.append(self._add(render.claim(claim) + ".", content))
            strata.stratify(self.rules())
            self._check_new(before[0])
            self._check_sorts(ids)
        except Exception:
            self.log, self.derived_only, self.admitted, self.vocabulary.known = before
            self._model = None
            raise
        return ids

    def tell_fact(self, name: str, *args: object, flavor: str = "bare") -> int:
        """Add one fact from plain values (see terms.encode) or tagged terms."""
        cells = tuple(Const(a if isinstance(a, str) and a[1:2] == ":" and a[0] in "cdnuak" else terms.encode(a)) for a in args)
        p, _ = self.vocabulary.resolve(name, len(cells))
        cells += (Const(terms.UNSPECIFIED),) * (len(p.places) - len(cells))
        before = list(self.log)
        fact = Atom(p.name, cells, flavor)
        out = self._add(_FACT + json.dumps([fact.relation, [c.value for c in cells], flavor]), Content(facts=[fact]))
        try:
            self._check_new(before)
            self._check_sorts([out])
        except Exception:
            self.log = before
            raise
        return out

    def bind(self, name: str, df: DataFrame, *places: str, flavor: str = "bare", encode: bool = True) -> KB:
        """Make a table a relation. ``encode`` tags its values, so that text can speak of them; numbers become numbers."""
        kinds = dict(df.dtypes)
        if encode:
            cells = []
            for p in places:
                number = kinds[p].startswith(("int", "bigint", "double", "float", "smallint", "tinyint", "decimal"))
                cells.append(terms.numbers(F.col(p), kinds[p]) if number else F.concat(F.lit("c:"), F.col(p).cast("string")))
            made = relation(df, *cells)
        else:
            made = relation(df, *places)
        self.vocabulary.known.setdefault(name, self.vocabulary.lookup(name, len(places)) if self.vocabulary.open else self.vocabulary.lookup(name))
        key = (name, flavor)
        self.bound[key] = self.bound[key].unionByName(made) if key in self.bound else made
        self._model = None
        return self

    def bind_triples(self, triples: DataFrame) -> KB:
        """RDF triples (see sources.rdf) as relations: a binary one for each property, a unary one for each class, a rule for each subclass.

        The names of properties and classes come to the driver: they are the vocabulary, not the data.
        """
        low, typed, found = rdf.owl(triples)
        for r in [x["relation"] for x in found.select("relation").distinct().orderBy("relation").collect()]:
            self.bind(r, found.where(F.col("relation") == r), "x1", "x2", encode=False)
        for c in [x["sort"] for x in typed.select("sort").distinct().orderBy("sort").collect()]:
            self.bind(c, typed.where(F.col("sort") == c), "entity")
        pairs = [(r["low"], r["high"]) for r in low.orderBy("low", "high").collect()]
        self.sorts += pairs
        for below, above in pairs:
            self.tell(f"all $x: {below}($x) -> {above}($x).")
        return self

    def _declaration(self, claim) -> bool:
        if not isinstance(claim, ast.Pred) or claim.units not in (("derived_only",), ("admits",)):
            return False
        if len(claim.args) != 1 or claim.args[0][1].kind != "string":
            raise RuleError(f"{claim.units[0]} takes one quoted predicate")
        name = claim.args[0][1].value
        if claim.units == ("admits",):
            self.admitted = (self.admitted or set()) | {name}
        else:
            if name in {r for s in self.live() for r in s.content.relations()}:
                raise RuleError(f"{name} has asserted facts: derived_only comes too late")
            self.derived_only.add(name)
        return True

    def declare(self, derived: list[str] = (), admits: list[str] = (), sorts: list[tuple[str, str]] = (), entities: dict[str, str] | None = None, places: dict[str, tuple[str, ...]] | None = None) -> KB:
        """Declarations by call: derived-only relations, admitted ones, (sub, super) sorts, sorts of entities, sorts of relations' places ("" is any)."""
        for name in derived:
            self.tell(f'derived_only("{name}").')
        for name in admits:
            self.tell(f'admits("{name}").')
        self.sorts += sorts
        self.entity_sorts |= {terms.name(k): v for k, v in (entities or {}).items()}
        self.place_sorts |= places or {}
        return self

    def _misplaced(self, statements) -> list[tuple[str, str, str]]:
        """(relation, place, entity) of facts whose entity is of a sort that the place's sort does not hold. Entities without a sort fit anywhere."""
        out = []
        for s in statements:
            for a in s.content.facts:
                for i, (t, wanted) in enumerate(zip(a.args, self.place_sorts.get(a.relation, ())), 1):
                    own = self.entity_sorts.get(t.value)
                    if wanted and own and wanted not in self.sorts_above(own):
                        out.append((a.relation, str(i), t.value))
        return out

    def _check_sorts(self, ids: list[int]) -> None:
        found = self._misplaced([self.log[i] for i in ids])
        if found and self.config.strict:
            raise RuleError(f"sort of {found[0]}")
        self.warnings += [f"sort of {x}" for x in found]

    def sorts_above(self, sort: str) -> set[str]:
        out, todo = {sort}, [sort]
        while todo:
            x = todo.pop()
            for low, high in self.sorts:
                if low == x and high not in out:
                    out.add(high)
                    todo.append(high)
        return out

    def _add(self, text: str, content: Content) -> int:
        for a in content.facts:
            if a.relation in self.derived_only:
                raise RuleError(f"{a.relation} can only be derived")
            if self.admitted is not None and a.relation not in self.admitted:
                raise RuleError(f"{a.relation} is not admitted")
            if a.relation in self.external.known:
                raise RuleError(f"{a.relation} is computed: it can be asked, not asserted")
            if a.variables():
                raise RuleError(f"{a} is not ground")
        self.log.append(Statement(len(self.log), text, content))
        self._model = None
        return len(self.log) - 1

    def _check_new(self, before: list[Statement]) -> None:
        """Violations that the new statements bring: an error where strict, else warnings.

        Constraints and denials that the new statements cannot reach are not asked again.
        """
        old = {s.id for s in before}
        touched, equal = set(), False
        for s in self.log:
            if s.id not in old:
                c = s.content
                touched |= c.relations() | {a.relation for a in c.denials} | {h.relation for r in c.rules for h in r.heads}
                touched |= {x.relation for k in c.constraints for x in (*(y.atom if isinstance(y, Not) else y for y in k.body if not isinstance(y, Check)), *k.cases)}
                equal |= bool(c.equations or c.inequalities)
        read = {a.relation for s in self.live() for a in s.content.denials}
        for k in (*self.constraints, *(k for s in self.live() for k in s.content.constraints)):
            read |= {x.atom.relation if isinstance(x, Not) else x.relation for x in (*k.body, *k.cases) if not isinstance(x, Check)}
        if not equal and not touched & strata.demanded(self.rules(), read):
            return
        found = self.violations()
        now, self.log = self.log, before
        self._model = None
        try:
            found = found.exceptAll(self.violations())
        finally:
            self.log = now
            self._model = None
        new = [tuple(r) for r in found.limit(1 if self.config.strict else WARNED).collect()]
        if new and self.config.strict:
            raise RuleError(f"violates {new[0]}")
        self.warnings += [f"violates {v}" for v in new]

    def _imports(self, claim, content: Content) -> list[Atom]:
        """For universal claims by description, a witness of the description."""
        if not isinstance(claim, ast.Pred):
            return []
        out = []
        for r in content.rules:
            variables = set().union(*(a.variables() for a in r.positive()))
            values = {v: Const(f"k:{r.label}:{v}:import") for v in variables}
            out += [replace(a, args=tuple(values.get(t.name, t) if isinstance(t, Var) else t for t in a.args)) for a in r.positive()]
        return out

    def retract(self, statement: int) -> None:
        """Take a statement back: answers are then as if it had never been made."""
        if self.log[statement].retracted:
            raise RuleError(f"statement {statement} is retracted already")
        self.log[statement] = replace(self.log[statement], retracted=True)
        self._model = None

    def live(self) -> list[Statement]:
        return [s for s in self.log if not s.retracted]

    def facts(self) -> list[Statement]:
        return self.live()

    def reset(self) -> KB:
        self.log, self.constraints, self.registered, self._model = [], [], {}, None
        return self

    def assuming(self, *texts: str) -> KB:
        """A copy in which the texts are told too; this one stays as it is."""
        other = copy.copy(self)
        other.log, other.constraints, other.warnings = list(self.log), list(self.constraints), []
        other.registered, other.external = dict(self.registered), Registry(dict(self.external.known), other._used)
        other.derived_only, other.admitted = set(self.derived_only), None if self.admitted is None else set(self.admitted)
        other.vocabulary = copy.deepcopy(self.vocabulary)
        other.bound, other._model = dict(self.bound), None
        for t in texts:
            other.tell(t)
        return other

    # -- rules and their settings
    def rules(self) -> list[Rule]:
        out = []
        for s in self.live():
            for r in s.content.rules:
                out.append(replace(r, **self.settings.get(str(s.id), {})))
        return out

    def set_rule(self, statement: int, priority: int | None = None, forward: bool | None = None) -> None:
        """Execution settings of a statement's rules: they choose the proof that is shown, never the answer."""
        own = self.settings.setdefault(str(statement), {})
        own |= {k: v for k, v in (("priority", priority), ("forward", forward)) if v is not None}

    def strata(self) -> list[dict]:
        return strata.report(self.rules())

    def report(self) -> dict:
        """Relations and rounds of the last evaluation."""
        model = self._model[1] if self._model else None
        return {"relations": sorted({k[0] for k in (*model.facts, *model.paths, *model.views)}), "rounds": model.rounds} if model else {}

    # -- evaluation
    def _canon(self) -> dict[str, str]:
        return equality.classes([e for s in self.live() for e in s.content.equations])

    def equations(self) -> list[tuple[str, str]]:
        return [e for s in self.live() for e in s.content.equations]

    def why_equal(self, left: str, right: str) -> list[tuple] | None:
        """A chain of asserted equations between two terms."""
        return equality.path(self.equations(), left, right)

    def _canonical(self, item, canon: dict[str, str]):
        if isinstance(item, Not):
            return Not(self._canonical(item.atom, canon))
        return replace(item, args=tuple(Const(canon.get(t.value, t.value)) if isinstance(t, Const) else t for t in item.args))

    def _tables(self, canon: dict[str, str]) -> dict[tuple[str, str], DataFrame]:
        rows: dict[tuple[str, str], set] = {}
        for s in self.live():
            for a in s.content.facts:
                rows.setdefault(a.key, set()).add(tuple(canon.get(t.value, t.value) for t in a.args))
        out = {}
        for key, found in rows.items():
            width = len(next(iter(found)))
            out[key] = self.spark.createDataFrame(sorted(found), ", ".join(f"x{i} string" for i in range(1, width + 1)))
        names = equality.frame(self.spark, canon)
        for key, df in self.bound.items():
            df = equality.canonical(df, names) if names is not None else df
            out[key] = out[key].unionByName(df).distinct() if key in out else df
        return out

    def _test(self, c: Check, names: dict[str, str]):
        return numeric.condition(c, names, terms.as_number, {n: self.external.column(n) for n in self.external.known})

    def model(self, wanted: set[str]) -> fixpoint.Model:
        """The evaluated program for some relations; kept until something changes."""
        need = strata.demanded(self.rules(), wanted)
        if self._model and need <= self._model[0]:
            return self._model[1]
        canon = self._canon()
        rules = self._canonical_rules(canon)
        limits = fixpoint.Limits(self.config.max_rounds, self.config.max_tuples)
        made = fixpoint.evaluate(self.spark, rules, self._tables(canon), need, limits, self._rule_test)
        self._model = (need, made)
        return made

    def model_for(self, f) -> fixpoint.Model:
        """The evaluated program for a question: constants at places of recursive relations reach the recursion."""
        wanted = self._relations(f)
        need = strata.demanded(self.rules(), wanted)
        if self._model and need <= self._model[0]:
            return self._model[1]
        turning = demand.recursive(self.rules())
        goals = [a for a in self._atoms(f) if a.relation in turning and any(isinstance(t, Const) and t.value != terms.UNSPECIFIED for t in a.args)]
        free_too = {a.relation for a in self._atoms(f)} - {a.relation for a in goals}
        whole = {a.relation for a in self._atoms(f) if a.relation in {g.relation for g in goals} and a not in goals}
        if not goals or whole:
            return self.model(wanted)
        canon = self._canon()
        limits = fixpoint.Limits(self.config.max_rounds, self.config.max_tuples)
        return fixpoint.evaluate(self.spark, self._canonical_rules(canon), self._tables(canon), free_too, limits, self._rule_test, goals)

    def _canonical_rules(self, canon: dict[str, str]) -> list[Rule]:
        return [replace(r, heads=tuple(self._canonical(h, canon) for h in r.heads), body=tuple(self._canonical(x, canon) for x in r.body)) for r in self.rules()]

    def _atoms(self, f) -> list[Atom]:
        if isinstance(f, Leaf):
            return [f.item] if isinstance(f.item, Atom) else []
        if isinstance(f, (And, Or)):
            return [a for p in f.parts for a in self._atoms(p)]
        return self._atoms(f.part) + (self._atoms(f.within) if isinstance(f, Every) and f.within is not None else [])

    def domain(self, model: fixpoint.Model) -> DataFrame:
        """Individuals: every term of a fact or a rule, but for unspecified places and generated witnesses."""
        found = {t.value for r in model.rules for x in (*r.heads, *r.positive()) for t in x.args if isinstance(t, Const)}
        parts = [self.spark.createDataFrame([(v,) for v in sorted(found)], "x1 string")]
        for df in (df for (name, _), df in model.facts.items() if not name.startswith(demand.MARK)):
            parts += [df.select(F.col(c).alias("x1")) for c in df.columns]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(_individual(F.col("x1"))).distinct()

    # -- formulas
    def _relations(self, f) -> set[str]:
        if isinstance(f, Leaf):
            return {f.item.relation} if isinstance(f.item, Atom) else set()
        if isinstance(f, (And, Or)):
            return set().union(*map(self._relations, f.parts)) if f.parts else set()
        return self._relations(f.part) | (self._relations(f.within) if isinstance(f, Every) and f.within is not None else set())

    def _question(self, text: str, shown: bool = False):
        f = self._lowered(parser.parse_one(text))
        canon = self._canon()

        def walk(g):
            if isinstance(g, Leaf):
                return Leaf(self._canonical(g.item, canon))
            if isinstance(g, (And, Or)):
                return type(g)(tuple(map(walk, g.parts)))
            if isinstance(g, Every):
                return Every(g.var, None if g.within is None else walk(g.within), walk(g.part))
            return replace(g, **({"left": walk(g.left), "right": walk(g.right)} if hasattr(g, "left") else {"part": walk(g.part)}))

        return simple(walk(f))

    def rows(self, f, model: fixpoint.Model) -> Bindings | None:
        """Bindings of a formula's free variables; None if there are none for sure."""
        if isinstance(f, Or):
            return self._union(f, model)
        if isinstance(f, Some):
            got = self.rows(f.part, model)
            if got is None:
                return None
            keep = {v: c for v, c in got.names.items() if v != f.var}
            return Bindings(got.rows.select(*keep.values()).distinct() if keep else got.rows.limit(1), keep)
        if isinstance(f, Count):
            got = self.rows(f.part, model)
            if got is None:
                return None
            by = {v: c for v, c in got.names.items() if v != f.var}
            return Bindings(aggregates.exactly(got.rows, got.names[f.var], list(by.values()), f.n), by)
        if isinstance(f, Every):
            return self.rows(Neg(_counterexample(f)), model)
        parts = f.parts if isinstance(f, And) else (f,)
        choice = next((p for p in parts if isinstance(p, Or)), None)
        if choice is not None and math.prod(len(p.parts) for p in parts if isinstance(p, Or)) <= MAX_CLAUSES and any(isinstance(p, Leaf) and isinstance(p.item, Atom) for p in parts):
            # each case with the rest: what binds the rest binds the case, too
            rest = tuple(p for p in parts if p is not choice)
            return self.rows(simple(Or(tuple(And((*rest, p)) for p in choice.parts))), model)
        flat = [p.item for p in parts if isinstance(p, Leaf)]
        flat += [Not(p.part.item) for p in parts if isinstance(p, Neg) and isinstance(p.part, Leaf) and isinstance(p.part.item, Atom)]
        checks = [x for x in flat if isinstance(x, Check)] + [Check(p.part.item.op, p.part.item.args, not p.part.item.negated) for p in parts if isinstance(p, Neg) and isinstance(p.part, Leaf) and isinstance(p.part.item, Check)]
        atoms = [x for x in flat if isinstance(x, Atom) and x.relation != "_domain"]
        individuals = {t.name for x in flat if isinstance(x, Atom) and x.relation == "_domain" for t in x.args}
        negative = [x for x in flat if isinstance(x, Not)]
        deep = [p for p in parts if not isinstance(p, Leaf) and not (isinstance(p, Neg) and isinstance(p.part, Leaf))]
        now: Bindings | None = None
        if atoms:
            got = bodies.conjunction(tuple(atoms), model.lookup, test=self._test)
            if got is None:
                return None
            now = Bindings(*got)
        for p in (p for p in deep if not isinstance(p, Neg)):
            got = self.rows(p, model)
            if got is None:
                return None
            now = got if now is None else self._join(now, got)
        for v in sorted(individuals & set(now.names if now else ())):  # what a relation holds is in the domain, but for these
            now = Bindings(now.rows.where(_individual(F.col(now.names[v]))), now.names)
        wanted = individuals.union(*(c.variables() for c in (*checks, *negative)))
        for p in deep:
            wanted |= free(p) if isinstance(p, Neg) else set()
        for v in sorted(wanted - set(now.names if now else ())):
            part, own = bodies.scan(Atom("_domain", (Var(v),)), self.domain(model))
            now = Bindings(part, own) if now is None else Bindings(now.rows.crossJoin(part), now.names | own)
        if now is None:
            now = Bindings(self.spark.range(1).select(F.lit(1).alias("one")), {})
        for c in checks:
            now = self._filtered(now, c)
        for n in negative:
            source = model.lookup(n.atom)
            if source is not None:
                part, own = bodies.scan(n.atom, source)
                now = self._without(now, Bindings(part, own))
        for p in (p for p in deep if isinstance(p, Neg)):
            got = self.rows(p.part, model)
            if got is not None:
                now = self._without(now, got)
        return now

    def _filtered(self, now: Bindings, c: Check) -> Bindings:
        test = self._test(c, now.names)
        if c.op != "equal":
            undecided = test.isNull()
            if c.op not in self.external.known:  # of numbers: other terms are no answers
                for t in c.args:
                    undecided &= (F.col(now.names[t.name]) if isinstance(t, Var) else F.lit(t.value)).startswith("n:")
            if now.rows.where(undecided).limit(1).count():
                raise Incomplete(f"{c} is undecided for some bindings")
        return Bindings(now.rows.where(test), now.names)

    def _rule_test(self, c: Check, names: dict[str, str]):
        """The filter of a rule's condition: an undecided comparison of numbers ends the evaluation, it is no silent no."""
        test = self._test(c, names)
        if c.op not in COMPARISONS or c.op in self.external.known:
            return test
        numbers = F.lit(True)
        for t in c.args:
            numbers &= (F.col(names[t.name]) if isinstance(t, Var) else F.lit(t.value)).startswith("n:")
        return F.when(numbers & test.isNull(), F.raise_error(F.lit(f"{_UNDECIDED} {c}")).cast("boolean")).otherwise(test)

    @staticmethod
    def _join(a: Bindings, b: Bindings) -> Bindings:
        shared = [v for v in b.names if v in a.names]
        if not shared:
            return Bindings(a.rows.crossJoin(b.rows), a.names | b.names)
        on = F.lit(True)
        for v in shared:
            on &= F.col(a.names[v]) == F.col(b.names[v])
        return Bindings(a.rows.join(b.rows, on).drop(*[b.names[v] for v in shared]), {**b.names, **a.names})

    @staticmethod
    def _without(a: Bindings, b: Bindings) -> Bindings:
        on = F.lit(True)
        for v, c in b.names.items():
            if v in a.names:
                on &= F.col(a.names[v]) == F.col(c)
        return Bindings(a.rows.join(b.rows, on, "left_anti"), a.names)

    def _union(self, f: Or, model: fixpoint.Model) -> Bindings | None:
        every = sorted(free(f))
        cases = [_literals(p) for p in f.parts]
        got = None if None in cases else bodies.gathered(cases, lambda a: model.lookup(a, repeated=True))
        if got is not None:
            return Bindings(*got)
        out = None
        mark = f"o{next(bodies._fresh)}"
        for p in f.parts:
            got = self.rows(p, model)
            if got is None:
                continue
            cells = [(F.col(got.names[v]) if v in got.names else F.lit(None).cast("string")).alias(f"{mark}_{i}") for i, v in enumerate(every)] or [F.lit(1).alias(f"{mark}_one")]
            rows = got.rows.select(*cells)
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else Bindings(out.distinct(), {v: f"{mark}_{i}" for i, v in enumerate(every)})

    # -- questions
    def holds(self, text: str) -> Verdict:
        """Whether a claim is entailed. Free ``$x`` and ``?`` are existential, shared within the claim."""
        try:
            f = self._question(text)
            return self._verdict(f, self.model_for(f))
        except fixpoint.ResourceExceeded as e:
            return verdict.exceeded(e.kind)
        except Incomplete:
            return verdict.unknown("non-finite")
        except PySparkException as e:
            if _UNDECIDED not in str(e):
                raise
            return verdict.unknown("non-finite")

    def _verdict(self, f, model: fixpoint.Model) -> Verdict:
        if isinstance(f, Leaf) and isinstance(f.item, Check) and not free(f):
            return self._constant(f.item)
        if isinstance(f, Neg):
            return verdict.negated(self._verdict(f.part, model))
        if isinstance(f, (And, Or)):
            groups: list[tuple[set, list]] = []
            for p in f.parts:
                own = free(p)
                touching = [g for g in groups if isinstance(f, And) and g[0] & own]
                merged = (own.union(*(g[0] for g in touching)), [x for g in touching for x in g[1]] + [p])
                groups = [g for g in groups if g not in touching] + [merged]
            if len(groups) > 1:
                out = None
                for _, parts in groups:
                    one = self._verdict(parts[0] if len(parts) == 1 else And(tuple(parts)), model)
                    out = one if out is None else (verdict.both if isinstance(f, And) else verdict.either)(out, one)
                    if out == (verdict.FALSE if isinstance(f, And) else verdict.TRUE):
                        return out
                return out
        got = self.rows(f, model)
        return verdict.FALSE if got is None else verdict.of(got.rows.limit(1).count() > 0)

    def _constant(self, c: Check) -> Verdict:
        if c.op == "equal":
            found: bool | None = c.args[0].value == c.args[1].value
        else:
            values = [terms.decode(t.value) for t in c.args]
            if c.op in self.external.known:
                found = self.external.decide(c.op, values)
                if found is None:
                    return verdict.unknown("backend-unavailable")
            else:
                found = numeric.decide(c.op, values)
        return verdict.of(None if found is None else found != c.negated)

    def find(self, text: str, decoded: bool = False) -> DataFrame:
        """One row per set of bindings: a column for each ``$x`` and, as _1, _2 ..., for each ``?``.

        Sets that differ in a determiner's own variable only are different rows, as they are for counts.
        Equal terms are one answer; it is shown by the name that the facts in question use, the least of several.
        """
        f = self._question(text)
        hidden = []
        while isinstance(f, Some):
            hidden.append(f.var)
            f = f.part
        got = self.rows(f, self.model_for(f))
        asked = self.lowering.anonymous
        shown = sorted(v for v in (free(f) - set(hidden)) if not v.startswith("_")) + [v for v in asked if v in free(f)]
        label = {v: f"_{asked.index(v) + 1}" if v in asked else v for v in shown}
        if got is None:
            return self.spark.createDataFrame([], ", ".join(f"{label[v]} string" for v in shown) or "found int")
        rows = got.rows.select(*[F.col(c).alias(v) for v, c in got.names.items()]).distinct() if got.names else got.rows.limit(1)
        spelled = self._spelling(f)
        for v in shown if spelled is not None else ():
            rows = rows.join(F.broadcast(spelled.withColumnsRenamed({"rep": "_r", "shown": "_s"})), F.col(v) == F.col("_r"), "left").withColumn(v, F.coalesce("_s", v)).drop("_r", "_s")
        cells = [(self._decoded(F.col(v)) if decoded else F.col(v)).alias(label[v]) for v in shown]
        return rows.select(*cells) if cells else rows.select(F.lit(1).alias("found"))

    def _spelling(self, f) -> DataFrame | None:
        """(rep, shown) for classes of equal terms whose representative is not what facts of the asked relations say."""
        canon = self._canon()
        if not canon:
            return None
        asked = self._relations(f)
        used: dict[str, str] = {}
        for s in self.live():
            for a in s.content.facts:
                for t in a.args:
                    if a.relation in asked and t.value in canon:
                        used[canon[t.value]] = min(t.value, used.get(canon[t.value], t.value))
        said = {r: t for r, t in used.items() if r != t}
        return self.spark.createDataFrame(sorted(said.items()), "rep string, shown string") if said else None

    @staticmethod
    def _decoded(c):
        return F.when(c == "u:", F.lit(None)).when(c.startswith("d:"), F.concat(F.lit("the "), F.substring(c, 3, 1 << 20))).otherwise(F.substring(c, 3, 1 << 20))

    def count(self, text: str) -> int:
        return self.find(text).count()

    def aggregate(self, text: str, variable: str, op: str) -> aggregates.Aggregate:
        """sum, min, max or avg of a variable over the binding sets of a find; an error if any has no finite number."""
        found = self.find(text)
        variable = variable.lstrip("$")
        return aggregates.aggregate(found.select(terms.as_number(F.col(variable)).alias(variable)), variable, op)

    def plan(self, text: str) -> DataFrame:
        """The DataFrame behind a question, for explain()."""
        f = self._question(text)
        got = self.rows(f, self.model_for(f))
        return got.rows if got else self.spark.range(0)

    # -- integrity
    def register_constraint(self, text: str, label: str = "") -> None:
        """A conjunction that must not hold for any binding. It has a place in the log, and can be retracted there."""
        f = simple(self._lowered(parser.parse_one(text)))
        c = Compiler(f"constraint{len(self.log)}", text)
        found = [Constraint(label or text, tuple(clause)) for clause in c.clauses(f)]
        self.registered[len(self.log)] = (text, label)
        self.log.append(Statement(len(self.log), text, Content(rules=c.out.rules, constraints=found)))
        self._model = None

    def violations(self) -> DataFrame:
        """(kind, label, detail): broken constraints, facts, asserted or derived, that are also denied, equal terms that are said to differ, misplaced entities."""
        canon = self._canon()
        every = [*self.constraints, *(c for s in self.live() for c in s.content.constraints)]
        denied: dict[tuple[str, str], set] = {}
        for s in self.live():
            for a in s.content.denials:
                denied.setdefault(a.key, set()).add(tuple(canon.get(t.value, t.value) for t in a.args))
        tables = {k: self.spark.createDataFrame(sorted(v), ", ".join(f"x{i} string" for i in range(1, len(next(iter(v))) + 1))) for k, v in denied.items()}
        wanted = {k[0] for k in denied} | {x.atom.relation if isinstance(x, Not) else x.relation for c in every for x in c.body if not isinstance(x, Check)}
        model = self.model(wanted)
        nothing = self.spark.createDataFrame([], "kind string, label string, detail string")
        for c in every:
            c = replace(c, body=tuple(self._canonical(x, canon) for x in c.body), cases=tuple(self._canonical(x, canon) for x in c.cases))
            if not c.body:
                if all(a.key in tables and tuple(t.value for t in a.args) in denied[a.key] for a in c.cases):
                    nothing = nothing.unionByName(self.spark.createDataFrame([("disjunction", c.label, "every case is denied")], nothing.schema))
                continue
            found = constraints.violations(c, model.lookup, lambda a: tables.get(a.key))
            nothing = nothing if found is None else nothing.unionByName(found)
        for key, df in tables.items():
            have = model.relation(key)
            if have is not None:
                both = have.intersect(df)
                nothing = nothing.unionByName(both.select(F.lit("denied").alias("kind"), F.lit(key[0]).alias("label"), F.concat_ws(", ", *both.columns).alias("detail")))
        plain = [("inequality", str(s.id), f"{a} = {b}") for s in self.live() for a, b in s.content.inequalities if canon.get(a, a) == canon.get(b, b)]
        plain += [("sort", relation, f"{place}: {entity}") for relation, place, entity in self._misplaced(self.live())]
        if plain:
            nothing = nothing.unionByName(self.spark.createDataFrame(plain, nothing.schema))
        return nothing.distinct()

    # -- persistence
    def save(self, path: str) -> int:
        """The whole knowledge base but its tables and backends, as a new version beside those saved before; returns its number.

        One row per statement, retracted ones included, and one of declarations. A version counts once its writer is done.
        """
        own = {
            "derived_only": sorted(self.derived_only), "admitted": None if self.admitted is None else sorted(self.admitted), "sorts": self.sorts, "entity_sorts": self.entity_sorts,
            "place_sorts": self.place_sorts, "settings": self.settings, "constraints": self.registered, "aliases": self.vocabulary.aliases,
            "places": {p.name: p.places for p in self.vocabulary.known.values()}, "open": self.vocabulary.open, "config": vars(self.config),
        }
        rows = [(s.id, s.text, s.retracted, sorted({a.relation for a in s.content.facts})) for s in self.log] + [(-1, json.dumps(own), False, [])]
        number = max(_versions(self.spark, path), default=0) + 1
        self.spark.createDataFrame(rows, "id long, text string, retracted boolean, relations array<string>").coalesce(1).write.parquet(f"{path}/version={number}")
        return number

    @classmethod
    def load(cls, spark: SparkSession, path: str, vocabulary: Vocabulary | None = None, config: Config | None = None, version: int | None = None) -> KB:
        """What save() wrote, the last whole version of it if none is named. Tables are bound, and backends registered, anew."""
        found = _versions(spark, path)
        if not found:
            raise RuleError(f"nothing is saved at {path}")
        rows = spark.read.parquet(f"{path}/version={version or max(found)}").orderBy("id").collect()
        own = json.loads(rows[0]["text"])
        if vocabulary is None:
            vocabulary = Vocabulary(open=own["open"], known={n: Predicate(n, tuple(p)) for n, p in own["places"].items()}, aliases={k: tuple(v) for k, v in own["aliases"].items()})
        out = cls(spark, vocabulary, config or Config(**own["config"]))
        constraints = {int(k): v for k, v in own["constraints"].items()}
        for row in rows[1:]:
            text = row["text"]
            if row["id"] in constraints:
                out.register_constraint(*constraints.pop(row["id"]))
                out.log[-1] = replace(out.log[-1], retracted=row["retracted"])
                continue
            if text.startswith(_FACT):
                relation, cells, flavor = json.loads(text[len(_FACT) :])
                content = Content(facts=[Atom(relation, tuple(map(Const, cells)), flavor)])
            else:
                claim = parser.parse_one(text)
                content = Compiler(str(row["id"]), render.claim(claim)).statement(out._lowered(claim))
                if out.config.existential_import:
                    content.facts += out._imports(claim, content)
            out.log.append(Statement(row["id"], text, content, row["retracted"]))
        out.derived_only, out.admitted = set(own["derived_only"]), None if own["admitted"] is None else set(own["admitted"])
        out.sorts, out.entity_sorts, out.settings = [tuple(x) for x in own["sorts"]], own["entity_sorts"], own["settings"]
        out.place_sorts = {k: tuple(v) for k, v in own["place_sorts"].items()}
        return out

    def dump(self, path: str) -> None:
        """The live statements as text lines, which a script can tell again."""
        self.spark.createDataFrame([(_written(s.text),) for s in self.live() if s.id not in self.registered] or [], "value string").coalesce(1).write.mode("overwrite").text(path)

    def run_script(self, text: str) -> list[dict]:
        """A script: statements, over one or several lines; ``? question``, ``?? find``, ``:command`` on a line. One report row each.

        Commands: retract n, facts, rules, stratify, debug question, assume statement ; question, aggregate op $v find, proof question, reset, save path.
        """
        out = []
        for number, line in _pieces(text):
            row: dict = {"line": number, "text": line}
            try:
                if line.startswith("??"):
                    row |= {"kind": "find", "result": [json.loads(x) for x in self.find(line[2:].strip()).toJSON().collect()]}
                elif line.startswith("?"):
                    row |= {"kind": "query", "result": str(self.holds(line[1:].strip()))}
                elif line.startswith(":"):
                    word, _, rest = line[1:].partition(" ")
                    row |= {"kind": word, "result": self._command(word, rest.strip())}
                else:
                    row |= {"kind": "tell", "result": self.tell(line)}
            except (RuleError, Incomplete, aggregates.AggregateError) as e:
                row |= {"kind": "refused", "result": str(e)}
            out.append(row)
        return out

    def run_file(self, path: str) -> list[dict]:
        """run_script() of a text file that Spark can read."""
        return self.run_script("\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect()))

    def _command(self, word: str, rest: str):
        from . import proof  # it builds on this module

        if word == "retract":
            self.retract(int(rest))
            return "ok"
        if word == "facts":
            return [s.text for s in self.facts()]
        if word == "rules":
            return [str(r) for r in self.rules()]
        if word == "stratify":
            return self.strata()
        if word == "debug":
            return [str(r) for r in self.rules() if any(h.relation in strata.demanded(self.rules(), self._relations(self._question(rest))) for h in r.heads)]
        if word == "assume":
            told, _, asked = rest.rpartition(";")
            return str(self.assuming(told.strip()).holds(asked.strip()))
        if word == "aggregate":
            op, variable, asked = rest.split(None, 2)
            return vars(self.aggregate(asked, variable, op))
        if word == "proof":
            return proof.english(proof.explain(self, rest)).splitlines()
        if word == "reset":
            self.reset()
            return "ok"
        if word == "save":
            return self.save(rest)
        raise RuleError(f"unknown command: {word}")


def _individual(c):
    """Whether a term is one of the domain, given that some fact or rule has it."""
    return (c != terms.UNSPECIFIED) & ~c.startswith("k:")


def _literals(f) -> tuple | None:
    """A conjunction of plain and negated atoms as a rule's body; None for any other formula, or where all are negated."""
    parts = f.parts if isinstance(f, And) else (f,)
    out = [p.part.item if isinstance(p, Neg) and isinstance(p.part, Leaf) else p.item if isinstance(p, Leaf) else None for p in parts]
    if any(not isinstance(x, Atom) or x.relation == "_domain" for x in out) or not any(isinstance(p, Leaf) for p in parts):
        return None
    return tuple(Not(x) if isinstance(p, Neg) else x for p, x in zip(parts, out))


def _counterexample(f: Every, among: frozenset = frozenset()):
    """That some individual fails a universal claim. Claims inside it are opened too, so that what binds their variables binds them here.

    ``among`` are variables that stand for individuals only. Of a claim about others, the complement is taken in the domain, unless it is all that is denied:
    then others are what the whole is the complement of.
    """
    among |= {f.var}
    failed = simple(Neg(f.part))
    parts = failed.parts if isinstance(failed, And) else (failed,)
    opened = [_counterexample(p.part, among) if isinstance(p, Neg) and isinstance(p.part, Every) and (len(parts) == 1 or free(p) <= among) else p for p in parts]
    return Some(f.var, simple(And((Leaf(Atom("_domain", (Var(f.var),))), *opened))))


def _pieces(text: str):
    """(line number, piece) of a script: commands and questions end with their line, statements with a full stop at a line's end."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = re.sub(r'"(?:\\["\\]|[^"\\\n])*"|/\*.*?\*/', lambda m: m.group() if m.group()[0] == '"' else blank(m), text, flags=re.DOTALL)
    held, begun = [], 0
    for number, line in enumerate(text.splitlines(), 1):
        line = re.sub(r'("(?:\\["\\]|[^"\\\n])*")|#.*', lambda m: m[1] or "", line).strip()
        if not line:
            continue
        if not held and line[0] in "?:":
            yield number, line
            continue
        begun = begun if held else number
        held.append(line)
        if line.endswith("."):
            yield begun, " ".join(held)
            held = []
    if held:
        yield begun, " ".join(held)
