"""Authorization: six rules over ownership, roles, tenants and grants, for single and batch decisions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ir import Const, Not, Rule, Var, atom, rule
from .plans import fixpoint
from .scratch import write_once
from .sources.tables import relation

#: The policy, authorized(who, action, resource).
POLICY: tuple[Rule, ...] = (
    rule(atom("authorized", "$u", "read", "$r"), atom("owns", "$u", "$r"), label="an owner reads"),
    rule(atom("authorized", "$u", "update", "$r"), atom("owns", "$u", "$r"), label="an owner updates"),
    rule(atom("authorized", "$u", "read", "$r"), atom("has_role", "$u", "admin"), atom("resource", "$r"), label="an admin reads"),
    rule(atom("authorized", "$u", "update", "$r"), atom("has_role", "$u", "admin"), atom("resource", "$r"), label="an admin updates"),
    rule(atom("authorized", "$u", "read", "$r"), atom("in_tenant", "$u", "$t"), atom("resource_tenant", "$r", "$t"), label="a tenant's member reads"),
    rule(atom("authorized", "$u", "$a", "$r"), atom("grant", "$u", "$a", "$r"), label="a grant allows"),
)
#: Relation that holds the requests of a batch.
REQUESTED = "requested in this batch"
ARITY = {"owns": 2, "has_role": 2, "resource": 1, "in_tenant": 2, "resource_tenant": 2, "grant": 3}


@dataclass(frozen=True)
class Decision:
    allowed: bool
    reasons: tuple[str, ...] = ()


class Authorizer:
    """Decisions over fact tables; allowed only where a rule says so. Ephemeral facts go with ``clear``."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, policy: tuple[Rule, ...] = POLICY):
        self.spark, self.policy, self.version = spark, policy, 0
        self.tables = dict(tables or {})
        self.ephemeral: set[tuple] = set()
        self.cache: dict[tuple, Decision] = {}

    def load_policy(self, policy: tuple[Rule, ...]) -> None:
        self.policy = tuple(r.validate() for r in policy)
        self._changed()

    def _changed(self) -> None:
        self.version += 1
        self.cache.clear()

    def assert_facts(self, *found: tuple) -> None:
        self.ephemeral |= set(found)
        self._changed()

    def retract(self, *found: tuple) -> None:
        self.ephemeral -= set(found)
        self._changed()

    def clear(self) -> None:
        self.ephemeral.clear()
        self._changed()

    def _facts(self) -> dict:
        out = {(name, "bare"): df for name, df in self.tables.items()}
        for name in {f[0] for f in self.ephemeral}:
            rows = [f[1:] for f in sorted(self.ephemeral) if f[0] == name]
            df = self.spark.createDataFrame(rows, ", ".join(f"x{i} string" for i in range(1, len(rows[0]) + 1)))
            out[name, "bare"] = out[name, "bare"].unionByName(df) if (name, "bare") in out else df
        return out

    def authorized(self) -> DataFrame | None:
        """Everything that is allowed: x1 who, x2 action, x3 resource."""
        return fixpoint.evaluate(self.spark, self.policy, self._facts(), ["authorized"]).relation(("authorized", "bare"))

    def _authorized_of(self, requests: DataFrame) -> DataFrame | None:
        """What is allowed, of the requests alone where the policy permits it: a role times every resource is not listed."""
        plain = all(len(r.heads) == 1 and not r.invents and r.heads[0].relation == "authorized" for r in self.policy)
        if not plain or any(x.relation == "authorized" for r in self.policy for x in (*r.positive(), *(n.atom for n in r.negative()))):
            return self.authorized()
        asked = [replace(r, body=(atom(REQUESTED, *r.heads[0].args), *r.body)) for r in self.policy]
        # each rule reads the requests: they are made and made distinct once
        known = self._facts() | {(REQUESTED, "bare"): write_once(relation(requests, "who", "action", "resource"), "asked")}
        return fixpoint.evaluate(self.spark, asked, known, ["authorized"]).relation(("authorized", "bare"))

    def can_any(self, requests: DataFrame) -> DataFrame:
        """The allowed ones of (who, action, resource) requests: one semi join for the whole batch."""
        requests = write_once(requests, "requests")
        got = self._authorized_of(requests)
        if got is None:
            return requests.limit(0)
        on = (F.col("who") == F.col("x1")) & (F.col("action") == F.col("x2")) & (F.col("resource") == F.col("x3"))
        return requests.join(got, on, "left_semi")

    def decide(self, requests: DataFrame) -> DataFrame:
        """The requests, each with whether it is ``allowed``."""
        requests = write_once(requests, "requests")
        got = self._authorized_of(requests)
        if got is None:
            return requests.withColumn("allowed", F.lit(False))
        yes = got.distinct().withColumn("allowed", F.lit(True))
        on = (F.col("who") == F.col("x1")) & (F.col("action") == F.col("x2")) & (F.col("resource") == F.col("x3"))
        return requests.join(yes, on, "left").select(*[requests[c] for c in requests.columns], F.coalesce("allowed", F.lit(False)).alias("allowed"))

    def can(self, who: str, action: str, resource: str) -> Decision:
        key = (self.version, who, action, resource)
        if key not in self.cache:
            reasons = []
            plain = all(len(r.heads) == 1 and r.heads[0].relation == "authorized" and not r.invents for r in self.policy)
            if plain:  # one evaluation and one job: each rule tells its number, bound to the question
                goal = (who, action, resource)
                told = []
                for i, r in enumerate(self.policy):
                    bound = self._bound(r, goal)
                    if bound is not None:
                        told.append(replace(bound, heads=(atom("reason", str(i)),)))
                got = fixpoint.evaluate(self.spark, told, self._facts(), ["reason"]).relation(("reason", "bare")) if told else None
                found = sorted({int(x["x1"]) for x in got.distinct().collect()}) if got is not None else []  # a row for a rule at the most
                reasons = [self.policy[i].label for i in found]
            else:
                got = self.authorized()
                if got is not None and got.where((F.col("x1") == who) & (F.col("x2") == action) & (F.col("x3") == resource)).limit(1).count():
                    reasons = ["the policy allows"]
            self.cache[key] = Decision(bool(reasons), tuple(reasons))
        return self.cache[key]

    @staticmethod
    def _bound(r: Rule, goal: tuple[str, ...]) -> Rule | None:
        """A rule with the question's constants put in; None if its head cannot be the question."""
        values: dict[str, Const] = {}
        for t, v in zip(r.heads[0].args, goal):
            if isinstance(t, Const) and t.value != v or isinstance(t, Var) and values.setdefault(t.name, Const(v)).value != v:
                return None

        def put(x):
            if isinstance(x, Not):
                return Not(put(x.atom))
            return replace(x, args=tuple(values.get(t.name, t) if isinstance(t, Var) else t for t in x.args))

        return replace(r, body=tuple(put(x) for x in r.body))

    def explain(self, who: str, action: str, resource: str) -> str:
        d = self.can(who, action, resource)
        return f"{who} may {action} {resource}: {'; '.join(d.reasons)}" if d.allowed else f"{who} may not {action} {resource}: no rule allows it"

    def allowed_fields(self, who: str, action: str, resource: str, fields: list[str]) -> list[str]:
        """Fields of a resource, themselves resources named ``resource.field``, that are allowed with it or alone."""
        asked = self.spark.createDataFrame([(who, action, f"{resource}.{f}") for f in fields] + [(who, action, resource)], "who string, action string, resource string")
        found = {r["resource"] for r in self.can_any(asked).collect()}
        return [f for f in fields if resource in found or f"{resource}.{f}" in found]
