"""Rule programs: plans against an independent evaluator, refusals, increments, limits."""

import random

import pytest

from corollary.functions import numeric
from corollary.ir import Rule, RuleError, atom, check, naf, rule
from corollary.operators import aggregates, constraints, equality
from corollary.plans import fixpoint, strata
from naive import solve


def tables(spark, facts):
    return {k: spark.createDataFrame(sorted(v), ", ".join(f"x{i} string" for i in range(1, len(next(iter(v))) + 1))) for k, v in facts.items() if v}


def program(seed):
    """A random stratified program: base relations, then derived ones that may negate lower ones."""
    rng = random.Random(seed)
    names = "abcdef"
    facts = {("e", "bare"): {(rng.choice(names), rng.choice(names)) for _ in range(7)}, ("p", "bare"): {(rng.choice(names),) for _ in range(3)}, ("p", "past"): {(rng.choice(names),) for _ in range(2)}}
    rules = [rule(atom("r0", "$x", "$y"), atom("e", "$x", "$y")), rule(atom("r0", "$x", "$z"), atom("r0", "$x", "$y"), atom(rng.choice(["e", "r0"]), "$y", "$z"))]
    lower = ["r0", "e"]
    for k in range(1, rng.randint(2, 4)):
        body = [atom(rng.choice(lower), "$x", "$y"), atom("p", rng.choice(["$x", "$y"]), flavor=rng.choice(["bare", "past"]))]
        if rng.random() < 0.7:
            body.append(naf(rng.choice(lower), rng.choice(["$y", "$x"]), rng.choice(["$x", "$any", "a"])))
        if rng.random() < 0.4:
            body.append(check("equal", "$x", "$y", negated=True))
        rules.append(rule(atom(f"r{k}", rng.choice(["$x", "$y"]), rng.choice(["$y", "b"])), *body))
        if rng.random() < 0.5:
            rules.append(rule(atom(f"r{k}", "$y", "$x"), atom(f"r{k}", "$x", "$z"), atom("e", "$z", "$y")))
        lower.append(f"r{k}")
    return rules, facts, lower[-1]


@pytest.mark.parametrize("seed", range(6))
def test_random_programs(spark, seed):
    rules, facts, last = program(seed)
    want = solve(rules, facts, strata.levels(rules))
    model = fixpoint.evaluate(spark, rules, tables(spark, facts), wanted=[last])
    got = model.relation((last, "bare"))
    assert ({tuple(r) for r in got.collect()} if got is not None else set()) == want.get((last, "bare"), set())


def test_repeated_variables_constants_and_heads(spark):
    facts = {("e", "bare"): {("a", "a"), ("a", "b"), ("c", "c")}}
    rules = [rule((atom("loop", "$x"), atom("tag", "$x", "t")), atom("e", "$x", "$x")), rule(atom("q", "$y"), atom("e", "a", "$y"))]
    model = fixpoint.evaluate(spark, rules, tables(spark, facts))
    rows = lambda n: sorted(tuple(r) for r in model.relation((n, "bare")).collect())
    assert rows("loop") == [("a",), ("c",)] and rows("tag") == [("a", "t"), ("c", "t")] and rows("q") == [("a",), ("b",)]


def test_refusals():
    with pytest.raises(RuleError, match="range-restricted"):
        rule(atom("q", "$x", "$y"), atom("p", "$x"))
    with pytest.raises(RuleError, match="range-restricted"):
        rule(atom("q", "$x"), atom("p", "$x"), check("less", "$x", "$z"))
    with pytest.raises(RuleError, match="unstratifiable"):
        strata.stratify([rule(atom("p", "$x"), atom("q", "$x"), naf("r", "$x")), rule(atom("r", "$x"), atom("p", "$x"))])


def test_demand_and_strata():
    rules = [rule(atom("b", "$x"), atom("a", "$x")), rule(atom("c", "$x"), atom("a", "$x"), naf("b", "$x")), rule(atom("d", "$x"), atom("z", "$x"))]
    assert strata.demanded(rules, ["c"]) == {"a", "b", "c"}
    assert strata.levels(rules)["c"] == 1 and strata.levels(rules)["b"] == 0


def test_limits(spark):
    chain = {("e", "bare"): {(f"n{i:02}", f"n{i + 1:02}") for i in range(12)}}
    rules = [rule(atom("r", "$x", "$y"), atom("e", "$x", "$y")), rule(atom("r", "$x", "$z"), atom("r", "$x", "$y"), atom("e", "$y", "$z"))]
    with pytest.raises(fixpoint.ResourceExceeded, match="depth"):
        fixpoint.evaluate(spark, rules, tables(spark, chain), limits=fixpoint.Limits(max_rounds=4))
    with pytest.raises(fixpoint.ResourceExceeded, match="memory"):
        fixpoint.evaluate(spark, rules, tables(spark, chain), limits=fixpoint.Limits(max_tuples=20))


def test_resume_equals_full_and_refuses_under_negation(spark):
    rules = [rule(atom("r", "$x", "$y"), atom("e", "$x", "$y")), rule(atom("r", "$x", "$z"), atom("r", "$x", "$y"), atom("r", "$y", "$z")), rule(atom("two", "$x"), atom("r", "$x", "$y"), atom("r", "$y", "$x"))]
    edges = {("a", "b"), ("b", "c"), ("d", "a"), ("c", "d"), ("x", "y")}
    first, rest = {("a", "b"), ("c", "d"), ("x", "y")}, {("b", "c"), ("d", "a"), ("a", "b")}
    part = fixpoint.evaluate(spark, rules, tables(spark, {("e", "bare"): first}))
    before = part.relation(("r", "bare")).count()
    grown = fixpoint.resume(part, ("e", "bare"), tables(spark, {("e", "bare"): rest})["e", "bare"])
    want = solve(rules, {("e", "bare"): edges}, strata.levels(rules))
    for name in ("r", "two"):
        assert {tuple(r) for r in grown.relation((name, "bare")).collect()} == want[name, "bare"]
    assert part.relation(("r", "bare")).count() == before
    guarded = [*rules, rule(atom("end", "$y"), atom("e", "$x", "$y"), naf("r", "$y", "$z"))]
    with pytest.raises(RuleError, match="evaluate again"):
        fixpoint.resume(fixpoint.evaluate(spark, guarded, tables(spark, {("e", "bare"): first})), ("e", "bare"), tables(spark, {("e", "bare"): rest})["e", "bare"])


def test_invented_terms(spark):
    facts = tables(spark, {("p", "bare"): {("a",), ("b",)}})
    made = Rule((atom("child", "$x", "$k"), atom("person", "$k")), (atom("p", "$x"),), invents=("k",))
    model = fixpoint.evaluate(spark, [made], facts)
    rows = model.relation(("child", "bare")).collect()
    assert len({r["x2"] for r in rows}) == 2 and all(r["x2"].startswith("k:") for r in rows)
    assert {r["x1"] for r in model.relation(("person", "bare")).collect()} == {r["x2"] for r in rows}
    with pytest.raises(RuleError, match="invents"):
        fixpoint.evaluate(spark, [Rule((atom("p", "$k"),), (atom("p", "$x"),), invents=("k",))], facts)


def test_numbers(spark):
    inf, nan = float("inf"), float("nan")
    cases = [("sum", 1.1, 0.4, 0.7), ("sum", 9.0, 4.0, 4.0), ("product", 35.0, 5.0, 7.0), ("quotient", 8.0, 5.0, 0.0), ("quotient", 2.5, 20.0, 8.0), ("product", 1.0, 1e308, 1e308), ("sum", inf, 1.0, 2.0), ("quotient", nan, 1.0, 0.0)]
    want = [True, False, True, False, True, None, None, None]
    assert [numeric.decide(op, list(v)) for op, *v in cases] == want
    from pyspark.sql import functions as F

    for (op, *v), w in zip(cases, want):
        assert spark.range(1).select(numeric.computed(op, *map(F.lit, v))).first()[0] == w
    assert numeric.decide("greater", [7, 4]) is True and numeric.decide("num_equal", [7, 4]) is False and numeric.decide("less", [nan, 2.0]) is None
    assert numeric.decide("exponential", [243, 3, 5]) and numeric.decide("logarithm", [4, 81, 3]) and numeric.decide("logarithm", [4, -81, 3]) is None
    with pytest.raises(TypeError):
        numeric.decide("greater", ["a", 2])


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("c", 2.5)], "k string, v double")
    assert aggregates.aggregate(df, "v", "sum") == aggregates.Aggregate(6.5, 3)
    assert aggregates.aggregate(df.limit(0), "v", "avg") == aggregates.Aggregate(None, 0)
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(aggregates.AggregateError):
            aggregates.aggregate(df.unionByName(spark.createDataFrame([("d", bad)], df.schema)), "v", "max")
    with pytest.raises(aggregates.AggregateError, match="overflows"):
        aggregates.aggregate(spark.createDataFrame([("a", 1e308), ("b", 1e308)], df.schema), "v", "sum")


@pytest.mark.parametrize("driver_edges", [100_000, 0])
def test_equality(spark, driver_edges):
    pairs = [("b", "a"), ("c", "b"), ("y", "x"), ("q", "q")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(9)]
    got = {tuple(r) for r in equality.canon(spark.createDataFrame(pairs, "x1 string, x2 string"), driver_edges).collect()}
    assert got == {(t, r) for t, r in equality.classes(pairs).items() if t != "q"}
    assert equality.path(pairs, "a", "c") == [("b", "a"), ("c", "b")] and equality.path(pairs, "a", "x") is None


def test_constraints(spark):
    have = tables(spark, {("p", "bare"): {("a",), ("b",)}, ("q", "bare"): {("b",)}})
    denied = tables(spark, {("r", "bare"): {("b",)}, ("s", "bare"): {("a",), ("b",)}})
    both = constraints.Constraint("pq", (atom("p", "$x"), atom("q", "$x")))
    assert [tuple(r) for r in constraints.violations(both, lambda a: have.get(a.key)).collect()] == [("integrity", "pq", "x=b")]
    cases = constraints.Constraint("rs", (atom("p", "$x"),), (atom("r", "$x"), atom("s", "$x")))
    assert [tuple(r) for r in constraints.violations(cases, lambda a: have.get(a.key), lambda a: denied.get(a.key)).collect()] == [("disjunction", "rs", "x=b")]


def test_plans_are_joins_and_pushed_filters(spark):
    from corollary.plans import catalog

    text = catalog.QUERIES["naf_flat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "LeftAnti" in text and "CartesianProduct" not in text and "Python" not in text
    text = catalog.QUERIES["atom_select"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in text.replace("IsNotNull(c_custkey), ", "").replace("IsNotNull(c_nationkey), ", "") or "EqualTo(c_mktsegment,BUILDING)" in text
    assert "c_name" not in text
