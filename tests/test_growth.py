"""What must not grow faster than the tables, and results on tables where that used to go wrong."""

import os

import pytest

from corollary.ir import atom, check, naf, rule
from corollary.kb import KB
from corollary.plans import bodies, catalog, fixpoint, questions
from corollary.vocab import Vocabulary

FOLDER = "/root/testdata/sf0.001"


def like(spark, tmp_path, **more):
    """A folder of the smallest tables; those named have further rows."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name in more:
            added = rows.limit(1).collect()[0].asDict() | more[name]
            rows = rows.unionByName(spark.createDataFrame([added], rows.schema)).coalesce(1)
            rows.write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            os.symlink(f"{FOLDER}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_forged_proofs_where_an_order_has_the_number_1000001(spark, tmp_path):
    folder = like(spark, tmp_path, part={"p_partkey": 1000001}, lineitem={"l_orderkey": 1000001, "l_returnflag": "R"})
    assert rows(questions.forged_proofs(spark, folder)) == rows(questions.forged_proofs(spark, FOLDER))


SAME = rule(atom("q", "$a", "$b"), atom("s", "$a", "$n"), atom("s", "$b", "$n"), check("equal", "$a", "$b", negated=True))
RICHER = rule(atom("q", "$a", "$b"), atom("s", "$a", "$n"), atom("s", "$b", "$n"), atom("o", "$a", "$x"), atom("o", "$b", "$y"), check("greater", "$x", "$y"))


@pytest.mark.parametrize("made", [SAME, RICHER])
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_joins_of_many_with_many_are_dealt_in_blocks(spark, monkeypatch, made, block):
    monkeypatch.setattr(bodies, "BLOCK", block)
    have = [(i, i % 3 if i < 20 else 7) for i in range(29)] + [(40, 9)]
    owed = {i: float(i * 7 % 11) for i, _ in have}
    facts = {("s", "bare"): spark.createDataFrame(have, "x1 long, x2 int"), ("o", "bare"): spark.createDataFrame(list(owed.items()), "x1 long, x2 double")}
    got = fixpoint.evaluate(spark, [made], facts, ["q"], keys={("s", "bare"): (1,), ("o", "bare"): (1,)}).distinct(("q", "bare"))
    want = [(a, b) for a, m in have for b, n in have if m == n and (a != b if made is SAME else owed[a] > owed[b])]
    assert rows(got) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("SortMergeJoin")]  # the pairs are the last join; nothing makes them distinct, and no other join reads them
    assert "Aggregate" not in last and "Join" not in last.replace("SortMergeJoin", "")


def test_a_supplier_number_that_stands_twice_gives_each_pair_once(spark, tmp_path):
    first = spark.read.parquet(f"{FOLDER}/supplier.parquet").first()
    folder = like(spark, tmp_path, supplier={"s_suppkey": first["s_suppkey"], "s_nationkey": first["s_nationkey"]})
    assert catalog.supplier_keys(spark, folder) == {} and catalog.supplier_keys(spark, FOLDER)
    for name in ("rule_theta_diff", "cmp_greater"):
        got = catalog.QUERIES[name](spark, folder)
        assert rows(got) == rows(catalog.QUERIES[name](spark, folder).distinct())
    assert rows(catalog.QUERIES["rule_theta_diff"](spark, folder)) == rows(catalog.QUERIES["rule_theta_diff"](spark, FOLDER))


LINEAR = [rule(atom("r", "$x", "$y"), atom("e", "$x", "$y")), rule(atom("r", "$x", "$z"), atom("r", "$x", "$y"), atom("e", "$y", "$z"))]


@pytest.mark.parametrize("few", [0, 4, 10_000])
def test_rounds_broadcast_nothing_but_small_deltas(spark, monkeypatch, few):
    monkeypatch.setattr(fixpoint, "FEW", few)
    monkeypatch.setattr(fixpoint, "SHARE", 2)
    plans, write = [], fixpoint.write_path

    def kept(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(fixpoint, "write_path", kept)
    edges = spark.createDataFrame([(i, i // 2) for i in range(2, 16)], "x1 long, x2 long")
    model = fixpoint.evaluate(spark, LINEAR, {("e", "bare"): edges}, ["r"])
    want = {(x, x >> k) for x in range(2, 16) for k in range(1, 4) if x >> k}
    assert rows(model.distinct(("r", "bare"))) == sorted(want)
    rounds = [p for p in plans if "Join" in p]
    sizes = [len({p for p in want if p[0].bit_length() - p[1].bit_length() == k}) for k in (1, 2, 3)]
    assert len(rounds) == 3
    for p, size in zip(rounds, sizes):
        assert ("leftHint=(strategy=broadcast)" in p) == (size <= few) and ("strategy=merge" in p) == (size > few) and "rightHint=(strategy=broadcast)" not in p
        assert "RepartitionByExpression" in p.split("Join")[0]


def test_requests_are_made_once_for_all_rules(spark):
    """What makes the requests is in no rule's plan, and answers stay the same."""
    for name in ("auth_can_requests", "auth_can_batch"):
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "leader" not in plan and "explode" not in plan.lower()


def test_tails_of_one_text_are_sent_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from corollary.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SENT", 3000)
    text = "".join(chr(97 + i * i % 26) for i in range(2000))
    starts = [{"key": i, "lo": i} for i in range(0, 1500, 10)]
    batch = pa.RecordBatch.from_pydict({"doc": [1], "tk": [2], "text": [text], "spans": [[{"lo": 0, "hi": 2000}]], "starts": [starts]})
    sent = [b.to_pylist() for b in suffix_dedup._tails(batch)]
    assert [(r["lo"], r["tail"]) for rows in sent for r in rows] == [(s["lo"], text[s["lo"] :].encode()) for s in starts]
    assert max(sum(len(r["tail"]) for r in rows) for rows in sent) <= 3000 + 2000


def told(spark, *facts):
    kb = KB(spark, Vocabulary(open=True).declare("p(a); q(a); e(a, b); r(a, b)"))
    for f in facts:
        kb.tell(f)
    return kb


FACTS = ("p(1).", "p(2).", "q(2).", "q(3).", "e(1, 2).", "e(2, 3).", "e(3, 1).", "e(4).", "r(1, 2).", "r(1, 3).", "r(2, 2).")


def test_universal_claims_read_the_relations_that_bind_them_not_the_domain(spark, monkeypatch):
    kb = told(spark, *FACTS)
    monkeypatch.setattr(KB, "domain", lambda *_: pytest.fail("every term of every table was read"))
    # a place left out is no individual: e(4) is no counterexample
    for claim, want in (("e($x, $y) -> p($y) | q($y)", "TRUE"), ("e($x, $y) -> q($y)", "FALSE"), ("r($x, $y) -> greater($y, 1)", "TRUE"), ("e($x, $y) -> greater($y, 1)", "FALSE")):
        assert str(kb.holds(f"all $x, $y: {claim}")) == want


def test_universal_claims_about_others_keep_their_complement(spark):
    kb = told(spark, *FACTS, "all $x: q($x) -> r($x, some p).")
    found = lambda text: rows(kb.find(text))
    n = lambda *values: tuple(f"n:{v}.0" if v else "u:" for v in values)
    assert found("all $x: e($u, $x) -> q($x)") == [n(1), n(2), n(4)]
    assert found("e($u, $v) & (all $x: e($u, $x) -> q($x))") == [n(1, 2), n(2, 3), n(4, 0)]
    assert found("e($u, $v) & ~(all $x, $y: r($u, $x) & e($x, $y) -> q($y))") == [n(1, 2)]  # r(1, 3) & e(3, 1), and 1 is no q
    assert found("all $x: all $y: e($x, $y) -> r($u, $x) | e($u, $y)") == [n(1)]


@pytest.mark.parametrize("share", [1, 5, 1_000_000])
@pytest.mark.parametrize("cases", [["+-", "-+"], ["--", "+-", "++"], ["+x", "-+"], ["+a", "-+"], ["--", "-+", "+-", "++"]])
def test_cases_of_one_rule_are_gathered_by_one_aggregation_dealt_by_rows(spark, tmp_path, monkeypatch, share, cases):
    monkeypatch.setattr(bodies, "GATHERED", share)
    have = {"o": [(i, i % 3) for i in range(20)], "a": [(i, i % 3) for i in range(0, 30, 2)], "b": [(i, j) for i in range(0, 30, 3) for j in (i % 3, 5)]}
    facts = {}
    for name, found in have.items():
        spark.createDataFrame(found + found[:4], "x1 long, x2 long").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")  # some rows stand there twice
        facts[name, "bare"] = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    # "x" is a relation without rows, "a" in the second place contradicts the first
    second = {"+": atom("b", "$y", "$z"), "-": naf("b", "$y", "$z"), "x": naf("nothing", "$y", "$z"), "a": naf("a", "$y", "$z")}
    first = {"+": atom("a", "$y", "$z"), "-": naf("a", "$y", "$z")}
    rules = [rule(atom("q", "$z", "$y"), atom("o", "$y", "$z"), first[c[0]], second[c[1]]) for c in cases]
    got = fixpoint.evaluate(spark, rules, facts, ["q"]).distinct(("q", "bare"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    sets = {n: set(v) for n, v in have.items()} | {"x": set()}
    member = lambda row, c: (row in sets["a"]) == (c[0] == "+") and {"+": row in sets["b"], "-": row not in sets["b"], "x": True, "a": row not in sets["a"]}[c[1]]
    assert rows(got) == sorted(r[::-1] for r in sets["o"] if any(member(r, c) for c in cases))
    read = sum(len(have[n]) + 4 for n in "oab" if n != "b" or any(c[1] in "+-" for c in cases))
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert share > 1 or f", {read + 1})" in plan


def test_cases_that_are_not_alike_are_joined(spark):
    facts = {("o", "bare"): spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "x1 long, x2 long"), ("a", "bare"): spark.createDataFrame([(1,)], "x1 int")}
    rules = [rule(atom("q", "$y"), atom("o", "$y", "$z"), naf("a", "$y")), rule(atom("q", "$y"), atom("o", "$y", "$z"), atom("a", "$z"), check("greater", "$y", 1))]
    assert rows(fixpoint.evaluate(spark, rules, facts, ["q"]).distinct(("q", "bare"))) == [(2,), (3,)]
    rules = [rule(atom("q", "$y"), atom("p", "$y"), naf("a", "$y")), rule(atom("q", "$y"), atom("p", "$y"), atom("a", "$y")), rule(atom("p", "$y"), atom("o", "$y", "$z"))]
    assert rows(fixpoint.evaluate(spark, rules, facts, ["q"]).distinct(("q", "bare"))) == [(1,), (2,), (3,)]  # long and int are one number


def test_implications_over_tables_stay_one_aggregation_each(spark):
    for name in ("implication_expand", "xor_expand", "iff_expand"):
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1


def test_cases_of_a_question_are_gathered(spark):
    kb = told(spark, *FACTS, "p(9).", "q(9).")
    n = lambda v: (f"n:{v}.0",)
    for claim, want in (("p($x) & (q($x) -> r($x, $x))", [n(1), n(2)]), ("p($x) & (q($x) <-> p($x))", [n(2), n(9)]), ("q($x) & (p($x) ^ ~q($x))", [n(2), n(9)])):
        assert rows(kb.find(claim)) == want
        assert "Join" not in kb.plan(claim)._jdf.queryExecution().executedPlan().toString()
