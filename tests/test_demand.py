"""Bound questions: what magic sets derive, against an independent evaluator, and how little of it; numbers, stores, scripts."""

import random

import pytest

from corollary import terms
from corollary.ir import Const, RuleError, atom, naf, rule
from corollary.kb import KB, Config
from corollary.plans import bodies, demand, fixpoint, strata
from naive import solve
from test_rules import program, tables


@pytest.mark.parametrize("seed", range(5))
def test_bound_goals_of_random_programs(spark, seed):
    rules, facts, last = program(seed)
    whole = solve(rules, facts, strata.levels(rules))
    rng = random.Random(seed)
    for name in ("r0", last):
        start = rng.choice("abcdef")
        for goal in (atom(name, start, "$y"), atom(name, "$x", start)):
            model = fixpoint.evaluate(spark, rules, tables(spark, facts), goals=[goal])
            source = model.lookup(goal)
            got = {tuple(r) for r in bodies.scan(goal, source)[0].distinct().collect()} if source is not None else set()
            place = 0 if isinstance(goal.args[0], Const) else 1
            assert got == {(row[1 - place],) for row in whole.get((name, "bare"), set()) if row[place] == start}, (name, start)


def test_only_the_cone_is_derived(spark):
    chains = {("e", "bare"): {(f"n{c}{i:02}", f"n{c}{i + 1:02}") for c in "abcd" for i in range(8)}}
    rules = [rule(atom("r", "$x", "$y"), atom("e", "$x", "$y")), rule(atom("r", "$x", "$z"), atom("e", "$x", "$y"), atom("r", "$y", "$z"))]
    whole = fixpoint.evaluate(spark, rules, tables(spark, chains))
    bound = fixpoint.evaluate(spark, rules, tables(spark, chains), goals=[atom("r", "na05", "$y")])
    count = lambda model: sum(model.derived(k).count() for k in model.paths if not k[0].startswith(demand.MARK))
    assert count(whole) == 4 * 36 and count(bound) == 6


def test_negation_stays_whole(spark):
    facts = {("e", "bare"): {("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")}, ("p", "bare"): {("a",), ("d",)}}
    rules = [rule(atom("r", "$x", "$y"), atom("e", "$x", "$y")), rule(atom("r", "$x", "$z"), atom("r", "$x", "$y"), atom("e", "$y", "$z")), rule(atom("q", "$x", "$y"), atom("r", "$x", "$y"), naf("r", "$y", "$x"))]
    goal = atom("q", "d", "$y")
    model = fixpoint.evaluate(spark, rules, tables(spark, facts), goals=[goal])
    assert [tuple(r) for r in bodies.scan(goal, model.lookup(goal))[0].collect()] == [("e",)]


def test_one_spelling_of_numbers(spark):
    values = [0.0, 1.5, -2.25, 0.001, 0.00025, 1e7, 12345678.5, 9007199254740991.0, 1e18, 3.0e-9, 250000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(terms.numbers(df["v"], "double")).collect()] == [terms.number(v) for v in values]
    whole = [0, -7, 10_000_000, 2**53 + 1, 2**62 + 3]
    df = spark.createDataFrame([(v,) for v in whole], "v bigint")
    assert [r[0] for r in df.select(terms.numbers(df["v"], "bigint")).collect()] == [terms.number(v) for v in whole]
    assert [terms.decode(terms.number(v)) for v in (*values, *whole)] == [*values, *whole]
    df = spark.sql("SELECT CAST(12.50 AS DECIMAL(10,2)) AS a, CAST(40 AS DECIMAL(10,2)) AS b, CAST(0.1 AS FLOAT) AS c")
    assert list(df.select(terms.numbers(df["a"], "decimal(10,2)"), terms.numbers(df["b"], "decimal(10,2)"), terms.numbers(df["c"], "float")).first()) == ["n:12.5", "n:40.0", "n:0.1"]
    with pytest.raises(ValueError):
        terms.number(float("nan"))


def test_denials_need_no_constraint(spark):
    strict = KB(spark, config=Config(strict=True))
    strict.tell("docked(Alba).")
    for bad in ("~docked(Alba).", "hull(Alba) & ~hull(Alba)."):
        with pytest.raises(RuleError, match="violates"):
            strict.tell(bad)
    assert len(strict.log) == 1
    lax = KB(spark)
    lax.tell("docked(Alba). ~docked(Alba).")
    assert len(lax.warnings) == 1


def test_cases_with_different_variables(spark):
    kb = KB(spark)
    kb.tell("rides(Ann, Bus). rides(Bob, Tram). old(Ann). red(Tram). red(Bus).")
    found = lambda q: sorted(tuple(r) for r in kb.find(q).select("x", "y").collect())
    assert found("rides($x, $y) & (old($x) | red($y))") == [("c:ann", "c:bus"), ("c:bob", "c:tram")]
    assert found("rides($x, $y) & ~(old($x) | ~red($y))") == [("c:bob", "c:tram")]
    assert str(kb.holds("all $x, $y: rides($x, $y) -> red($y)")) == "TRUE" and str(kb.holds("all $x, $y: rides($x, $y) -> old($x)")) == "FALSE"


def test_script_files_and_dumps(spark, tmp_path):
    kb = KB(spark)
    kb.tell_fact("said", "line \"one\" \\ two", 2)
    kb.tell_fact("said", "two\nlines", None)
    kb.dump(str(tmp_path / "dump"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "dump"), lineSep="\r").collect()]
    assert 'said("line \\"one\\" \\\\ two", 2).' in lines[0] and "#fact" in lines[0]
    (tmp_path / "script").write_text('p("a # b"). # note\n/* p(B).\n*/ q(every p\n where ~r).\n? q("a # b").\n:aggregate sum $n n($n)\n:wrong\n:rules\n')
    report = KB(spark).run_file(str(tmp_path / "script"))
    assert [(r["line"], r["kind"]) for r in report] == [(1, "tell"), (3, "tell"), (5, "query"), (6, "aggregate"), (7, "refused"), (8, "rules")]
    assert report[2]["result"] == "TRUE" and report[3]["result"] == {"value": None, "witnesses": 0}


def test_the_shell(spark, tmp_path, capsys):
    from corollary.__main__ import main

    (tmp_path / "script").write_text("boat(Alba).\n")
    main([str(tmp_path / "script")], ["floats(every boat).\n", "? floats(Alba).\n", "?? floats($x).\n", ":rules\n", "p(\n", ":quit\n", "? p(A).\n"])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "tell: [0]" and out[2] == "query: TRUE" and out[3] == "x = c:alba" and "floats" in out[4] and out[5].startswith("refused") and len(out) == 6
