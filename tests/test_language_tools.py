"""Lints, and rule programs as SQL against the plans and an independent evaluator."""

import duckdb
import pytest

from corollary.ir import RuleError, atom, check, naf, rule
from corollary.language.lint import Linter
from corollary.plans import catalog, sql, strata
from corollary.vocab import Vocabulary
from naive import solve
from test_rules import program


def codes(text, **state):
    return [n.code for n in Linter(**state).lint(text)]


@pytest.mark.parametrize("text,want", [
    ("open(the gate).", ["L1"]), ("wide(some gate). open(the gate).", []), ("late(every ship where old slow).", ["L2"]), ("late(every ship where old also slow).", []),
    ("tows(every tug, some ship).", ["L3"]), ("tows(Ann, some ship).", []), ("every ship $s: early($s) | late($s).", ["L5"]), ("all $s: ship($s) -> late($s).", []),
    ("past ~late(Ann).", ["L6"]), ("must go(Ann). obliged(Ann).", ["L7"]), ("Ann = Bob where old.", ["L8"]), ("size(Ann, 2 .5).", None), ("p(A). p(B).", []),
    ("dock+master(Ann). dock+master(Bob).", ["L4"]),
])
def test_lints(text, want):
    if want is None:
        with pytest.raises(RuleError):
            codes(text)
        assert [n.code for n in Linter().lint("p(2) . p(A).")] == []
        return
    assert codes(text) == want


def test_lints_of_aliases_and_split_numbers():
    words = Vocabulary(open=True).declare("tows(who, what)").alias("towed_by", "tows", 2)
    assert codes("towed_by(Ann, Bob). towed_by(Bob, Ann).", vocabulary=words) == ["L4"]
    assert codes('p(A) & A = 2 .p(B).', vocabulary=Vocabulary(open=True)) == []


def duck(facts):
    con, tables = duckdb.connect(), {}
    for n, (key, rows) in enumerate(sorted(facts.items())):
        width = len(next(iter(rows)))
        con.sql(f"CREATE TABLE f{n} ({', '.join(f'x{i} VARCHAR' for i in range(1, width + 1))})")
        con.executemany(f"INSERT INTO f{n} VALUES ({', '.join('?' * width)})", sorted(rows))
        tables[key] = f"SELECT DISTINCT * FROM f{n}"
    return con, tables


@pytest.mark.parametrize("seed", range(12))
def test_programs_as_sql(seed):
    rules, facts, last = program(seed)
    want = solve(rules, facts, strata.levels(rules)).get((last, "bare"), set())
    con, tables = duck(facts)
    try:
        text = sql.program_sql(rules, tables, atom(last, "$a", "$b"))
    except RuleError as e:
        assert "no SQL" in str(e)
        return
    assert {tuple(r) for r in con.sql(text).fetchall()} == want


def test_conditions_constants_and_refusals_as_sql():
    con = duckdb.connect()
    tables = {("n", "bare"): "SELECT unnest([1, 2, 3, 4, 6]) AS x1", ("m", "bare"): "SELECT unnest([2, 6]) AS x1"}
    rules = [rule(atom("twice", "$x", "$y"), atom("n", "$x"), atom("n", "$y"), check("product", "$y", "$x", 2)), rule(atom("odd", "$x"), atom("n", "$x"), naf("m", "$x"), check("greater", "$x", 1))]
    run = lambda goal: sorted(con.sql(sql.program_sql(rules, tables, goal)).fetchall())
    assert run(atom("twice", "$x", "$y")) == [(1, 2), (2, 4), (3, 6)] and run(atom("twice", 3, "$y")) == [(6,)] and run(atom("odd", "$x")) == [(3,), (4,)]
    assert run(atom("twice", 4, "$y")) == [] and run(atom("missing", "$z")) == []
    with pytest.raises(RuleError, match="twice"):
        sql.program_sql([catalog.LINEAR[0], rule(atom("reach", "$x", "$z"), atom("reach", "$x", "$y"), atom("reach", "$y", "$z"))], {("parent", "bare"): "SELECT 1 AS x1, 2 AS x2"}, atom("reach", "$x", "$y"))


def test_a_catalog_program_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    text = sql.program_sql(catalog.LINEAR, {("parent", "bare"): f"SELECT p_partkey AS x1, p_partkey // 2 AS x2 FROM '{folder}/part.parquet' WHERE p_partkey > 1"}, atom("reach", 100, "$above"))
    assert sorted(duckdb.sql(text).fetchall()) == sorted(tuple(r) for r in catalog.QUERIES["bound_closure"](spark, folder).collect())
