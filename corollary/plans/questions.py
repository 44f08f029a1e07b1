"""Registered queries in the text language over bound tables, each with its SQL twin.

Where catalog.py writes plans by hand, these go the whole way: parsing, lowering, compilation to rules,
evaluation, and answers as tagged terms, which are brought back to plain values at the end.
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import proof, terms, verdict
from ..ir import RuleError
from ..kb import KB, Config, Incomplete
from ..language import parser, render
from ..scratch import shared_dir
from ..sources import rdf
from ..sources.tables import Tables
from ..vocab import Vocabulary
from .catalog import CLOSURE, query

WORDS = """client(who); order(key); customer(who, nation, segment); nation(key, name); country(key); lives(who, in); placed(who, order); priority(order, level); worth(order, amount);
part(key); size(part, number); parent(part, above); urgent(order); hasty(who); returned(order); balance(who, amount)"""


def base(spark: SparkSession, sf_dir: str, config: Config | None = None) -> KB:
    """A knowledge base whose relations are whole tables."""
    t = Tables(spark, sf_dir)
    kb = KB(spark, Vocabulary(open=True).declare(WORDS).alias("placed_by", "placed", 2), config)
    kb.bind("client", t.customer, "c_custkey").bind("order", t.orders, "o_orderkey").bind("customer", t.customer, "c_custkey", "c_nationkey", "c_mktsegment")
    kb.bind("nation", t.nation, "n_nationkey", "n_name").bind("country", t.nation, "n_nationkey").bind("placed", t.orders, "o_custkey", "o_orderkey").bind("priority", t.orders, "o_orderkey", "o_orderpriority")
    kb.bind("lives", t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_custkey", "n_name")
    kb.bind("worth", t.orders, "o_orderkey", "o_totalprice").bind("balance", t.customer, "c_custkey", "c_acctbal")
    kb.bind("part", t.part, "p_partkey").bind("size", t.part, "p_partkey", "p_size")
    kb.bind("parent", t.part.where("p_partkey > 1").withColumn("above", F.floor(F.col("p_partkey") / 2).cast("bigint")), "p_partkey", "above")
    kb.bind("returned", t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct(), "l_orderkey")
    kb.tell('all $o: priority($o, "1-URGENT") -> urgent($o). all $c, $o: placed($c, $o) & urgent($o) -> hasty($c).')
    return kb


def whole(column: str):
    """The whole number of a term."""
    return F.substring(column, 3, 64).cast("decimal(38,1)").cast("bigint")


def name(column: str):
    return F.substring(column, 3, 1 << 20)


def keys(found: DataFrame, column: str, shown: str = "key") -> DataFrame:
    return found.select(whole(column).alias(shown)).distinct()


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def verdicts(kb: KB, questions: list[str]) -> DataFrame:
    """One row for each question: its number and the verdict."""
    return table(kb.spark, [(i, str(kb.holds(q))) for i, q in enumerate(questions, 1)], "question int, verdict string")


def answered(*conditions: str) -> str:
    """SQL of the same, from boolean conditions."""
    return " UNION ALL ".join(f"SELECT {i}::INT AS question, CASE WHEN {c} THEN 'TRUE' ELSE 'FALSE' END AS verdict" for i, c in enumerate(conditions, 1))


HASTY = "(SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
HAS_R = "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


# -- operators and connectives
@query(f"SELECT o_orderkey AS key FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey IN {HAS_R}")
def text_implication(spark, sf_dir):
    return keys(base(spark, sf_dir).find("order($o) & (urgent($o) -> returned($o))"), "o")


@query(f"SELECT o_orderkey AS key FROM orders WHERE (o_orderpriority = '1-URGENT') = (o_orderkey IN {HAS_R})")
def text_equivalence(spark, sf_dir):
    return keys(base(spark, sf_dir).find("order($o) & (urgent($o) <-> returned($o))"), "o")


@query(f"SELECT o_orderkey AS key FROM orders WHERE (o_orderpriority = '1-URGENT') <> (o_orderkey IN {HAS_R})")
def text_exclusive_or(spark, sf_dir):
    return keys(base(spark, sf_dir).find("order($o) & (urgent($o) ^ returned($o))"), "o")


@query(f"SELECT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 200000 AND o_orderkey NOT IN {HAS_R}")
def text_disjunctive_rule(spark, sf_dir):
    """A disjunctive condition, split by the compiler; the ladder puts & before |."""
    kb = base(spark, sf_dir)
    kb.tell("all $o, $w: urgent($o) | worth($o, $w) & greater($w, 200000) & ~returned($o) -> watched($o).")
    return keys(kb.find("watched($o)"), "o")


# -- determiners, clauses, selectors
@query(f"SELECT c_custkey AS key FROM customer WHERE c_custkey IN {HASTY}")
def text_some_in_argument(spark, sf_dir):
    return keys(base(spark, sf_dir).find("client($c) & placed($c, some urgent)"), "c")


@query(answered(
    f"NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN {HASTY})", "EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000)", "NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice <= 1000)",
    "NOT EXISTS (SELECT 1 FROM part WHERE p_size > 50)", "(SELECT count(*) FROM part WHERE p_size = 50) = 7", "(SELECT count(*) FROM nation WHERE n_name = 'NATION_7') = 1",
    f"EXISTS (SELECT 1 FROM customer WHERE c_custkey IN {HASTY})", "NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < -500 AND c_mktsegment = 'BUILDING')",
))
def text_quantified_verdicts(spark, sf_dir):
    """Determiners as quantifiers, in arguments, in blocks and before claims."""
    kb = base(spark, sf_dir)
    kb.bind("poor", Tables(spark, sf_dir).customer.where("c_acctbal < -500"), "c_custkey")
    return verdicts(kb, [
        "hasty(every client)", "worth(some order, $w) & greater($w, 400000)", "all $o, $w: worth($o, $w) -> greater($w, 1000)", "no part $p: size($p, $n) & greater($n, 50)",
        "size(exactly 7 part, 50)", 'exactly 1 country $n: nation($n, "NATION_7")', "some client $c: hasty($c)", 'no client $c: customer($c, $n, "BUILDING") & poor($c)',
    ])


@query(f"SELECT c_custkey AS key FROM customer WHERE c_custkey IN {HASTY} AND c_acctbal >= 0")
def text_where_clause(spark, sf_dir):
    """A rule by description, with a restricting clause and a negated one."""
    kb = base(spark, sf_dir)
    kb.bind("indebted", Tables(spark, sf_dir).customer.where("c_acctbal < 0"), "c_custkey")
    kb.tell("served(every client where hasty where ~indebted).")
    return keys(kb.find("served($c)"), "c")


@query(f"SELECT c_custkey AS key FROM customer WHERE c_custkey IN {HASTY}")
def text_place_selector(spark, sf_dir):
    """What fills a place of a relation, by the place's label."""
    kb = base(spark, sf_dir)
    kb.vocabulary.declare("waits(at, who)")
    kb.tell("all $c: hasty($c) -> waits(who: $c). buyer(every waits.who).")
    return keys(kb.find("buyer($c)"), "c")


@query("SELECT c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def text_linked_arguments(spark, sf_dir):
    kb = base(spark, sf_dir)
    kb.tell('french(every lives(in: "NATION_7")).')
    return keys(kb.find("french($c)"), "c")


@query("SELECT o_orderkey AS key FROM orders WHERE o_custkey % 2 = 0")
def text_wildcard_terms(spark, sf_dir):
    """``?`` is any term, shown in a column of its own; a computed predicate reads the other place."""
    kb = base(spark, sf_dir)
    kb.external.register("even", lambda x: x % 2 == 0)
    return keys(kb.find("placed($c, ?) & even($c)"), "_1")


@query(answered("TRUE", "FALSE", "TRUE", "FALSE", "(SELECT count(*) FROM region) = 3", "FALSE"))
def text_definite_descriptions(spark, sf_dir):
    """``the`` names one thing that its description stands for; counted ``the`` ranges over what is known as such."""
    kb = base(spark, sf_dir)
    kb.bind("the_domain_area", Tables(spark, sf_dir).region, "r_regionkey")
    kb.tell("open(the office). large(every the area).")
    return verdicts(kb, ["open(the office)", "open(the shop)", "large(every the area)", "small(every the area)", "large(exactly 3 the area)", "office(the office)"])


# -- atoms (G6, G7, G8, G9, G10, G11, G14, P13, P14, P15)
@query("SELECT o_orderkey AS key, o_orderstatus AS status FROM orders")
def text_tense_and_modality(spark, sf_dir):
    """Facts of one flavor answer for it alone; a rule can tell one from another."""
    t = Tables(spark, sf_dir)
    kb = base(spark, sf_dir)
    for flavor, status in (("past", "F"), ("future", "O"), ("now", "P")):
        kb.bind("ships", t.orders.where(F.col("o_orderstatus") == status), "o_orderkey", flavor=flavor)
    kb.tell('all $o: past ships($o) -> marked($o, "F"). all $o: future ships($o) -> marked($o, "O"). all $o: now ships($o) -> marked($o, "P"). all $o: ships($o) -> marked($o, "?").')
    return kb.find("marked($o, $s)").select(whole("o").alias("key"), name("s").alias("status"))


@query(f"SELECT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN {HAS_R}")
def text_obligations(spark, sf_dir):
    """What must be done, derived; the bare and the permitted relation stay empty."""
    kb = base(spark, sf_dir)
    kb.tell("all $o: urgent($o) -> must ship($o). all $o: returned($o) -> may ship($o).")
    if kb.holds("ship(some order)"):
        raise AssertionError("an obligation is no fact")
    return keys(kb.find("must ship($o) & may ~ship($o)"), "o")


@query("SELECT o_custkey AS customer, o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'")
def text_labels_and_aliases(spark, sf_dir):
    """A converted alias and named places say the same as the relation itself."""
    found = base(spark, sf_dir).find("placed_by($o, $c) & placed(order: $o, who: $c) & urgent($o)")
    return found.select(whole("c").alias("customer"), whole("o").alias("key"))


@query("SELECT p_partkey AS key FROM part WHERE p_size > 40 AND p_retailprice > 910")
def text_paired_predicates(spark, sf_dir):
    """``big dear part`` is big, dear, a part, and all of it in one; asking for fewer of them finds it too."""
    t = Tables(spark, sf_dir)
    kb = base(spark, sf_dir)
    kb.bind("prized", t.part.where("p_retailprice > 910"), "p_partkey")
    kb.tell("all $p, $n: prized($p) & size($p, $n) & greater($n, 40) -> big dear part($p). all $p: prized($p) -> dear($p).")
    found = kb.find("dear part($p)").intersect(kb.find("[big dear] part($p)"))
    return keys(found, "p")


@query("SELECT c_custkey AS customer, o_orderkey AS key FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def text_tags(spark, sf_dir):
    """``via`` adds a relation from the tag's term to the claim's first place."""
    kb = base(spark, sf_dir)
    kb.tell('all $c, $n: customer($c, $n, "BUILDING") -> builder($c).')
    found = kb.find("order($o) via placed($c) & builder($c)")
    return found.select(whole("c").alias("customer"), whole("o").alias("key"))


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def text_abstractions(spark, sf_dir):
    """A claim as a term: equal only to the same claim, and not asserted by being mentioned."""
    kb = base(spark, sf_dir)
    kb.tell('all $c, $n: customer($c, $n, "BUILDING") -> bound_to($c, event { pays() }).')
    if kb.holds("bound_to($c, event { rests() })") or kb.holds("pays($c)"):
        raise AssertionError("an abstraction says nothing")
    return keys(kb.find("bound_to($c, event { pays() })"), "c")


@query("SELECT c_custkey AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_7', 'NATION_8')")
def text_compounds(spark, sf_dir):
    """A declared compound is a predicate of its own."""
    kb = base(spark, sf_dir)
    kb.vocabulary.declare("trade+partner(who, in)")
    kb.tell('all $c: lives($c, "NATION_7") -> trade+partner($c, "NATION_7"). all $c: lives($c, "NATION_8") -> trade+partner($c, "NATION_8").')
    return kb.find("trade+partner($c, $n)").select(whole("c").alias("customer"), name("n").alias("nation"))


# -- equality (G12, E1-E4) and the spelling of answers (A5)
@query("SELECT c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN ('NATION_7', 'NATION_8', 'NATION_9')")
def text_equality(spark, sf_dir):
    """Equal names are one, through rules and under negation."""
    kb = base(spark, sf_dir)
    kb.tell('"NATION_7" = "NATION_8". "NATION_8" = "NATION_9". all $c: lives($c, "NATION_7") -> ours($c).')
    return keys(kb.find("client($c) & ~ours($c)"), "c")


@query("SELECT 'c:NATION_8' AS a, 'c:NATION_7' AS b, 1::BIGINT AS step UNION ALL SELECT 'c:NATION_9', 'c:NATION_8', 2")
def equality_path(spark, sf_dir):
    """The chain of stated equations between two names of nations."""
    kb = base(spark, sf_dir)
    kb.tell('"NATION_8" = "NATION_7". "NATION_9" = "NATION_8". "NATION_2" = "NATION_3".')
    return table(spark, [(*pair, i) for i, pair in enumerate(kb.why_equal("c:NATION_7", "c:NATION_9"), 1)], "a string, b string, step long")


@query("SELECT 'c:west' AS who FROM region WHERE r_name = 'EUROPE'")
def asserted_spelling(spark, sf_dir):
    """A found term is shown as the facts spell it, not by the representative of its class."""
    kb = base(spark, sf_dir)
    kb.bind("region", Tables(spark, sf_dir).region, "r_name")
    kb.tell('grand(West). "EUROPE" = West.')
    return kb.find('grand($who) & region("EUROPE")').select("who")


# -- numbers
@query("SELECT o_orderkey * 10000019 AS number, o_orderkey AS key FROM orders WHERE o_orderkey < 200")
def bound_large_numbers(spark, sf_dir):
    """Numbers from 1e7 on, of a table and of text, whole and not, are one term each."""
    t = Tables(spark, sf_dir)
    kb = KB(spark)
    few = t.orders.where("o_orderkey < 200")
    kb.bind("numbered", few.select("o_orderkey", (F.col("o_orderkey") * 10000019).alias("n")), "o_orderkey", "n").bind("real", few.select("o_orderkey", (F.col("o_orderkey") * 10000019.0).alias("n")), "o_orderkey", "n")
    for key in [r["o_orderkey"] for r in few.select("o_orderkey").orderBy("o_orderkey").limit(3).collect()]:
        if not kb.holds(f"numbered({key}, {key * 10000019})") or not kb.holds(f"real({key}, {key * 10000019}.0)"):
            raise AssertionError("a number of the table is not found by text")
    return kb.find("numbered($k, $n) & real($k, $n)").select(whole("n").alias("number"), whole("k").alias("key"))


@query("SELECT 9007199254740992 + 2 * p_partkey AS number FROM part")
def bound_bigints(spark, sf_dir):
    """Whole numbers beyond 2**53 stay apart from their neighbours."""
    at = lambda shift: Tables(spark, sf_dir).part.select((F.lit(9007199254740992) + 2 * F.col("p_partkey") + shift).alias("n"))
    kb = KB(spark)
    kb.bind("even", at(0), "n").bind("odd", at(1), "n")
    return keys(kb.find("even($n) & ~odd($n)"), "n", "number")


@query("SELECT 1::INT AS question, 'UNKNOWN (non-finite)' AS verdict UNION ALL SELECT 2, 'UNKNOWN (non-finite)' UNION ALL SELECT 3, 'TRUE' UNION ALL SELECT 4, 'incomplete'")
def nonfinite_find(spark, sf_dir):
    """A comparison that a NaN leaves undecided gives no definite answer: not in a question, in a rule, or in a find."""
    t = Tables(spark, sf_dir)
    kb = KB(spark)
    rate = F.when(F.col("s_suppkey") == 1, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    kb.bind("rate", t.supplier.select("s_suppkey", rate.alias("r")), "s_suppkey", "r").bind("supplier", t.supplier, "s_suppkey")
    kb.tell("all $s, $r: rate($s, $r) & greater($r, 0) -> good($s).")
    rows = [(i, str(kb.holds(q))) for i, q in enumerate(["rate($s, $r) & greater($r, 100000)", "good(some supplier)", "rate(1, $r)"], 1)]
    try:
        rows.append((4, f"{kb.find('rate($s, $r) & less($r, 0)').count()} rows"))
    except Incomplete:
        rows.append((4, "incomplete"))
    return table(spark, rows, "question int, verdict string")


@query("SELECT p_partkey AS key, p_size AS size FROM part WHERE p_size IN (1, 4, 9, 16, 25, 36, 49)")
def text_computed_predicate(spark, sf_dir):
    """A Python backend, called in batches for distinct operands."""
    kb = base(spark, sf_dir)
    kb.external.register("square", batch=lambda rows: [round(r[0] ** 0.5) ** 2 == r[0] for r in rows])
    return kb.find("size($p, $n) & square($n)").select(whole("p").alias("key"), whole("n").alias("size"))


# -- rules (R8, R9, R12, R13, R17, R19), refusals
@query("SELECT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' AND EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_7')")
def text_ground_conditional(spark, sf_dir):
    """A rule without variables."""
    kb = base(spark, sf_dir)
    kb.tell('nation(7, "NATION_7") -> alarm("red"). nation(6, "NATION_5") -> alarm("blue"). all $o: urgent($o) & alarm("red") -> first($o). all $o: returned($o) & alarm("blue") -> first($o).')
    return keys(kb.find("first($o)"), "o")


@query("SELECT 'off' AS import, count(*) AS witnesses FROM region WHERE FALSE UNION ALL SELECT 'on', 1")
def existential_import(spark, sf_dir):
    """``every x`` assumes an x only where that is asked for."""
    out = []
    for on in (False, True):
        kb = base(spark, sf_dir, Config(existential_import=on))
        kb.tell("flies(every dragon).")
        out.append(("on" if on else "off", kb.find("flies($x)").count()))
    return table(spark, out, "import string, witnesses long")


@query(f"SELECT c_custkey AS key, c_custkey IN {HASTY} AS by_first FROM customer WHERE c_custkey IN {HASTY} OR c_mktsegment = 'BUILDING'")
def rule_settings(spark, sf_dir):
    """Priorities and forward flags choose the proof that is shown; what holds stays the same."""
    kb = base(spark, sf_dir)
    ids = kb.tell('all $c, $n: customer($c, $n, "BUILDING") -> chosen($c). all $c: hasty($c) -> chosen($c).')
    plain = kb.find("chosen($c)")
    kb.set_rule(ids[1], priority=9, forward=True)
    found = kb.find("chosen($c)")
    if plain.exceptAll(found).count() or found.exceptAll(plain).count():
        raise AssertionError("settings change no answer")
    return found.join(kb.find("hasty($c)").withColumn("h", F.lit(True)), "c", "left").select(whole("c").alias("key"), F.coalesce("h", F.lit(False)).alias("by_first"))


BUDGETS = ["TRUE", "RESOURCE_EXCEEDED (depth)", "RESOURCE_EXCEEDED (memory)", "TRUE"]


@query(" UNION ALL ".join(f"SELECT {i}::INT AS question, '{v}' AS verdict" for i, v in enumerate(BUDGETS, 1)))
def budgets(spark, sf_dir):
    """A bound on rounds or tuples makes an answer unknown, never partial; a bound question may need far fewer."""
    out = []
    for i, (config, question) in enumerate([(Config(), "reach(some part, 1)"), (Config(max_rounds=3), "reach(some part, $y) & size($y, 99)"), (Config(max_tuples=50), "reach($x, $y)"), (Config(max_tuples=50), "reach(100, 1)")], 1):
        kb = base(spark, sf_dir, config)
        kb.tell("all $x, $y: parent($x, $y) -> reach($x, $y). all $x, $y, $z: reach($x, $y) & parent($y, $z) -> reach($x, $z).")
        out.append((i, str(kb.holds(question))))
    return table(spark, out, "question int, verdict string")


@query(CLOSURE + "SELECT y AS above FROM r WHERE x = 77")
def text_bound_recursion(spark, sf_dir):
    """A constant of a text question reaches the recursion: only what lies above one part is derived."""
    kb = base(spark, sf_dir, Config(max_tuples=100))
    kb.tell("all $x, $y: parent($x, $y) -> reach($x, $y). all $x, $y, $z: parent($x, $y) & reach($y, $z) -> reach($x, $z).")
    return keys(kb.find("reach(77, $y)"), "y", "above")


REFUSED = (
    "greater(3, 2).", "all $x: client($x) & ~worse($x) -> worse($x).", "kept(exactly 2 client).", "past must kept(Ann).", "client($x) -> kept($x).", "kept(some).", "even(4).", "wanted(Ann).", "kept(where).", "size(1, 2, 3).", "a(A)", "all $x: ~client($x) -> kept($x).",
)


@query(" UNION ALL ".join("SELECT '" + s.replace("'", "''") + "' AS statement, TRUE AS refused" for s in REFUSED) + " UNION ALL SELECT 'kept(Ann).', FALSE")
def refusals(spark, sf_dir):
    """What cannot be told: computed claims, unstratifiable and unsafe rules, counts, two flavors, derived-only and reserved words, wrong places."""
    kb = base(spark, sf_dir)
    kb.external.register("even", lambda x: x % 2 == 0)
    kb.declare(derived=["wanted"])
    out = []
    for statement in (*REFUSED, "kept(Ann)."):
        before = len(kb.log)
        try:
            kb.tell(statement)
            out.append((statement, False))
        except RuleError:
            out.append((statement, True))
            if len(kb.log) != before:
                raise AssertionError("a refusal leaves a trace")
    return table(spark, out, "statement string, refused boolean")


@query("SELECT 'client' AS name, TRUE AS refused UNION ALL SELECT 'hasty', TRUE UNION ALL SELECT 'even', FALSE")
def guarded_registration(spark, sf_dir):
    """A backend cannot take over a relation that has facts, rules or a table."""
    kb, out = base(spark, sf_dir), []
    for relation in ("client", "hasty", "even"):
        try:
            kb.external.register(relation, lambda x: True)
            out.append((relation, False))
        except RuleError:
            out.append((relation, True))
    return table(spark, out, "name string, refused boolean")


@query("SELECT 'open' AS relation, FALSE AS refused UNION ALL SELECT 'shut', TRUE UNION ALL SELECT 'door', FALSE")
def closed_vocabulary(spark, sf_dir):
    """Once a relation is admitted, facts of others are refused."""
    kb, out = base(spark, sf_dir), []
    kb.declare(admits=["open", "door"])
    for relation in ("open", "shut", "door"):
        try:
            kb.tell_fact(relation, "x")
            out.append((relation, False))
        except RuleError:
            out.append((relation, True))
    return table(spark, out, "relation string, refused boolean")


# -- integrity
@query("""SELECT 'denied' AS kind, 'lives' AS label, concat('n:', c_custkey, '.0, c:', n_name) AS detail FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey <= 5
UNION ALL SELECT 'integrity', 'calm', concat('c=n:', c_custkey, '.0') FROM (SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < -500 AND o_orderpriority = '1-URGENT')
UNION ALL SELECT 'inequality', '3', 'c:NATION_7 = c:NATION_2' UNION ALL SELECT 'sort', 'hosts', '1: c:north'""")
def contradictions_all_kinds(spark, sf_dir):
    """Denied facts, broken constraints, names that are equal and differ, entities of the wrong sort, in one report."""
    t = Tables(spark, sf_dir)
    kb = base(spark, sf_dir)
    kb.bind("broke", t.customer.where("c_acctbal < -500"), "c_custkey")
    kb.register_constraint("broke($c) & hasty($c)", "calm")
    kb.tell('~("NATION_7" = "NATION_2"). "NATION_7" = "NATION_2".')
    kb.declare(sorts=[("city", "place")], entities={"North": "river", "South": "city"}, places={"hosts": ("place",)})
    kb.tell("hosts(North). hosts(South).")
    found = kb.violations()
    nations = {r["k"]: r["n"] for r in t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey <= 5").select(F.col("c_custkey").alias("k"), F.col("n_name").alias("n")).collect()}
    plain = base(spark, sf_dir)
    plain.tell(" ".join(f'~lives({k}, "{n}").' for k, n in sorted(nations.items())) + ' ~lives(1, "ATLANTIS").')
    return found.unionByName(plain.violations())


@query("SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def sort_violations(spark, sf_dir):
    """Each nation is of its region's sort; a place takes one region's nations, and sorts below it."""
    t = Tables(spark, sf_dir)
    kb = KB(spark)
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()  # the fixed 25 nations
    kb.declare(sorts=[("asia", "east"), ("europe", "west")], entities={r["n_name"]: r["r_name"].lower() for r in rows}, places={"visits": ("", "east")})
    for r in rows:
        kb.tell_fact("visits", "ann", terms.name(r["n_name"]))
    named = F.regexp_replace(F.regexp_replace("detail", "^2: c:", ""), " ", "_")
    return kb.violations().where("kind = 'sort'").select(F.upper(named).alias("nation"))


@query("SELECT 1::INT AS question, 'FALSE' AS verdict UNION ALL SELECT 2, 'refused' UNION ALL SELECT 3, 'refused' UNION ALL SELECT 4, 'TRUE'")
def inequality(spark, sf_dir):
    """In strict mode what is denied cannot be told, nor names that differ be made equal."""
    kb = base(spark, sf_dir, Config(strict=True))
    kb.tell('~closed("EUROPE"). ~("NATION_7" = "NATION_8").')
    out = [(1, str(kb.holds('closed("EUROPE")')))]
    for i, bad in ((2, 'closed("EUROPE").'), (3, '"NATION_7" = "NATION_9". "NATION_9" = "NATION_8".')):
        try:
            kb.tell(bad)
            out.append((i, "told"))
        except RuleError:
            out.append((i, "refused"))
    return table(spark, [*out, (4, str(kb.holds('~("NATION_7" = "NATION_8")')))], "question int, verdict string")


# -- belief, provenance, storage
@query(f"SELECT c_custkey AS key, c_custkey NOT IN {HASTY} AS assumed FROM customer WHERE c_custkey IN {HASTY} OR c_custkey = 7")
def assumed_facts(spark, sf_dir):
    """A copy with further statements; the knowledge base itself stays as it is."""
    kb = base(spark, sf_dir)
    more = kb.assuming("hasty(7).")
    own = kb.find("hasty($c)").withColumn("own", F.lit(True))
    return more.find("hasty($c)").join(own, "c", "left").select(whole("c").alias("key"), F.col("own").isNull().alias("assumed"))


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def retracted_rule(spark, sf_dir):
    """After a rule is retracted, what only it concluded is gone."""
    kb = base(spark, sf_dir)
    ids = kb.tell('all $c, $n: customer($c, $n, "BUILDING") -> picked($c). all $c: hasty($c) -> picked($c).')
    kb.find("picked($c)").count()
    kb.retract(ids[1])
    return keys(kb.find("picked($c)"), "c")


@query("SELECT unnest(['hasty', 'calm', 'reach', 'far']) AS relation, unnest([0, 1, 0, 1]) AS stratum, unnest([FALSE, FALSE, TRUE, FALSE]) AS recursive")
def stratification(spark, sf_dir):
    kb = base(spark, sf_dir)
    kb.tell("all $c: client($c) & ~hasty($c) -> calm($c). all $x, $y: parent($x, $y) -> reach($x, $y). all $x, $y, $z: reach($x, $y) & parent($y, $z) -> reach($x, $z). all $p: part($p) & ~reach($p, 2) -> far($p).")
    rows = [(r["relation"], r["stratum"], r["recursive"]) for r in kb.strata() if r["relation"] in ("hasty", "calm", "reach", "far")]
    return table(spark, rows, "relation string, stratum int, recursive boolean")


@query("""SELECT p_partkey AS part, floor(log2(p_partkey))::BIGINT AS rule_steps, floor(log2(p_partkey))::BIGINT AS table_steps, 0::BIGINT AS faults FROM part WHERE p_partkey IN (2, 12, 100, 150)
UNION ALL SELECT 0, 1, 1, 0""")
def certified_proofs(spark, sf_dir):
    """Steps of the proof that a part lies below the first one: a rule and an edge of the table for each level. Then a proof with an absence."""
    kb = base(spark, sf_dir)
    kb.tell("all $x, $y: parent($x, $y) -> reach($x, $y). all $x, $y, $z: reach($x, $y) & parent($y, $z) -> reach($x, $z). all $p: part($p) & ~reach($p, $p) -> sound($p).")
    out = []
    for part, claim in [*((p, f"reach({p}, 1)") for p in (2, 12, 100, 150)), (0, "sound(5)")]:
        text = proof.certify(kb, claim)
        kinds = [s["kind"] for s in json.loads(text)["steps"]]
        out.append((part, kinds.count("rule"), kinds.count("table"), len(proof.validate(text))))
    return table(spark, out, "part long, rule_steps long, table_steps long, faults long")


@query("SELECT unnest(['other fact', 'no premises', 'wrong premise', 'wrong rule', 'wrong flag', 'no absence', 'late premise', 'none']) AS forgery, unnest([TRUE, TRUE, TRUE, TRUE, TRUE, TRUE, TRUE, FALSE]) AS found")
def forged_proofs(spark, sf_dir):
    """Traces that were tampered with are found out without the knowledge base.

    The part is told by a name, which no key of a table is: no order of that key can be returned, however large the tables.
    """
    kb = base(spark, sf_dir)
    kb.tell("all $p: part($p) & ~returned($p) -> sound($p). all $p: sound($p) -> fine($p). part(Spare).")
    true = json.loads(proof.certify(kb, "fine(Spare)"))
    steps = true["steps"]
    last, rule = steps[-1], next(i for i, s in enumerate(steps) if s["kind"] == "rule")
    swapped = [{**s, "literal": ["+", "part", "bare", ["n:3.0"]]} if s["kind"] == "asserted" else s for s in steps]
    forged = {
        "other fact": {"claim": true["claim"], "verdict": "TRUE", "naf_dependent": False, "cwa_false": False, "steps": [{"kind": "asserted", "conclusion": "part(3)", "premises": [], "literal": ["+", "part", "bare", ["n:3.0"]]}]},
        "no premises": true | {"steps": [*steps[:-1], {**last, "premises": []}]},
        "wrong premise": true | {"steps": swapped},
        "wrong rule": true | {"steps": [*steps[:rule], {**steps[rule], "rule": {"heads": steps[rule]["rule"]["heads"], "body": []}, "premises": []}, *steps[rule + 1 :]]},
        "wrong flag": true | {"naf_dependent": False},
        "no absence": true | {"naf_dependent": False, "steps": [s if s["kind"] != "absent" else {**s, "kind": "asserted"} for s in steps]},
        "late premise": true | {"steps": [*steps[:-1], {**last, "premises": [len(steps) + 3]}]},
        "none": true,
    }
    return table(spark, [(k, bool(proof.validate(json.dumps(v)))) for k, v in forged.items()], "forgery string, found boolean")


@query("SELECT 'denied' AS why, 'FALSE' AS verdict, FALSE AS cwa_false UNION ALL SELECT 'unknown', 'FALSE', TRUE UNION ALL SELECT 'known', 'TRUE', FALSE")
def closed_world_flags(spark, sf_dir):
    """FALSE by a denial is told from FALSE for want of a proof."""
    kb = base(spark, sf_dir)
    kb.tell('~shut("EUROPE").')
    out = [(why, t.verdict, t.cwa_false) for why, t in (("denied", proof.explain(kb, 'shut("EUROPE")')), ("unknown", proof.explain(kb, 'shut("ASIA")')), ("known", proof.explain(kb, "client(1)")))]
    return table(spark, out, "why string, verdict string, cwa_false boolean")


STATEMENTS = [
    "urgent(every order where ~returned).", "all $x, $y: parent($x, $y) -> past reach($x, $y).", 'lives(1, "NATION_7") & ~client(2) | part(3) -> size(4, 2.5).', "worth(exactly 3 the order, _).", "must ship(some order also urgent).",
    'big [fast red] dog(Rex) via because("it \\"is\\"").', "bound_to(?, event { pays(slot) }).", "every placed.who $c: a($c) <-> b($c) ^ c($c).",
]


@query(" UNION ALL ".join("SELECT '" + s.replace("'", "''") + "' AS statement, TRUE AS same" for s in STATEMENTS))
def rendered_statements(spark, sf_dir):
    """Canonical text of a claim reads back as the same claim."""
    rows = []
    for s in STATEMENTS:
        tree = parser.parse_one(s)
        shown = render.claim(tree) + "."
        rows.append((s, parser.parse_one(shown) == tree and render.claim(parser.parse_one(shown)) + "." == shown))
    return table(spark, rows, "statement string, same boolean")


@query(f"SELECT c_custkey AS key, concat('it''s \"', n_name, '\" \\ ', c_custkey) AS note FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN {HASTY} AND c_custkey < 40")
def saved_and_loaded(spark, sf_dir):
    """A log with rules, facts of awkward text, declarations, constraints and retractions, saved twice and loaded: answers are the same."""
    t = Tables(spark, sf_dir)
    kb = base(spark, sf_dir)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey < 40").select("c_custkey", "n_name").orderBy("c_custkey").collect()
    for r in rows:
        kb.tell_fact("note", r["c_custkey"], f"it's \"{r['n_name']}\" \\ {r['c_custkey']}")
    kb.tell("all $c, $t: note($c, $t) & hasty($c) -> shown($c, $t). ghost(Ann).")
    kb.register_constraint("ghost($x) & client($x)", "no ghosts")
    kb.declare(derived=["shown"], sorts=[("dog", "animal")], entities={"Rex": "dog"}, places={"walks": ("animal",)})
    kb.set_rule(0, priority=3)
    kb.retract(len(kb.log) - 2)
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    kb.save(path)
    kb.tell("ghost(Bob).")
    kb.save(path)
    again = KB.load(spark, path)
    same = [(s.text, s.retracted, s.content) for s in kb.log] == [(s.text, s.retracted, s.content) for s in again.log]
    own = ("derived_only", "admitted", "sorts", "entity_sorts", "place_sorts", "settings", "registered")
    if not same or any(getattr(kb, x) != getattr(again, x) for x in own) or len(KB.load(spark, path, version=1).log) != len(kb.log) - 1:
        raise AssertionError("loading is not the inverse of saving")
    again.bound, again._model = kb.bound, None
    return again.find("shown($c, $t)").select(whole("c").alias("key"), name("t").alias("note"))


@query("SELECT 'lit(\"' || r_name || '\", ' || r_regionkey || ').' AS line FROM region")
def dumped_facts(spark, sf_dir):
    """Facts told by value, as statements; told again, they are the same facts."""
    kb = KB(spark)
    for r in Tables(spark, sf_dir).region.orderBy("r_regionkey").collect():  # the fixed five regions
        kb.tell_fact("lit", r["r_name"], r["r_regionkey"])
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    kb.dump(path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    again = KB(spark)
    again.run_file(path)
    if again.find("lit($x, $y)").exceptAll(kb.find("lit($x, $y)")).count() or again.count("lit($x, $y)") != 5:
        raise AssertionError("a dump does not tell the same")
    return lines


SCRIPT = """# facts and rules
lit("EUROPE").  /* a note
over two lines. */
glows(every lit
  where ~dim).
? glows("EUROPE").
:assume dim("EUROPE"). ; glows("EUROPE").
?? glows($x).
:retract 0
? glows("EUROPE").
p(A
"""


@query("""SELECT unnest([2, 4, 6, 7, 8, 9, 10, 11])::INT AS line, unnest(['tell', 'tell', 'query', 'assume', 'find', 'retract', 'query', 'refused']) AS kind,
unnest(['[0]', '[1]', 'TRUE', 'FALSE', '[{''x'': ''c:EUROPE''}]', 'ok', 'FALSE', '-']) AS result""")
def script_report(spark, sf_dir):
    """A script file with comments, statements over several lines, questions and commands."""
    path = f"{shared_dir(spark)}/script-{uuid.uuid4().hex}"
    spark.createDataFrame([(SCRIPT,)], "value string").coalesce(1).write.text(path)
    rows = KB(spark).run_file(path)
    return table(spark, [(r["line"], r["kind"], "-" if r["kind"] == "refused" else str(r["result"])) for r in rows], "line int, kind string, result string")


@query("""SELECT lower(n_name) AS nation, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def imported_ontology(spark, sf_dir):
    """Turtle with classes and subclasses into a knowledge base: sorts are unary relations, subsorts rules."""
    t = Tables(spark, sf_dir)
    iri = lambda c: F.concat(F.lit("<http://example.org/kb/"), F.regexp_replace(F.lower(c), " ", "_"), F.lit(">"))
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    typed = joined.select(F.concat(iri(F.col("n_name")), F.lit(" a "), F.concat(F.lit("<http://example.org/kb/"), F.regexp_replace(F.lower("r_name"), " ", "_"), F.lit("_state> .")))).union(joined.select(F.concat_ws(" ", iri(F.col("n_name")), F.lit("<http://example.org/kb/within>"), iri(F.col("r_name")), F.lit("."))))
    low = spark.createDataFrame([(f"<http://example.org/kb/{x}_state> <{rdf.SUBCLASS}> <http://example.org/kb/eurasian> .",) for x in ("asia", "europe")], "value string")
    path = f"{shared_dir(spark)}/owl-{uuid.uuid4().hex}"
    typed.toDF("value").union(low).write.text(path)
    kb = KB(spark).bind_triples(rdf.read_turtle(spark, path)[0])
    found = kb.find("eurasian($n) & within($n, $r)")
    return found.select(name("n").alias("nation"), F.regexp_replace(name("r"), "_", " ").alias("region"))


VALUES = ("TRUE", "FALSE", "UNKNOWN", "RESOURCE_EXCEEDED")


@query("""WITH v AS (SELECT unnest(['TRUE', 'FALSE', 'UNKNOWN', 'RESOURCE_EXCEEDED']) AS a) SELECT v.a, w.a AS b,
CASE WHEN 'FALSE' IN (v.a, w.a) THEN 'FALSE' WHEN 'RESOURCE_EXCEEDED' IN (v.a, w.a) THEN 'RESOURCE_EXCEEDED' WHEN 'UNKNOWN' IN (v.a, w.a) THEN 'UNKNOWN' ELSE 'TRUE' END AS both_hold,
CASE WHEN 'TRUE' IN (v.a, w.a) THEN 'TRUE' WHEN 'RESOURCE_EXCEEDED' IN (v.a, w.a) THEN 'RESOURCE_EXCEEDED' WHEN 'UNKNOWN' IN (v.a, w.a) THEN 'UNKNOWN' ELSE 'FALSE' END AS either_holds,
CASE v.a WHEN 'TRUE' THEN 'FALSE' WHEN 'FALSE' THEN 'TRUE' ELSE v.a END AS a_denied FROM v, v AS w""")
def verdict_algebra(spark, sf_dir):
    """How conjunction, disjunction and negation combine answers."""
    made = dict(zip(VALUES, (verdict.TRUE, verdict.FALSE, verdict.unknown("non-finite"), verdict.exceeded("depth"))))
    rows = [(a, b, verdict.both(made[a], made[b]).value, verdict.either(made[a], made[b]).value, verdict.negated(made[a]).value) for a, b in itertools.product(VALUES, repeat=2)]
    return table(spark, rows, "a string, b string, both_hold string, either_holds string, a_denied string")


@query("SELECT 'placed' AS relation, count(*) AS facts FROM orders UNION ALL SELECT 'hasty', count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT'")
def materialisation(spark, sf_dir):
    """What an evaluation holds, by the report of relations."""
    kb = base(spark, sf_dir)
    kb.holds("hasty($c)")
    model = kb.model({"hasty"})
    named = set(kb.report()["relations"])
    return table(spark, [(r, model.relation((r, "bare")).count()) for r in ("placed", "hasty") if r in named], "relation string, facts long")
