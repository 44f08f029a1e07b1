"""Registered queries over the driver's tables, each with its SQL twin.

Every query is a rule program over relations bound to whole tables. Relations chosen so that each
operator has something to get wrong: negations that are not empty, closures that are not complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..auth import Authorizer
from ..ir import Rule, atom, check, naf, rule
from ..kb import KB
from ..operators import aggregates, constraints, equality
from ..scratch import shared_dir
from ..sources import rdf
from ..sources.tables import Tables, relation
from ..streaming.feed import Feed
from ..vocab import Vocabulary
from . import bodies, fixpoint

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def facts(t: Tables) -> dict:
    """Relations of the tables. Places that hold a table's key need no distinct."""
    part = F.col("p_partkey")
    return {
        ("nation_in", "bare"): relation(t.nation, "n_nationkey", "n_regionkey", distinct=False),
        ("region", "bare"): relation(t.region, "r_regionkey", "r_name", distinct=False),
        ("nation", "bare"): relation(t.nation, "n_nationkey", "n_name", distinct=False),
        ("customer", "bare"): relation(t.customer, "c_custkey", "c_nationkey", "c_mktsegment", distinct=False),
        ("balance", "bare"): relation(t.customer, "c_custkey", "c_acctbal", distinct=False),
        ("supplier", "bare"): relation(t.supplier, "s_suppkey", "s_nationkey", distinct=False),
        ("owed", "bare"): relation(t.supplier, "s_suppkey", "s_acctbal", distinct=False),
        ("order", "bare"): relation(t.orders, "o_orderkey", distinct=False),
        ("placed", "bare"): relation(t.orders, "o_custkey", "o_orderkey", distinct=False),
        ("priority", "bare"): relation(t.orders, "o_orderkey", "o_orderpriority", distinct=False),
        ("status", "bare"): relation(t.orders, "o_orderkey", "o_orderstatus", distinct=False),
        ("worth", "bare"): relation(t.orders, "o_orderkey", "o_totalprice", distinct=False),
        ("contains", "bare"): relation(t.lineitem, "l_orderkey", "l_partkey"),
        ("supplies", "bare"): relation(t.lineitem, "l_suppkey", "l_partkey"),
        ("flag", "bare"): relation(t.lineitem, "l_orderkey", "l_returnflag"),
        ("line", "bare"): relation(t.lineitem, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
        ("part", "bare"): relation(t.part, "p_partkey", distinct=False),
        ("size", "bare"): relation(t.part, "p_partkey", "p_size", distinct=False),
        ("brand", "bare"): relation(t.part, "p_partkey", "p_brand", distinct=False),
        ("type", "bare"): relation(t.part, "p_partkey", "p_type", distinct=False),
        ("price", "bare"): relation(t.part, "p_partkey", "p_retailprice", distinct=False),
        # a synthetic tree over the part keys: each part above 1 belongs to the part of half its number
        ("parent", "bare"): relation(t.part.where(part > 1), "p_partkey", F.floor(part / 2).cast("bigint"), distinct=False),
    }


def solved(spark: SparkSession, sf_dir: str, rules: list[Rule], name: str, columns: list[str], more: dict | None = None, flavor: str = "bare", keys: dict | None = None) -> DataFrame:
    """The relation ``name`` of the program's model, its places renamed."""
    model = fixpoint.evaluate(spark, rules, facts(Tables(spark, sf_dir)) | (more or {}), wanted=[name], keys=keys)
    return model.distinct((name, flavor)).toDF(*columns)


def supplier_keys(spark: SparkSession, sf_dir: str) -> dict:
    """The key of the suppliers' relations, looked up in the table: none if a number stands there twice."""
    number = relation(Tables(spark, sf_dir).supplier, "s_suppkey", distinct=False)
    if number.groupBy("x1").count().where("count > 1").limit(1).count():
        return {}
    return {("supplier", "bare"): (1,), ("owed", "bare"): (1,)}


def lookup_of(spark: SparkSession, sf_dir: str):
    known = facts(Tables(spark, sf_dir))
    return lambda a: known.get(a.key)


TREE = "SELECT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey > 1"


@query("SELECT DISTINCT c_custkey AS customer, c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING'")
def atom_select(spark, sf_dir):
    return solved(spark, sf_dir, [rule(atom("q", "$c", "$n"), atom("customer", "$c", "$n", "BUILDING"))], "q", ["customer", "nation"])


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey = l_partkey")
def atom_repeated_var(spark, sf_dir):
    return solved(spark, sf_dir, [rule(atom("q", "$k"), atom("contains", "$k", "$k"))], "q", ["key"])


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 1 AND o_orderkey = 1) AS found, EXISTS (SELECT 1 FROM region WHERE r_regionkey = 1) AS region_found")
def point_lookup(spark, sf_dir):
    t = facts(Tables(spark, sf_dir))
    one = t["placed", "bare"].where("x1 = 1 AND x2 = 1").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
    two = t["region", "bare"].where("x1 = 1").limit(1).agg((F.count(F.lit(1)) > 0).alias("region_found"))
    return one.crossJoin(two)


@query("SELECT DISTINCT o_orderkey AS key, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def rule_join2(spark, sf_dir):
    return solved(spark, sf_dir, [rule(atom("q", "$o", "$m"), atom("placed", "$c", "$o"), atom("customer", "$c", "$n", "$s"), atom("nation", "$n", "$m"))], "q", ["key", "nation"])


@query("""SELECT DISTINCT c_custkey AS customer, s_suppkey AS supplier FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey""")
def rule_join4(spark, sf_dir):
    body = (atom("customer", "$c", "$n", "$g"), atom("placed", "$c", "$o"), atom("ships", "$o", "$s"), atom("supplier", "$s", "$n"))
    more = {("ships", "bare"): relation(Tables(spark, sf_dir).lineitem, "l_orderkey", "l_suppkey")}
    return solved(spark, sf_dir, [rule(atom("q", "$c", "$s"), *body)], "q", ["customer", "supplier"], more)


@query("""SELECT DISTINCT n_nationkey AS id, 'nation' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
UNION SELECT DISTINCT r_regionkey, 'region' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def rule_multi_head(spark, sf_dir):
    r = rule((atom("q", "$n", "nation"), atom("q", "$r", "region")), atom("nation_in", "$n", "$r"), atom("region", "$r", "ASIA"))
    return solved(spark, sf_dir, [r], "q", ["id", "kind"])


@query("SELECT DISTINCT r_name AS region, p_brand AS brand FROM region, part")
def rule_cross(spark, sf_dir):
    return solved(spark, sf_dir, [rule(atom("q", "$r", "$b"), atom("region", "$k", "$r"), atom("made", "$b"))] + [rule(atom("made", "$b"), atom("brand", "$p", "$b"))], "q", ["region", "brand"])


@query("SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey")
def rule_theta_diff(spark, sf_dir):
    r = rule(atom("q", "$a", "$b"), atom("supplier", "$a", "$n"), atom("supplier", "$b", "$n"), check("equal", "$a", "$b", negated=True))
    return solved(spark, sf_dir, [r], "q", ["a", "b"], keys=supplier_keys(spark, sf_dir))


@query("SELECT DISTINCT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_regionkey = 1 AND b.n_regionkey = 2")
def double_universal(spark, sf_dir):
    return solved(spark, sf_dir, [rule(atom("q", "$a", "$b"), atom("nation_in", "$a", 1), atom("nation_in", "$b", 2))], "q", ["a", "b"])


@query("SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def naf_flat(spark, sf_dir):
    rules = [rule(atom("filled", "$o"), atom("contains", "$o", "$p")), rule(atom("q", "$o"), atom("order", "$o"), naf("filled", "$o"))]
    return solved(spark, sf_dir, rules, "q", ["key"])


@query("""SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def naf_restrictor(spark, sf_dir):
    rules = [rule(atom("urgent", "$c"), atom("placed", "$c", "$o"), atom("priority", "$o", "1-URGENT")), rule(atom("q", "$c"), atom("customer", "$c", "$n", "$s"), naf("urgent", "$c"))]
    return solved(spark, sf_dir, rules, "q", ["customer"])


@query("""SELECT n_name AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))""")
def naf_two_strata(spark, sf_dir):
    rules = [
        rule(atom("urgent", "$c"), atom("placed", "$c", "$o"), atom("priority", "$o", "1-URGENT")),
        rule(atom("calm", "$n"), atom("customer", "$c", "$n", "BUILDING"), naf("urgent", "$c")),
        rule(atom("q", "$m"), atom("nation", "$n", "$m"), naf("calm", "$n")),
    ]
    return solved(spark, sf_dir, rules, "q", ["nation"])


@query("SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, sf_dir):
    known = facts(Tables(spark, sf_dir))
    got, names = bodies.conjunction((atom("placed", "$c", "$o"), atom("worth", "$o", "$w"), check("greater", "$w", 300000.0)), lambda a: known.get(a.key))
    return known["customer", "bare"].join(got, F.col("x1") == F.col(names["c"]), "left_semi").select(F.col("x1").alias("customer"))


@query("""SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < -900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000""")
def union_rules(spark, sf_dir):
    rules = [
        rule(atom("q", "$n"), atom("customer", "$c", "$n", "$g"), atom("balance", "$c", "$b"), check("less", "$b", -900.0)),
        rule(atom("q", "$n"), atom("supplier", "$s", "$n"), atom("owed", "$s", "$b"), check("greater", "$b", 9000.0)),
    ]
    return solved(spark, sf_dir, rules, "q", ["nation"])


@query("""SELECT o_orderkey AS key, 'urgent' AS why FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT DISTINCT l_orderkey, 'returned' FROM lineitem WHERE l_returnflag = 'R'""")
def or_find(spark, sf_dir):
    rules = [rule(atom("q", "$o", "urgent"), atom("priority", "$o", "1-URGENT")), rule(atom("q", "$o", "returned"), atom("flag", "$o", "R"))]
    return solved(spark, sf_dir, rules, "q", ["key", "why"])


@query("SELECT o_orderkey AS key, o_custkey AS customer FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def and_find(spark, sf_dir):
    body = (atom("placed", "$c", "$o"), atom("priority", "$o", "1-URGENT"), atom("flag", "$o", "R"))
    return solved(spark, sf_dir, [rule(atom("q", "$o", "$c"), *body)], "q", ["key", "customer"])


@query("SELECT p_partkey AS part FROM part WHERE p_size > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def except_find(spark, sf_dir):
    more = {("big_return", "bare"): relation(Tables(spark, sf_dir).lineitem.where("l_returnflag = 'R' AND l_quantity > 40"), "l_partkey")}
    return solved(spark, sf_dir, [rule(atom("q", "$p"), atom("size", "$p", "$s"), check("greater", "$s", 40), naf("big_return", "$p"))], "q", ["part"], more)


CLOSURE = f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) "
LINEAR = [rule(atom("reach", "$x", "$y"), atom("parent", "$x", "$y")), rule(atom("reach", "$x", "$z"), atom("reach", "$x", "$y"), atom("parent", "$y", "$z"))]


@query(CLOSURE + "SELECT x AS part, y AS above FROM r")
def closure_linear(spark, sf_dir):
    return solved(spark, sf_dir, LINEAR, "reach", ["part", "above"])


@query(CLOSURE + "SELECT x AS part, y AS above FROM r")
def closure_nonlinear(spark, sf_dir):
    rules = [LINEAR[0], rule(atom("reach", "$x", "$z"), atom("reach", "$x", "$y"), atom("reach", "$y", "$z"))]
    return solved(spark, sf_dir, rules, "reach", ["part", "above"])


@query(f"""WITH RECURSIVE e AS ({TREE}), r AS (SELECT x, y, 1 AS odd FROM e UNION SELECT r.x, e.y, 1 - r.odd FROM r JOIN e ON r.y = e.x)
SELECT x AS part, y AS above, CASE WHEN odd = 1 THEN 'odd' ELSE 'even' END AS steps FROM r""")
def mutual_recursion(spark, sf_dir):
    rules = [
        rule(atom("odd", "$x", "$y"), atom("parent", "$x", "$y")),
        rule(atom("even", "$x", "$z"), atom("odd", "$x", "$y"), atom("parent", "$y", "$z")),
        rule(atom("odd", "$x", "$z"), atom("even", "$x", "$y"), atom("parent", "$y", "$z")),
        rule(atom("q", "$x", "$y", "odd"), atom("odd", "$x", "$y")),
        rule(atom("q", "$x", "$y", "even"), atom("even", "$x", "$y")),
    ]
    return solved(spark, sf_dir, rules, "q", ["part", "above", "steps"])


@query(CLOSURE + """, b AS (SELECT DISTINCT r.x FROM r JOIN part ON r.y = p_partkey WHERE p_size >= 45)
SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT x FROM b)""")
def naf_over_recursion(spark, sf_dir):
    rules = LINEAR + [
        rule(atom("blocked", "$x"), atom("reach", "$x", "$y"), atom("size", "$y", "$s"), check("less", "$s", 45, negated=True)),
        rule(atom("free", "$x"), atom("part", "$x"), naf("blocked", "$x")),
    ]
    return solved(spark, sf_dir, rules, "free", ["part"])


@query(CLOSURE + "SELECT y AS above FROM r WHERE x = 100")
def bound_closure(spark, sf_dir):
    """A closure asked for one start: the constant reaches the recursion, so only its cone is derived."""
    goal = atom("reach", 100, "$y")
    model = fixpoint.evaluate(spark, LINEAR, facts(Tables(spark, sf_dir)), goals=[goal])
    return bodies.scan(goal, model.lookup(goal))[0].toDF("above")


@query("""SELECT NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS all_worth, NOT EXISTS (SELECT 1 FROM part WHERE p_size <= 25) AS all_large""")
def forall_verdict(spark, sf_dir):
    look = lookup_of(spark, sf_dir)
    one, _ = bodies.conjunction((atom("worth", "$o", "$w"), check("less", "$w", 0.0)), look)
    two, _ = bodies.conjunction((atom("size", "$p", "$s"), check("greater", "$s", 25, negated=True)), look)
    none = lambda df, name: df.limit(1).agg((F.count(F.lit(1)) == 0).alias(name))
    return none(one, "all_worth").crossJoin(none(two, "all_large"))


@query("""SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')""")
def forall_only(spark, sf_dir):
    """Orders all of whose lines are returned; an order without lines is one of them."""
    rules = [rule(atom("other", "$o"), atom("flag", "$o", "$f"), check("equal", "$f", "R", negated=True)), rule(atom("q", "$o"), atom("order", "$o"), naf("other", "$o"))]
    return solved(spark, sf_dir, rules, "q", ["key"])


@query("SELECT DISTINCT l_orderkey AS key, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'R'")
def forall_counterexamples(spark, sf_dir):
    body = (atom("status", "$o", "F"), atom("flag", "$o", "$f"), check("equal", "$f", "R", negated=True))
    return solved(spark, sf_dir, [rule(atom("q", "$o", "$f"), *body)], "q", ["key", "flag"])


@query("SELECT l_orderkey AS key FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 3")
def exactly_n(spark, sf_dir):
    known = facts(Tables(spark, sf_dir))
    return aggregates.exactly(known["contains", "bare"], "x2", ["x1"], 3).toDF("key")


@query("SELECT p_partkey AS part FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def exactly_zero(spark, sf_dir):
    more = {("bulk", "bare"): relation(Tables(spark, sf_dir).lineitem.where("l_quantity >= 49"), "l_partkey")}
    return solved(spark, sf_dir, [rule(atom("q", "$p"), atom("part", "$p"), naf("bulk", "$p"))], "q", ["part"], more)


def _bound(spark, sf_dir):
    got, names = bodies.conjunction((atom("customer", "$c", "$n", "BUILDING"), atom("placed", "$c", "$o"), atom("worth", "$o", "$w")), lookup_of(spark, sf_dir))
    return got.select(*[F.col(c).alias(v) for v, c in names.items()]).distinct()


WORTHS = "SELECT DISTINCT c_custkey AS c, o_orderkey AS o, o_totalprice AS w FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"


@query(f"SELECT count(*) AS witnesses FROM ({WORTHS})")
def count_witnesses(spark, sf_dir):
    return _bound(spark, sf_dir).agg(F.count(F.lit(1)).alias("witnesses"))


def _aggregate(op: str):
    def run(spark, sf_dir):
        return aggregates.aggregated(_bound(spark, sf_dir), "w", op).select(F.round("value", 2).alias("value"), "witnesses", "bad")

    run.__name__ = f"agg_{op}"
    return query(f"SELECT round({op}(w), 2) AS value, count(*) AS witnesses, 0::BIGINT AS bad FROM ({WORTHS})")(run)


for _op in ("sum", "min", "max", "avg"):
    _aggregate(_op)


@query("SELECT DISTINCT a.s_suppkey AS richer, b.s_suppkey AS poorer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_acctbal > b.s_acctbal")
def cmp_greater(spark, sf_dir):
    body = (atom("supplier", "$a", "$n"), atom("supplier", "$b", "$n"), atom("owed", "$a", "$x"), atom("owed", "$b", "$y"), check("greater", "$x", "$y"))
    return solved(spark, sf_dir, [rule(atom("q", "$a", "$b"), *body)], "q", ["richer", "poorer"], keys=supplier_keys(spark, sf_dir))


def _small(spark):
    return {("small", "bare"): spark.range(1, 51).select(F.col("id").alias("x1"))}


@query("SELECT p_partkey AS part, p_size AS size, p_partkey // p_size AS k FROM part WHERE p_partkey % p_size = 0 AND p_partkey // p_size BETWEEN 1 AND 50")
def arith_product_isclose(spark, sf_dir):
    body = (atom("size", "$p", "$s"), atom("small", "$k"), check("product", "$p", "$s", "$k"))
    return solved(spark, sf_dir, [rule(atom("q", "$p", "$s", "$k"), *body)], "q", ["part", "size", "k"], _small(spark))


@query("SELECT p_partkey AS part FROM part WHERE p_partkey % p_size = 0 AND p_partkey // p_size BETWEEN 1 AND 50")
def arith_quotient(spark, sf_dir):
    body = (atom("size", "$p", "$s"), atom("small", "$k"), check("quotient", "$k", "$p", "$s"))
    return solved(spark, sf_dir, [rule(atom("q", "$p"), *body)], "q", ["part"], _small(spark))


@query("SELECT p_partkey AS part, p_partkey - p_size AS k FROM part WHERE p_partkey - p_size BETWEEN 1 AND 50")
def arith_sum(spark, sf_dir):
    body = (atom("size", "$p", "$s"), atom("small", "$k"), check("sum", "$p", "$s", "$k"))
    return solved(spark, sf_dir, [rule(atom("q", "$p", "$k"), *body)], "q", ["part", "k"], _small(spark))


EQUAL = """WITH RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey % 3 = a.s_suppkey % 3),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS term, min(b) AS rep FROM r GROUP BY a) """


def _equations(spark, sf_dir):
    """Suppliers of one nation whose numbers leave one remainder by 3 are said to be the same."""
    s = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_nationkey")
    low = s.groupBy("s_nationkey", F.pmod("s_suppkey", F.lit(3)).alias("m")).agg(F.min("s_suppkey").alias("x2"))
    return s.join(low, (s["s_nationkey"] == low["s_nationkey"]) & (F.pmod("s_suppkey", F.lit(3)) == F.col("m"))).select(F.col("s_suppkey").alias("x1"), "x2")


@query(EQUAL + "SELECT term, rep FROM c WHERE term <> rep")
def equality_canon(spark, sf_dir):
    return equality.canon(_equations(spark, sf_dir)).where("term <> rep")


@query(EQUAL + "SELECT l_partkey AS part FROM lineitem JOIN c ON l_suppkey = term GROUP BY l_partkey HAVING count(DISTINCT rep) = 24")
def equality_count(spark, sf_dir):
    supplies = facts(Tables(spark, sf_dir))["supplies", "bare"]
    return aggregates.exactly(supplies, "x1", ["x2"], 24, equality.canon(_equations(spark, sf_dir))).toDF("part")


@query(EQUAL + "SELECT DISTINCT rep AS supplier, l_partkey AS part FROM lineitem JOIN c ON l_suppkey = term")
def equality_substitution(spark, sf_dir):
    supplies = facts(Tables(spark, sf_dir))["supplies", "bare"]
    return equality.canonical(supplies, equality.canon(_equations(spark, sf_dir)), ["x1"]).toDF("supplier", "part")


def _flavored(spark, sf_dir):
    """Orders by status: finished ones are past shipments, open ones future, others now."""
    o = Tables(spark, sf_dir).orders
    rows = lambda s: relation(o.where(F.col("o_orderstatus") == s), "o_custkey", "o_orderkey", distinct=False)
    return {("ships", "past"): rows("F"), ("ships", "future"): rows("O"), ("ships", "now"): rows("P")}


@query("SELECT o_custkey AS customer, o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'")
def flavor_exact(spark, sf_dir):
    r = rule(atom("q", "$c", "$o"), atom("ships", "$c", "$o", flavor="past"))
    return solved(spark, sf_dir, [r], "q", ["customer", "key"], _flavored(spark, sf_dir))


@query("""SELECT DISTINCT a.o_custkey AS customer FROM orders a WHERE a.o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O')""")
def flavor_rule(spark, sf_dir):
    r = rule(atom("served", "$c", flavor="past"), atom("ships", "$c", "$o", flavor="past"), naf("waiting", "$c", flavor="future"))
    w = rule(atom("waiting", "$c", flavor="future"), atom("ships", "$c", "$o", flavor="future"))
    return solved(spark, sf_dir, [r, w], "served", ["customer"], _flavored(spark, sf_dir), flavor="past")


@query("""SELECT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 400000""")
def disjunctive_antecedent(spark, sf_dir):
    rules = [rule(atom("q", "$o"), atom("priority", "$o", "1-URGENT")), rule(atom("q", "$o"), atom("worth", "$o", "$w"), check("greater", "$w", 400000.0))]
    return solved(spark, sf_dir, rules, "q", ["key"])


BOTH = "WITH u AS (SELECT o_orderkey AS k, o_orderpriority = '1-URGENT' AS a, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS b FROM orders) "


def _two(spark, sf_dir, cases):
    sides = [rule(atom("a", "$o"), atom("priority", "$o", "1-URGENT")), rule(atom("b", "$o"), atom("flag", "$o", "R"))]
    pick = {True: atom, False: naf}
    rules = [rule(atom("q", "$o"), atom("order", "$o"), pick[x]("a", "$o"), pick[y]("b", "$o")) for x, y in cases]
    flags = {("flag", "bare"): relation(Tables(spark, sf_dir).lineitem, "l_orderkey", "l_returnflag", distinct=False)}  # "b" is a set all the same
    return solved(spark, sf_dir, sides + rules, "q", ["key"], flags)


@query(BOTH + "SELECT k AS key FROM u WHERE a = b")
def iff_expand(spark, sf_dir):
    return _two(spark, sf_dir, [(True, True), (False, False)])


@query(BOTH + "SELECT k AS key FROM u WHERE a <> b")
def xor_expand(spark, sf_dir):
    return _two(spark, sf_dir, [(True, False), (False, True)])


@query(BOTH + "SELECT k AS key FROM u WHERE NOT a OR b")
def implication_expand(spark, sf_dir):
    return _two(spark, sf_dir, [(False, True), (False, False), (True, True)])


@query("""SELECT 'integrity' AS kind, 'overdrawn' AS label, concat('b=', round(c_acctbal, 2)::VARCHAR, ', c=', c_custkey) AS detail FROM (
SELECT DISTINCT c_custkey, c_acctbal FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < -990 AND o_orderpriority = '1-URGENT') WHERE FALSE
UNION ALL SELECT 'integrity', 'overdrawn', concat('c=', c_custkey) FROM (SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < -900 AND o_orderpriority = '1-URGENT')""")
def constraint_violations(spark, sf_dir):
    low = {("low", "bare"): relation(Tables(spark, sf_dir).customer.where("c_acctbal < -900"), "c_custkey")}
    urgent = {("urgent", "bare"): relation(Tables(spark, sf_dir).orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")}
    known = low | urgent
    return constraints.violations(constraints.Constraint("overdrawn", (atom("low", "$c"), atom("urgent", "$c"))), lambda a: known.get(a.key))


@query("""SELECT 'disjunction' AS kind, 'moved' AS label, concat('o=', o_orderkey) AS detail FROM orders WHERE o_orderstatus = 'F'
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def disjunctive_constraint(spark, sf_dir):
    """A finished order was kept or was accepted; lines flagged R deny the first, lines flagged A the second."""
    known = facts(Tables(spark, sf_dir))
    denied = {("kept", "bare"): known["flag", "bare"].where("x2 = 'R'").select("x1"), ("accepted", "bare"): known["flag", "bare"].where("x2 = 'A'").select("x1")}
    c = constraints.Constraint("moved", (atom("status", "$o", "F"),), (atom("kept", "$o"), atom("accepted", "$o")))
    return constraints.violations(c, lambda a: known.get(a.key), lambda a: denied.get(a.key))


@query(CLOSURE + "SELECT x AS part, y AS above FROM r")
def incremental_equals_full(spark, sf_dir):
    """The closure of most of the tree, resumed with the rest of its edges."""
    every = facts(Tables(spark, sf_dir))["parent", "bare"]
    model = fixpoint.evaluate(spark, LINEAR, {("parent", "bare"): every.where("x1 % 10 <> 0")}, wanted=["reach"])
    return fixpoint.resume(model, ("parent", "bare"), every.where("x1 % 10 = 0")).relation(("reach", "bare")).toDF("part", "above")


@query(f"WITH RECURSIVE e AS (SELECT * FROM ({TREE}) WHERE x % 7 <> 0), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS part, y AS above FROM r")
def retract_equals_never(spark, sf_dir):
    """Every seventh edge is retracted: relations are evaluated again from what is left."""
    every = facts(Tables(spark, sf_dir))["parent", "bare"]
    gone = every.where("x1 % 7 = 0").select(F.col("x1").alias("g1"), F.col("x2").alias("g2"))
    left = every.join(gone, (F.col("x1") == F.col("g1")) & (F.col("x2") == F.col("g2")), "left_anti")
    return fixpoint.evaluate(spark, LINEAR, {("parent", "bare"): left}, wanted=["reach"]).relation(("reach", "bare")).toDF("part", "above")


@query("""SELECT DISTINCT o_custkey AS customer, 'k' AS kind, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""")
def invented_witness(spark, sf_dir):
    """A rule whose conclusion invents a receipt for each order: as many receipts as orders."""
    r = Rule((atom("receipt", "$c", "$w"),), (atom("placed", "$c", "$o"), atom("worth", "$o", "$p")), invents=("w",))
    got = solved(spark, sf_dir, [r], "receipt", ["customer", "witness"])
    return got.groupBy("customer", F.substring("witness", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(CLOSURE + """, d AS (SELECT x, y, floor(log2(x)) - floor(log2(y)) AS depth FROM r) SELECT depth::BIGINT AS round, count(*) AS tuples FROM d GROUP BY 1""")
def proof_rounds(spark, sf_dir):
    """How many tuples each round derived first: what proofs are rebuilt from."""
    model = fixpoint.evaluate(spark, LINEAR, facts(Tables(spark, sf_dir)), wanted=["reach"])
    return model.derived(("reach", "bare")).groupBy(F.col("round").cast("bigint").alias("round")).agg(F.count(F.lit(1)).alias("tuples"))


REQUESTS = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, c_nationkey AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
asker AS (SELECT c_custkey AS k, c_nationkey AS home, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer),
met AS (SELECT o_orderkey, k FROM o JOIN asker ON k = o_custkey UNION SELECT o_orderkey, k FROM o JOIN asker ON k = o_custkey + 1 UNION SELECT o_orderkey, k FROM o JOIN asker ON home = nation AND place = 1),
asked AS (SELECT * FROM met JOIN o USING (o_orderkey) JOIN asker USING (k), (VALUES ('read'), ('update'), ('ship')) AS v(action)),
told AS (SELECT DISTINCT k::VARCHAR AS who, action, o_orderkey::VARCHAR AS resource, coalesce(CASE action
WHEN 'ship' THEN k = o_custkey AND o_orderpriority = '1-URGENT'
WHEN 'update' THEN k = o_custkey OR (segment = 'MACHINERY' AND o_orderpriority <> '1-URGENT')
ELSE k = o_custkey OR (segment = 'MACHINERY' AND o_orderpriority <> '1-URGENT') OR home = nation END, FALSE) AS allowed FROM asked)
"""


@query(REQUESTS + "SELECT who, action, resource, allowed FROM told")
def auth_can_batch(spark, sf_dir):
    """The decision on each request of auth_can_requests, refusals included: one evaluation for the batch."""
    return Authorizer(spark, _whole_authorization(spark, sf_dir)).decide(order_requests(spark, sf_dir))


@query(REQUESTS + "SELECT who, action, resource FROM told WHERE allowed")
def auth_can_requests(spark, sf_dir):
    """Whole tables: for every order its customer, the customer of the next key and the first one of its nation ask for each action.

    Customers own their orders; one segment's customers are admins of what is not urgent; nations are
    tenants; urgent orders may be shipped. Requests do not depend on what is allowed, so many are refused.
    """
    a = Authorizer(spark, _whole_authorization(spark, sf_dir))
    return a.can_any(order_requests(spark, sf_dir))


def _whole_authorization(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = lambda name: F.col(name).cast("string")
    owner = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return {
        "owns": relation(t.orders, c("o_custkey"), c("o_orderkey"), distinct=False),
        "has_role": relation(t.customer.where("c_mktsegment = 'MACHINERY'"), c("c_custkey"), F.lit("admin"), distinct=False),
        "resource": relation(t.orders.where("o_orderpriority <> '1-URGENT'"), c("o_orderkey"), distinct=False),
        "in_tenant": relation(t.customer, c("c_custkey"), c("c_nationkey"), distinct=False),
        "resource_tenant": relation(owner, c("o_orderkey"), c("c_nationkey"), distinct=False),
        "grant": relation(t.orders.where("o_orderpriority = '1-URGENT'"), c("o_custkey"), F.lit("ship"), c("o_orderkey"), distinct=False),
    }


def order_requests(spark, sf_dir):
    """(who, action, resource) of every order: its customer, the next key's and the first of its nation, for each action."""
    t = Tables(spark, sf_dir)
    leaders = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("leader"))
    near = t.customer.join(leaders, "c_nationkey").select("c_custkey", "leader")
    keys = t.customer.select(F.col("c_custkey").alias("k"))
    askers = F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.col("leader")))
    who = t.orders.join(near, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", askers.alias("w")).distinct()
    who = who.join(keys, F.col("w") == F.col("k"), "left_semi")
    actions = F.explode(F.array(F.lit("read"), F.lit("update"), F.lit("ship")))
    return who.select(F.col("w").cast("string").alias("who"), actions.alias("action"), F.col("o_orderkey").cast("string").alias("resource"))


@query("SELECT DISTINCT 'region_of' AS relation, concat('c:', replace(lower(n_name), ' ', '_')) AS x1, concat('c:', replace(lower(r_name), ' ', '_')) AS x2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def triples_roundtrip(spark, sf_dir):
    """Facts out as N-Triples and in again."""
    t = Tables(spark, sf_dir)
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.select(F.lit("region_of").alias("relation"), F.lit("bare").alias("flavor"), *(F.concat(F.lit("c:"), F.lower(F.col(c))).alias(x) for c, x in (("n_name", "x1"), ("r_name", "x2"))))
    lines, _ = rdf.n_triples(rows, "http://example.org/kb/")
    path = f"{shared_dir(spark)}/triples-{uuid.uuid4().hex}"
    lines.write.text(path)
    triples, _ = rdf.read_turtle(spark, path)
    return rdf.facts(triples).select("relation", "x1", "x2")


@query("""WITH RECURSIVE e AS (SELECT event_id AS x, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events WHERE event_type = 'purchase'),
r AS (SELECT x, y FROM e WHERE y IS NOT NULL UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x WHERE e.y IS NOT NULL) SELECT x AS first, y AS later FROM r""")
def later_events(spark, sf_dir):
    """Earlier-than as a rule: what follows directly, closed. Chains are long, so the rule doubles its reach each round."""
    e = Tables(spark, sf_dir).events.where("event_type = 'purchase'")
    nexts = e.withColumn("y", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    more = {("next", "bare"): relation(nexts, "event_id", "y", distinct=False)}
    rules = [rule(atom("later", "$x", "$y"), atom("next", "$x", "$y")), rule(atom("later", "$x", "$z"), atom("later", "$x", "$y"), atom("later", "$y", "$z"))]
    return solved(spark, sf_dir, rules, "later", ["first", "later"], more)


@query(CLOSURE + "SELECT x AS part, y AS above FROM r")
def streamed_closure(spark, sf_dir):
    """The tree's edges as a stream of three batches, each folded into the model as a delta."""
    every = facts(Tables(spark, sf_dir))["parent", "bare"]
    feed = Feed(fixpoint.evaluate(spark, LINEAR, {("parent", "bare"): every.where("x1 % 3 = 0")}, ["reach"]), "parent", wanted=["reach"])
    for k in (1, 2):
        feed.add(every.where(F.col("x1") % 3 == k), k)
    return feed.model.relation(("reach", "bare")).toDF("part", "above")


@query("""SELECT c_custkey::VARCHAR AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def text_find_over_tables(spark, sf_dir):
    """A question in the text language over bound tables."""
    t = Tables(spark, sf_dir)
    kb = KB(spark, Vocabulary().declare("customer(who, nation, segment); nation(key, name); placed(who, order); priority(order, level); urgent(who)"))
    kb.bind("customer", t.customer, "c_custkey", "c_nationkey", "c_mktsegment").bind("nation", t.nation, "n_nationkey", "n_name")
    kb.bind("placed", t.orders, "o_custkey", "o_orderkey").bind("priority", t.orders, "o_orderkey", "o_orderpriority")
    kb.tell('all $c, $o: placed($c, $o) & priority($o, "1-URGENT") -> urgent($c).')
    found = kb.find('customer($c, $n, "BUILDING") & nation($n, $name) & ~urgent($c)')
    return found.select(F.substring("c", 3, 64).cast("double").cast("bigint").cast("string").alias("customer"), F.substring("name", 3, 64).alias("nation")).distinct()


@query("""SELECT count(*) AS witnesses, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000""")
def text_aggregate_over_tables(spark, sf_dir):
    """A counted and summed find of the text language, with a numeric condition."""
    t = Tables(spark, sf_dir)
    kb = KB(spark, Vocabulary().declare("customer(who, segment); balance(who, amount)"))
    kb.bind("customer", t.customer, "c_custkey", "c_mktsegment").bind("balance", t.customer, "c_custkey", "c_acctbal")
    found = kb.find('customer($c, "BUILDING") & balance($c, $b) & greater($b, 5000)')
    return found.agg(F.count(F.lit(1)).alias("witnesses"), F.round(F.sum(F.substring("b", 3, 64).cast("double")), 2).alias("total"))
