"""RDF: a line-based subset of Turtle in, N-Triples out, by DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms

#: IRIs with a meaning of their own.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
XSD = "http://www.w3.org/2001/XMLSchema#"
NUMBERS = ("integer", "decimal", "double", "float", "int", "long")

PART = r"(<[^>]*>|[A-Za-z][\w-]*:[\w.-]*|a)"
LINE = r'^\s*(<[^>]*>|[A-Za-z][\w-]*:[\w.-]*)\s+' + PART + r'\s+(<[^>]*>|[A-Za-z][\w-]*:[\w.-]*[\w-]|"(?:[^"\\]|\\.)*"(?:\^\^(?:<[^>]*>|[\w-]+:[\w-]+)|@[\w-]+)?|[-+]?\d+(?:\.\d+)?)\s*\.\s*$'


def _iri(part: Column, prefixes: dict[str, str]) -> Column:
    """The full IRI of <...>, prefix:name or ``a``; null for an undeclared prefix."""
    out = F.when(part.startswith("<"), F.substring(part, 2, 1 << 20)).when(part == "a", F.lit(RDF_TYPE))
    for name, base in sorted(prefixes.items()):
        out = out.when(part.startswith(name + ":"), F.concat(F.lit(base), F.substring(part, len(name) + 2, 1 << 20)))
    return F.regexp_replace(out, ">$", "")


def read_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples, refused). Triples: s, p, o, kind (iri, string or number); refused: line, reason.

    One triple per line; @prefix lines, comments and blank lines are allowed. Blank nodes, collections
    and lists of objects are not understood and are refused, never dropped in silence.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    lines = lines.where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    heads = lines.where(F.col("line").rlike(r"(?i)^\s*@?prefix\s")).collect()  # declarations only
    prefixes = {}
    for row in heads:
        name, base = row["line"].split(None, 1)[1].split(":", 1)
        prefixes[name.strip()] = base[base.index("<") + 1 : base.index(">")]
    body = lines.where(~F.col("line").rlike(r"(?i)^\s*@?prefix\s"))
    got = body.select("line", *[F.regexp_extract("line", LINE, i).alias(c) for i, c in enumerate(("s0", "p0", "o0"), 1)])
    o = F.col("o0")
    datatype = _iri(F.regexp_extract(o, r'\^\^(.*)$', 1), prefixes)
    number = o.rlike(r"^[-+]?\d") | datatype.isin([XSD + n for n in NUMBERS])
    literal = F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")
    kind = F.when(number, "number").when(o.startswith('"'), "string").otherwise("iri")
    value = F.when(number & o.startswith('"'), literal).when(number, o).when(o.startswith('"'), literal).otherwise(_iri(o, prefixes))
    got = got.select("line", _iri(F.col("s0"), prefixes).alias("s"), _iri(F.col("p0"), prefixes).alias("p"), value.alias("o"), kind.alias("kind"))
    good = F.col("s").isNotNull() & (F.col("s") != "") & F.col("p").isNotNull() & (F.col("p") != "") & F.col("o").isNotNull() & ((F.col("kind") != "number") | F.col("o").try_cast("double").isNotNull())
    return got.where(good).select("s", "p", "o", "kind"), got.where(~F.coalesce(good, F.lit(False))).select("line", F.lit("not a triple of the understood form").alias("reason"))


def local_name(iri: Column) -> Column:
    return F.lower(F.regexp_extract(iri, r"([^/#]*)[/#]?$", 1))


def _number(lexical: Column) -> Column:
    """The term of a number as it is written."""
    whole = lexical.rlike(r"^[-+]?\d{1,38}$")
    return F.when(whole, terms.numbers(lexical.try_cast("decimal(38,0)"), "decimal(38,0)")).otherwise(terms.numbers(lexical.try_cast("double"), "double"))


def facts(triples: DataFrame) -> DataFrame:
    """(relation, x1, x2) with tagged terms, from the local names of IRIs."""
    obj = F.when(F.col("kind") == "iri", F.concat(F.lit("c:"), local_name(F.col("o")))).when(F.col("kind") == "number", _number(F.col("o"))).otherwise(F.concat(F.lit("c:"), F.col("o")))
    return triples.select(local_name(F.col("p")).alias("relation"), F.concat(F.lit("c:"), local_name(F.col("s"))).alias("x1"), obj.alias("x2")).distinct()


def owl(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subsorts: low, high; entities: entity, sort; facts of all other triples)."""
    low = triples.where(F.col("p") == SUBCLASS).select(local_name(F.col("s")).alias("low"), local_name(F.col("o")).alias("high")).distinct()
    typed = triples.where(F.col("p") == RDF_TYPE).select(local_name(F.col("s")).alias("entity"), local_name(F.col("o")).alias("sort")).distinct()
    return low, typed, facts(triples.where(~F.col("p").isin(RDF_TYPE, SUBCLASS)))


def escaped(c: Column) -> Column:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def n_triples(rows: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(value lines in order, refused with a reason) of (relation, flavor, x1, x2) rows of tagged terms.

    Only bare binary facts whose subject is a name can be said as a triple; all others are refused by name.
    """
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.replace(F.substring(c, 3, 1 << 20), F.lit(" "), F.lit("_")), F.lit(">"))
    plain = lambda c: c.rlike(r"^c:[\w. -]+$")
    subject, obj = F.col("x1"), F.col("x2")
    reason = F.when(F.col("flavor") != "bare", "tense or modality").when(~plain(subject), "the subject is no name").when(obj.startswith("u:"), "the object is unspecified").when(~obj.rlike("^[cn]:"), "the object is no name or number")
    value = F.when(obj.startswith("n:"), F.concat(F.lit('"'), F.substring(obj, 3, 64), F.lit(f'"^^<{XSD}double>'))).when(plain(obj), iri(obj)).otherwise(F.concat(F.lit('"'), escaped(F.substring(obj, 3, 1 << 20)), F.lit('"')))
    marked = rows.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select(F.concat_ws(" ", iri(subject), F.concat(F.lit(f"<{base}"), F.col("relation"), F.lit(">")), value, F.lit(".")).alias("value"))
    return good.distinct().orderBy("value"), marked.where("reason IS NOT NULL")
