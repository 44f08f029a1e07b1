"""Line deduplication by site-relative frequency: boilerplate is what too many pages of one host repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import write_once

#: Markup that carries no text, and tags that end a line.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|title|head|body|html)\b[^>]*>|\n"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL, else null."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Text lines of a page: hidden parts dropped, cut at block tags and newlines, tags stripped, trimmed."""
    shown = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), BREAKS)
    bare = F.transform(shown, lambda x: F.trim(F.regexp_replace(x, TAG + r"|\s+", " ")))
    return F.filter(bare, lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def line_dedup(pages: DataFrame, max_ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """(page_id, url, html) -> page_id, host, n_lines, n_dropped, text (lines kept, joined by newlines).

    A line is dropped from every page of a host if it stands on more than ``max_ratio`` of the host's
    pages and on at least ``min_pages`` of them. Counts are per distinct line of a page and partial
    before the shuffle, so a line on a third of all pages is one row per task. A host has fewer than
    (distinct lines per page / max_ratio) such lines, so its list goes to its pages as one array;
    Spark picks broadcast or a (skew-split) shuffle join from the written list's size.

    A page without a host belongs to no site and keeps all lines. Null html has no lines. Repeated rows
    are pages of their own. An empty table gives an empty result; further columns are ignored.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    sited = rows.where("host IS NOT NULL")
    hosts = sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    distinct = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("key"))
    common = distinct.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    common = common.join(hosts.withColumnRenamed("host", "site"), F.col("host") == F.col("site"))
    common = common.where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    listed = write_once(common.groupBy(F.col("host").alias("site")).agg(F.collect_list("key").alias("dropped")), "lines")
    found = rows.join(listed, F.col("host") == F.col("site"), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("dropped"), _key(x))))
    found = found.withColumn("kept", kept)
    return found.select(
        "page_id", "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


ORACLE = r"""
WITH shown AS (
  SELECT page_id,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '<!--.*?-->', ' ', 'gs'), '<script\b.*?</script\s*>', ' ', 'gsi'), '<style\b.*?</style\s*>', ' ', 'gsi') AS body
  FROM pages
), cut AS (
  SELECT page_id, host, list_filter(list_transform(
    string_split(regexp_replace(body, '</?(?:p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|title|head|body|html)\b[^>]*>|\n', chr(1), 'gi'), chr(1)),
    lambda x: trim(regexp_replace(x, '<[^>]*>|\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
  FROM shown
), seen AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut WHERE host IS NOT NULL) GROUP BY ALL
), sites AS (SELECT host, count(*) AS pages FROM cut WHERE host IS NOT NULL GROUP BY host),
dropped AS (
  SELECT host, list(line) AS gone FROM seen JOIN sites USING (host) WHERE n >= 3 AND n > 0.3 * pages GROUP BY host
), kept AS (
  SELECT page_id, cut.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay
  FROM cut LEFT JOIN dropped ON cut.host = dropped.host
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS text
FROM kept
"""
