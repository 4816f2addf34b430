"""Line dedup by site-relative frequency.

The pages of a host that hold a line, divided by the pages of the host, give the line's ratio; lines above ``ratio``
are boilerplate of that host and dropped from all its pages. Repeats within one page count once. Lines of
blanks only are neither counted nor dropped.

Counting shuffles (host, hash of line, count) after partial aggregation. A line on more than ``ratio`` of a host's
pages is one of at most (mean lines of its pages / ratio), so the boilerplate of a host fits in one array, and the
texts stay where they are as long as these arrays are few: they join by host, and built-in array functions cut the lines.

``copies_once`` takes equal texts of a host for one page, in a line's count and in the host's total, so that a
document doesn't become boilerplate by being copied. The counted rows are then (host, hash of line, hash of text). Copies
that differ anywhere are still pages of their own.

Defined results: a null host is a host of its own; a null text stays null and counts as a page without lines; an
empty text stays empty; repeated rows are pages of their own; a page may lose all its lines and is then empty;
ties can't occur, as the test is on each line alone; an empty table gives no rows; all other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

RATIO = 0.02
#: A line on fewer pages of a host is never boilerplate, however small the host.
LEAST_PAGES = 3
_PAGES, _DROP = "__host_lines", "__boilerplate"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO,
                least: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, lines): for each host with boilerplate the hashes of its lines."""
    narrow = pages.select(F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(text).alias("page"))
    n_pages = F.count_distinct("page") if copies_once else F.count("*")
    totals = narrow.groupBy("host").agg(n_pages.alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _worded), lambda x: F.xxhash64(x)))
    counts = narrow.select("host", "page", F.explode(keys).alias("line")).groupBy("host", "line").agg(n_pages.alias("n"))
    often = counts.where(F.col("n") >= least).withColumnRenamed("host", "at")
    return often.join(totals, F.col("at").eqNullSafe(F.col("host"))).where(
        F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO,
                     least: int = LEAST_PAGES, dropped: str | None = None, copies_once: bool = False) -> DataFrame:
    """The pages with their text cut; ``dropped`` names a column for the number of lines cut."""
    # Written out, so that its size is known when the join is planned: a small table is sent to the texts, and only a
    # large one makes the texts move.
    bad = staged(boilerplate(pages, host, text, ratio, least, copies_once)).select(
        F.col("host").alias(_PAGES), F.col("lines").alias(_DROP))
    kept = F.filter(_lines(F.col(text)), lambda x: ~(
        _worded(x) & F.array_contains(F.coalesce(F.col(_DROP), F.array().cast("array<long>")), F.xxhash64(x))))
    joined = pages.join(bad, pages[host].eqNullSafe(bad[_PAGES]), "left").withColumn("__kept", kept)
    out = [F.array_join("__kept", "\n").alias(text) if c == text else F.col(c) for c in pages.columns]
    if dropped:
        out.append(F.coalesce(F.size(_lines(F.col(text))) - F.size("__kept"), F.lit(0)).cast("long").alias(dropped))
    return joined.select(out)


#: The query over documents (host = source) in SQL: n_lines, n_dropped and the SHA-256 of what is left.
SQL = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, l.i, l.line FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS i) l),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
bad AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {LEAST_PAGES} AND c.n > {RATIO} * t.pages)
SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.line IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
GROUP BY l.doc_id
"""
