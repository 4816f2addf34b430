"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens (runs of letters and digits) that any URL it
fits must hold. Over all URLs the rules' tokens are counted; each rule is filed under its rarest one. A URL's
tokens fetch the rules filed under them, and only those run their expression. Rules without a literal token are
filed under the empty token, which every URL has.

Host rules name a host and a path prefix; they fit the host and its subdomains, and the longest that fits wins.
Where none fits, a pattern that fits blocks the URL, and every other URL is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and is allowed; rules of
equal length are ordered by their text; repeated rows are judged alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

TOKEN = r"[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``rank`` 1 for host rules, 0 for patterns, which have no say where a host rule fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    literal = host + path
    tokens = re.findall(TOKEN, literal)
    if re.search(f"{TOKEN}$", literal):
        tokens = tokens[:-1]  # the path goes on after the prefix: its last run may be a part of a longer one
    return Rule(literal, verdict, rf"^(?:[^/]*\.)?{re.escape(literal)}", tuple(tokens), 1)


def host_words(*words: str) -> Rule:
    """Blocks hosts with a label made of these words, joined by hyphens, alone or within a longer label."""
    name = "-".join(words)
    return Rule(name, "block", rf"^(?:[^/]*[.-])?{name}(?:[.-][^/]*)?(?:/|$)", words, 0)


HOST_RULES = (host_rule("allow", "org", "/"), host_rule("block", "example.org", "/es/"),
              host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"),
              host_rule("block", "com", "/de/"))
PATTERNS = (host_words("spam", "farm"), host_words("cheap", "pills"),
            host_words("free", "bets"), host_words("ads", "track"), host_words("casino"), host_words("adult"),
            host_words("porn"), host_words("xxx"),
            Rule("download file", "block", r"^[^/]+/(?:.*/)?[^/]*\.(?:exe|zip|apk|dmg|msi)$", (), 0))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def _rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules],
        "rule string, verdict string, pattern string, tokens array<string>, rank int")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERNS, url: str = "url",
          page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict)."""
    spark = pages.sparkSession
    host, path = parts(F.col(url))
    rows = staged(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "row_id", F.monotonically_increasing_id()))
    target = F.concat("host", "path")
    table = _rule_table(spark, rules)
    own = table.select(F.explode("tokens").alias("token")).distinct()
    tokens = rows.select("row_id", target.alias("target"), F.explode(F.array_distinct(F.concat(
        F.regexp_extract_all(target, F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))).alias("token"))
    frequency = tokens.join(own, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = table.select("rule", F.explode("tokens").alias("token")).join(frequency, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    filed = table.drop("tokens").join(ranked, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))
    fits = tokens.join(filed, "token").where("target RLIKE pattern").groupBy("row_id").agg(
        F.max(F.struct("rank", F.length("rule").alias("length"), "rule", "verdict")).alias("best"))
    return rows.join(fits, "row_id", "left").select(
        "page_id", "host", "path", F.when(F.col("best")["rank"] == 1, F.col("best")["rule"]).alias("rule"),
        F.coalesce(F.col("best")["verdict"], F.lit("allow")).alias("verdict"))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(r.name)}, {quoted(r.verdict)}, {quoted(r.pattern)}, {r.rank})"
                       for r in HOST_RULES + PATTERNS)
    return f"""
WITH rules(rule, verdict, pattern, rank) AS (VALUES {values}),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT p.page_id, p.host, p.path, max({{'rank': r.rank, 'length': length(r.rule), 'rule': r.rule, 'verdict': r.verdict}}) AS b
  FROM parts p LEFT JOIN rules r ON regexp_matches(p.host || p.path, r.pattern) GROUP BY ALL)
SELECT page_id, host, path, CASE WHEN b.rank = 1 THEN b.rule END AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best
"""


SQL = _sql()
