"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefix and confirmed by full digest.

A rule is (host, path, action). It fits a url if the url's host is the rule's host or a subdomain of it and the url's path
starts with the rule's path; of all that fit, the one with the longest ``host + path`` wins (then the longer host, then text
order), and a url that no rule fits gets the default verdict, allow. Every url is expanded into the expressions that a rule
could equal: for each pair of a label count and a path length that occurs among the rules, that host suffix with that path prefix. An
expression is looked up by the first 32 bits of its SHA-256; what is found there counts if the whole digests are equal.

Nulls: a url that is null or has no ``://`` has an empty host and path. Repeated rows come back as often as they were given.
Empty rules give the default verdict everywhere. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, load, maybe_broadcast

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, a) for h, p, a in rules], "host string, path string, action string")


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _short(digest: Column) -> Column:
    """The first 32 bits of a digest, as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url) -> page_id, url, host, path, rule, verdict; one row for each input row."""
    rules = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action")).filter("r_host <> ''")
    rules = rules.withColumn("r_text", F.concat("r_host", "r_path")).withColumn("r_digest", _digest(F.concat_ws("\n", "r_host", "r_path"))).withColumn("r_short", _short(F.col("r_digest")))
    # The shapes of the rules: pairs of a label count and a path length, bounded by the longest rule and not by the number of rules.
    shapes = sorted(map(tuple, rules.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect()))
    # Copies of a row travel as one; the key stays the partitioning of all that follows.
    rows = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    labels = F.size(F.split("host", r"\."))
    pairs = [
        F.when((labels >= n) & (F.length("path") >= m), F.concat_ws("\n", F.substring_index("host", ".", -n), F.substring("path", 1, m)))
        for n, m in shapes
    ]
    expressions = F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")
    tried = rows.withColumn("_e", F.explode_outer(expressions)).withColumn("_d", _digest(F.col("_e"))).withColumn("_p", _short(F.col("_d"))).drop("_e")
    # Broadcast only if its bytes prove small; the key is the short prefix alone.
    ranked = maybe_broadcast(rules.select("r_short", "r_digest", "r_host", "r_text", "r_action"))
    hits = tried.join(ranked, F.col("_p") == F.col("r_short"), "left")
    best = F.max(F.when(F.col("_d") == F.col("r_digest"), F.struct(F.length("r_text").alias("n"), F.length("r_host").alias("h"), "r_text", "r_action")))
    judged = hits.groupBy("page_id", "url", "host", "path", "_n").agg(best.alias("_b"))
    out = judged.select("page_id", "url", "host", "path", F.col("_b.r_text").alias("rule"), F.coalesce("_b.r_action", F.lit(default)).alias("verdict"), "_n")
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n", "_i")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(load(spark, sf_dir, "pages"), rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') END, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
r(h, pre, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
q AS (SELECT *, row_number() OVER () AS rid FROM p),
m AS (
  SELECT q.rid, max_by(h || pre, length(h || pre)) AS rule, max_by(action, length(h || pre)) AS action
  FROM q JOIN r ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, pre) GROUP BY q.rid)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.action, 'allow') AS verdict FROM q LEFT JOIN m USING (rid)
"""
