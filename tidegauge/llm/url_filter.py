"""URL rules by hashed host-suffix / path-prefix expressions (operator 3).

Each URL is expanded into the expressions a rule could be written as (a suffix
of its host at a label boundary, joined with a prefix of its path), an
equi-join on short hash prefixes finds candidate rules, full digests confirm
them, and the longest confirmed rule decides.

Only such suffixes and prefixes are formed as some rule could equal: the label
counts and path lengths that occur in the rule table. Their number depends on
the rules, never on the pages, so a long URL expands no further than a short one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table

DEFAULT_VERDICT = "allow"
#: Bits of the digest that the join compares first.
PREFIX_BITS = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_BITS // 4), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """Normalise (verdict, host, path) rules: lower-cased host, one verdict per expression (block wins a tie)."""
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select(host.alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.filter("r_host <> ''").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return rules.select("*", digest.alias("r_digest"), _prefix(digest).alias("r_key"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every URL of ``pages``; returns id, host, path, rule, verdict and n_rules, how many rules fit.

    A rule fits its host and every subdomain when the URL's path starts with
    the rule's path. The longest rule (host and path together) wins; between
    equally long ones ``block`` wins, then the greater text. URLs that no rule
    fits get ``default`` and a null rule. Null URLs and URLs without ``://``
    have an empty host and path and fit no rule. Repeated rows are judged one
    by one, empty tables give an empty result, other columns are ignored.

    The rules' distinct label counts and path lengths come to the driver; both
    are bounded by the rule table, which is a parameter, not by ``pages``.
    """
    ruled = rule_table(rules)
    shape = ruled.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    base = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url")).select(
        id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    base = base.withColumn("_row", F.monotonically_increasing_id())
    exprs = base.select("_row", id_col, "host", "path", F.explode_outer(_expressions(sorted(shape["labels"]), sorted(shape["lengths"]))).alias("_e"))
    digest = _digest(F.col("_e.h"), F.col("_e.p"))
    exprs = exprs.withColumn("_d", digest).withColumn("_k", _prefix(F.col("_d")))
    joined = exprs.join(ruled, (F.col("_k") == F.col("r_key")) & (F.col("_d") == F.col("r_digest")), "left")
    rank = F.when(F.col("r_digest").isNotNull(), F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule")))
    judged = joined.groupBy("_row", id_col, "host", "path").agg(F.max(rank).alias("best"), F.count("r_digest").alias("n_rules"))
    return judged.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"), "n_rules"
    )


def _expressions(labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """All (host suffix, path prefix) pairs of a URL that have a rule's label count and path length."""
    parts = F.size(F.split("host", r"\."))
    pairs = [
        F.when(
            (F.col("host") != "") & (parts >= n) & (F.length("path") >= m),
            F.struct(F.substring_index("host", ".", -n).alias("h"), F.substring("path", 1, m).alias("p")),
        )
        for n in labels for m in lengths
    ]
    return F.array_compact(F.array(*pairs)) if pairs else F.lit(None).cast("array<struct<h:string,p:string>>")


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path) tuples."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    if not rows:
        return spark.createDataFrame([], "verdict string, host string, path string")
    return spark.range(1).select(F.inline(F.array(*rows)))


#: Fixed values of the query's rule set: verdict, host, path.
QUERY_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, rules_frame(spark, QUERY_RULES))


SQL = """
WITH rules(verdict, h, p) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT row_number() OVER () AS n, page_id,
        CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT n, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT v.n, h || p AS rule, verdict,
        row_number() OVER (PARTITION BY v.n ORDER BY length(h || p) DESC, verdict DESC, h || p DESC) AS k,
        count(*) OVER (PARTITION BY v.n) AS n_rules
      FROM v JOIN rules ON (v.host = h OR ends_with(v.host, '.' || h)) AND starts_with(v.path, p))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict, coalesce(m.n_rules, 0) AS n_rules
FROM v LEFT JOIN m ON m.n = v.n AND m.k = 1
"""
