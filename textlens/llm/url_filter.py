"""URL filters: host-suffix / path-prefix expressions, short hash prefixes, full digests, rule precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, table

#: Rule lists up to this many rows are broadcast; longer ones are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 200_000
#: Hex digits of the SHA-256 digest that the equi-join uses.
PREFIX_DIGITS = 8
#: The rules of op10: (action, host, path).
OP10_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_PARTS = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    rules: (action, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's path;
    of those that fit, the longest (host and path together) wins, equal lengths by text, then `block` before `allow`.
    No rule: rule is null and the verdict is `default`.

    Each distinct (host, path) is expanded into host suffixes by label and into path prefixes of the lengths that the rules
    have, joined to the rules on the first digits of a SHA-256 digest, and confirmed by the full digest. So repeated urls
    and a host with a third of all rows cost one expansion, and repeated rows stay repeated.
    Null, empty and malformed urls have an empty host and path, which no rule fits unless its host and path are empty.
    Null hosts or paths in a rule count as empty. Other columns stay; input columns named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    rules = rules.select(
        F.col("action").alias("r_action"), F.coalesce(F.translate("host", UPPER, LOWER), F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")
    ).withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    size = rules.groupBy(F.length("r_path").alias("n")).agg(F.count("*").alias("rows")).collect()  # path lengths: a few dozen values
    lengths = sorted(r["n"] for r in size)
    if sum(r["rows"] for r in size) <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).select(*keep, "host", "path")

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    wide = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array(F.lit(None).cast("string"))
    tries = (
        rows.select("host", "path").distinct()
        .withColumn("e_host", F.explode(suffixes))
        .withColumn("e_path", F.explode(F.array_compact(wide)))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
    )
    best = (
        tries.join(rules, (F.substring("e_digest", 1, PREFIX_DIGITS) == F.col("r_prefix")) & (F.col("e_digest") == F.col("r_digest")))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("len"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action"))).alias("hit"))
    )
    return (
        rows.join(best, ["host", "path"], "left")
        .select(*keep, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(OP10_RULES, "action string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
m AS (
  SELECT u.*, r.action, r.rhost || r.rpath AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC, r.rhost || r.rpath DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
