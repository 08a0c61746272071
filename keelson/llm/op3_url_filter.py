"""URL filtering by host-suffix and path-prefix rules (DataFrame functions only).

Each url is expanded into every (host suffix, path prefix) expression that a rule could name. Expressions and rules are
equi-joined on the first PREFIX bytes of their SHA-256 alone; a prefix brings the list of its rules, in which the full
digests then confirm, and the longest confirmed rule wins.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and gets the default
verdict. Of rules of equal length (host and path together) the one with the longer host wins, then the later in the order
(host, path, verdict). Rules and urls may be of any length; a url has as many expressions as it has host labels times
rule path lengths that it reaches. Repeated pages each get a row. An empty table gives no row. Further columns of the
input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize

#: Rules of the contract: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Bytes of a digest that expressions and rules are joined on.
PREFIX = 4
#: Rules whose hosts, paths and digests take so many bytes at most are broadcast; more meet the distinct expressions in a shuffle.
BROADCAST_BYTES = 32 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; path then up to "?" or "#"."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, whole, 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix: int = PREFIX) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; rules: rule_host, rule_path, rule_verdict."""
    held = F.octet_length("rule_host") + F.octet_length("rule_path") + 100
    size, lengths = rules.agg(F.coalesce(F.sum(held), F.lit(0)), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    host, path = split_url(F.col("url"))
    page = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).drop("url")
    default_row = ("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not lengths:
        return page.select(*default_row)
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"), "rule_host", "rule_path", "rule_verdict")
    keyed = rules.select(F.substring(digest, 1, prefix).alias("bucket"), F.struct(digest.alias("digest"), rank.alias("rank")).alias("rule")).groupBy("bucket").agg(F.collect_set("rule").alias("rules"))
    # A url's expressions stay with its row, so no host or url, however hot, is a key of any shuffle; urls without a host
    # have none.
    rows = page.withColumn("row", F.monotonically_increasing_id())
    if size > BROADCAST_BYTES:
        rows = materialize(rows, "url-rows")  # read more than once below
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    both = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda p: _digest(h, p)))))
    expressions = rows.withColumn("digest", F.explode_outer(both)).withColumn("bucket", F.substring("digest", 1, prefix))
    confirmed = F.array_max(F.transform(F.filter("rules", lambda r: r["digest"] == F.col("digest")), lambda r: r["rank"]))
    if size <= BROADCAST_BYTES:
        met = expressions.join(F.broadcast(keyed), "bucket", "left").withColumn("best", confirmed)
    else:
        # Each distinct expression meets the rules once; then rows find theirs, the hottest of them by broadcast.
        each = expressions.where(F.col("digest").isNotNull()).groupBy("bucket", "digest").agg(F.count("*").alias("n"))
        known = materialize(each.join(keyed, "bucket").select("digest", "n", confirmed.alias("best")).where("best IS NOT NULL"), "url-rules")
        met = attach(expressions, known, "digest", "left")
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max("best").alias("best"))
    return best.select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


ORACLE = """
WITH rules(rh, rp, rv) AS (VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),('example.net','/de/8','block'),('org','/es/','block')),
 a AS (SELECT page_id, CASE WHEN strpos(url,'://')>0 THEN substr(url, strpos(url,'://')+3) ELSE '' END AS rest FROM pages),
 b AS (SELECT page_id, translate(regexp_extract(rest,'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest,'^[^/?#]*([^?#]*)',1) AS path FROM a),
 c AS (SELECT DISTINCT host, path FROM b),
 d AS (SELECT host, path, rh||rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh||rp) DESC, length(rh) DESC, rh DESC, rp DESC) AS n
       FROM c JOIN rules ON (host = rh OR suffix(host, '.'||rh)) AND starts_with(path, rp))
SELECT b.page_id, coalesce(b.host,'') AS host, coalesce(b.path,'') AS path, d.rule, coalesce(d.rv,'allow') AS verdict
FROM b LEFT JOIN d ON d.n = 1 AND d.host = b.host AND d.path = b.path
"""
