"""URL filters: which rule of a list of (host, path) rules decides about a URL.

A URL is expanded into the expressions that a rule for it could have (host suffixes at label borders x path prefixes);
expressions meet rules by an equi-join on a short hash prefix, then by the full SHA-256 digest; the longest rule wins.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join

#: A rule list of at most so many rows is sent to every executor; a longer one is joined by a shuffle.
MOST_SENT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host after the first "://" up to "/", "?" or "#", A-Z lower-cased; path then up to "?" or "#". Empty for null or no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_bits: int = 32) -> DataFrame:
    """The rule and verdict for every URL.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's path; of
    those that fit, the one with the longest host + path wins, then the longer host, then block before allow. Returns (id, host, path,
    rule, verdict), one row for each input row; rule is null and verdict is `default` where no rule fits. Null URLs and URLs
    without "://" have empty host and path and fit no rule; repeated rows, repeated and null ids are kept; an empty rule
    list or table is fine; other columns are not looked at.

    Only different (host, path) pairs are expanded, so a host with a third of all pages costs one expansion for each of its
    paths, and a URL that a third of all pages have isn't sent to one task. Expansions are bounded by the rules: as many labels, and the path lengths, that occur
    among them. The join's key is the short hash prefix; the few rules that share one are told apart by their digests.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rules = rules.where("host is not null and path is not null").select(
        F.col("verdict").alias("rule_verdict"), F.lower("host").alias("rule_host"), F.col("path").alias("rule_path")
    )
    shape = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("rule_host", r"\.", -1))), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    n_rules, labels, lengths = shape[0], shape[1] or 1, shape[2] or [0]

    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    short = lambda d: F.conv(F.substring(d, 1, prefix_bits // 4), 16, 10).cast("long")
    rules = rules.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", short(F.col("digest")))
    rules = rules.groupBy("short").agg(F.collect_list(F.struct("digest", "rule_host", "rule_path", "rule_verdict")).alias("alike"))  # rules of one hash prefix
    if n_rules <= MOST_SENT:
        rules = F.broadcast(rules)

    parts = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(labels))), lambda n: F.array_join(F.slice("parts", -n, n), "."))
    fits = [n for n in lengths]
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in fits]), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    urls = urls.withColumn("page", F.unhex(F.md5(F.concat("host", "path"))))  # of fixed width; no host holds the "/" that begins a path
    keys = urls.groupBy("page", "host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts)
    asked = keys.select("page", "path", F.explode(hosts).alias("h"), paths.alias("ps")).select("page", "h", F.explode("ps").alias("p"))
    asked = asked.withColumn("asked", digest(F.col("h"), F.col("p"))).withColumn("short", short(F.col("asked")))
    hits = asked.join(rules, "short").select("page", "asked", F.explode("alike").alias("r")).where(F.col("asked") == F.col("r.digest"))
    rank = F.struct(F.length("r.rule_host") + F.length("r.rule_path"), F.length("r.rule_host"), F.col("r.rule_verdict") == "block", F.col("r.rule_host"), F.col("r.rule_path"))
    best = hits.groupBy("page").agg(F.max_by(F.struct(F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.rule_verdict").alias("rule_verdict")), rank).alias("best"))
    found = keys.select("page", "n").join(best, "page", "left")
    out = hot_join(urls, found, "page", "n", pages.count(), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
