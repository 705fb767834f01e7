"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

# The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PREFIX = 8  # hex digits of the digest that are joined on


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path. Null, or without `://`: both empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict.

    rules: (host, path, action). A rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest (host and path together, then
    host, then the text) wins; `block` wins between equal ones. Rules with a null
    part are ignored. Equal urls are looked up once, by suffixes of as many labels and prefixes of
    as many characters as rules have, so that a very long url costs no more than the rules' own lengths. Null
    and malformed urls have no host and get the default. Repeated rows stay. Columns of df that are named
    host, path, rule or verdict are replaced.
    """
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rules = rules.where("host is not null and path is not null and action in ('block', 'allow')").select(
        F.lower("host").alias("r_host"), F.col("path").alias("r_path"), "action", F.sha2(F.concat_ws("\n", F.lower("host"), "path"), 256).alias("r_digest")
    )
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())  # at most as many as the longest path has characters
    depths = sorted(r[0] for r in rules.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect())  # at most as many as the longest host has labels
    rules = small(rules.withColumn("short", F.substring("r_digest", 1, PREFIX)))
    parsed = host_and_path(df.select(*keep), url)
    urls = parsed.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    held = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= F.size("labels"))
    suffixes = F.transform(held, lambda n: F.array_join(F.slice("labels", -n, n), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))
    x = urls.withColumn("labels", labels).select("host", "path", F.explode(suffixes).alias("suffix")).select("*", F.explode(prefixes).alias("prefix"))
    x = x.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    x = x.join(rules, "short").where("digest = r_digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "action")
    best = x.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = parsed.join(small(cut(best)), ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
