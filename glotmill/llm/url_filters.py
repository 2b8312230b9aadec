"""URL filters: host-suffix and path-prefix expressions matched by hash prefix, then by full digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import ascii_lower, take

#: (host, path, verdict) of the rules that the registered query applies.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hex digits of a digest's prefix on which URLs and rules meet.
PREFIX_DIGITS = 8
#: Rule tables may have at most so many different (labels, path length) shapes; a URL makes one expression for each.
MAX_SHAPES = 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Both are empty if url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(raw), path


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The rules as a DataFrame of host, path and verdict."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Judge every row of pages: key, host, path, rule, verdict.

    A rule fits its own host and all subdomains if the URL's path starts with the rule's path. The
    longest rule (host and path together) wins; among equally long ones the one with the longer
    host, then block over allow. rule is null and verdict is `default` where no rule fits.

    Rows aren't merged or lost: null or odd URLs have empty host and path and get the default, and
    repeated rows and null keys each give their row. Extra columns are ignored. Rules with null
    parts are ignored, as are pages tables without rows (the result is then empty).

    Plan: distinct (host, path) pairs make one expression for each (number of host labels, path
    length) that occurs among the rules; expressions meet rules by equality of a digest's prefix,
    the full digest confirms, the best rule of each pair is found by a pre-aggregated maximum and
    joined back by equality. Spark splits a hot URL's rows in that join; nothing is broadcast
    unless Spark has measured it as small.
    """
    rules = take(rules, "host", "path", "verdict").dropna().withColumn("host", ascii_lower(F.col("host")))
    shapes = [tuple(r) for r in rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} shapes of rules")
    host, path = url_parts(F.col(url))
    rows = take(pages, key, url).select(key, host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = [
        F.when(F.length("path") >= n, F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k, n in sorted(shapes)
    ]
    said = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_compact(F.array_distinct(F.array(*fits)))).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    rule = F.concat("host", "path")
    known = rules.select(
        F.sha2(rule, 256).alias("rule_digest"),
        F.substring(F.sha2(rule, 256), 1, PREFIX_DIGITS).alias("short"),
        F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), rule.alias("rule"), "verdict").alias("rank"),
    )
    best = (
        said.join(known, "short").where("digest = rule_digest")
        .groupBy("host", "path").agg(F.max("rank").alias("best"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
