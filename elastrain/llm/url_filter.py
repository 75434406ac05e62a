"""URL filtering against host and path rules, by hash join of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Distinct (host, path) of the urls with rule (host and path of the winning rule, or null) and verdict.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains if the path starts with
    the rule's. The longest rule wins; of equally long ones that with the longer host, then 'block'.
    Null urls and urls without '://' have empty host and path, which only a rule for them could fit.
    Distinct pairs are judged once, so a host or page with very many rows costs no more than one.
    """
    rule = rules.select(
        F.coalesce(F.col("host"), F.lit("")).alias("rule_host"), F.coalesce(F.col("path"), F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).distinct()
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    rule = rule.withColumn("full", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, 8))
    lengths = rule.agg(F.coalesce(F.sort_array(F.collect_set(F.length("rule_path"))), F.array().cast("array<int>")).alias("cuts"))

    urls = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # One row of cut lengths, at most as many numbers as a path has characters.
    cuts = lengths.first()["cuts"]
    prefixes = F.transform(
        F.filter(F.lit(cuts) if cuts else F.array().cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select(
        "host", "path", "suffix", F.explode("prefixes").alias("prefix")
    )
    expressions = expressions.select("host", "path", digest(F.col("suffix"), F.col("prefix")).alias("own")).withColumn(
        "short", F.substring("own", 1, 8)
    )
    fits = expressions.join(rule, "short").where("own = full")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
        F.col("rule_verdict").alias("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict; ``default`` where no rule fits. Rows that repeat are each judged."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path")
    )
    return rows.join(judge_urls(pages, rules, url_col, default), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
