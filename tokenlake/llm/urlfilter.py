"""URL filters by hash prefixes, in DataFrame operations only.

Each URL is expanded into expressions: suffixes of its host, of the numbers of labels that the rules' hosts have, times prefixes of its path, of the
lengths that the rules' paths have.  Expressions meet rules in an equi-join on the first bytes of their digests; full digests
confirm a meeting, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join compares.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages.

    rules: (host, path, verdict) with verdict allow or block.  A rule fits its host and all subdomains where the path starts with the rule's; of
    the fitting rules the one with the longest text (host and path) wins, then the one with the longer host, then block before allow.
    No fitting rule: rule is null and the verdict is the default, as for a URL on no list.  A null URL, or one without `://`, has
    an empty host and path and fits no rule with a host.  Repeated rows are judged each; rules with a null part are ignored; repeated rules count once.
    """
    listed = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna().distinct()
    shapes = listed.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    listed = listed.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, PREFIX))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    hosts = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(shapes["labels"])]
    paths = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes["lengths"])]
    if not hosts:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    expanded = rows.withColumn("suffix", F.explode_outer(F.array_compact(F.array(*hosts)))).withColumn("prefix", F.explode_outer(F.array_compact(F.array(*paths))))
    expanded = expanded.withColumn("own", _digest(F.col("suffix"), F.col("prefix"))).withColumn("own_short", F.substring("own", 1, PREFIX))
    met = expanded.join(listed, expanded["own_short"] == listed["short"], "left")
    text = F.concat("rule_host", "rule_path")
    best = F.max(F.when(F.col("own") == F.col("full"), F.struct(F.length(text).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))))
    judged = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
