"""URL filters by expression hashes, in DataFrame functions only.

Every distinct URL is expanded into host-suffix and path-prefix expressions, equi-joined with the rules on a short
prefix of the expression's digest, and confirmed by the full digest; then the longest rule wins.

Defined cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict; repeated
rows get equal verdicts; of two rules with the same host and path, block wins; an empty table gives an empty result;
no rules give everything the default, and a null rule fits nothing; extra columns of any name are kept, and ``host``,
``path``, ``rule`` and ``verdict`` replace columns of those names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.columns import as_row, row_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest on which URLs and rules meet (32 bits).
SHORT = 8
#: Fixed rule list of the registered query: (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rule lists up to this length are broadcast.
MAX_BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows of a list, which is one literal of the plan; longer lists should be tables."""
    rows = json.dumps([{"verdict": v, "rule": r} for v, r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<verdict string, rule string>>")))


def _keyed(rules: DataFrame) -> DataFrame:
    """(verdict, rule, size, host_size, head, short, digest) of (verdict, rule); ``head`` is the length of the path."""
    digest, host_size = F.sha2("rule", 256), F.length(F.substring_index("rule", "/", 1))
    sizes = [F.length("rule").alias("size"), host_size.alias("host_size"), (F.length("rule") - host_size).alias("head")]
    return rules.where("rule is not null").select("verdict", "rule", *sizes, F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"))


def expressions(parts: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(url, expression): every suffix of the host at a label, with every path prefix of one of the rules' lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return parts.select("url", F.explode(suffixes).alias("suffix"), heads.alias("heads")).select("url", "suffix", F.explode("heads").alias("head")).select("url", F.concat("suffix", "head").alias("expression"))


REPLACED = ("host", "path", "rule", "verdict")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """``pages`` (with ``url``) with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` is a list or (verdict, rule) rows.

    Each distinct URL is judged once, so that a URL which fills a third of the table costs one row; the verdicts join
    back on the URL, where adaptive execution splits a hot one. The rules are counted, and broadcast only up to
    ``MAX_BROADCAST_RULES``; the lengths of their paths, of which there are few, come to the driver.
    """
    host, path = url_parts(F.col("url"))
    own = pages.select(F.col("url").cast("string").alias("url"), as_row(pages, REPLACED).alias("row"))
    parts = own.select("url").distinct().where(F.col("url").isNotNull()).select("url", host.alias("host"), path.alias("path"))
    table = _keyed(rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    known = table.groupBy("head").count().orderBy("head").collect()
    table = F.broadcast(table) if sum(r["count"] for r in known) <= MAX_BROADCAST_RULES else table
    found = expressions(parts, [r["head"] for r in known]) if known else parts.select("url", F.lit("").alias("expression")).where("false")
    found = found.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, SHORT)).join(table, "short").where(F.col("full") == F.col("digest"))
    best = F.max(F.struct("size", "host_size", (F.col("verdict") == "block").alias("block"), "rule", "verdict"))
    best = found.groupBy(F.col("url").alias("judged")).agg(best.alias("best"))
    # null URLs get keys that match nothing, so that they don't all meet in one task; no rule fits a URL without scheme
    key = F.coalesce(F.col("url"), F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string")))
    joined = own.withColumn("key", key).join(best, F.col("key") == F.col("judged"), "left")
    verdict = F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    return joined.select(*row_columns(pages, REPLACED), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), verdict)
