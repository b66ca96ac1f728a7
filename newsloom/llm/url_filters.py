"""URL filters by a sort-merge range join on reversed-host keys.

The key of a url is its host's labels from the last to the first, each with a dot, then the path:
``blog.site.example/a`` has ``example.site.blog./a``. All urls of a host and of its subdomains lie in one interval of
keys, which starts with the host's reversed form; intervals of several hosts nest or are disjoint. Urls and rules
are dealt into ranges of keys (a rule to every range that its interval meets), sorted, and swept once: a stack holds
the rules of the hosts that enclose the current key, and the longest rule on it whose path fits decides.

Defined cases: a url that is null or has no ``://`` has an empty host and path and gets the default; of two rules
of equal length the longer host wins, then block; an empty rule table gives the default to all; repeated rows and
extra columns pass through, columns of the pages that clash with names made here are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
#: Cut points of the key ranges come from this many sampled keys, whatever the input.
SAMPLED_KEYS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr("1"))
    rest = F.substring_index(url, "://", 1)
    tail = url.substr(F.length(rest) + 4, F.length(url))
    host = F.when(after.isNotNull(), F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), UPPER, LOWER))
    path = F.when(after.isNotNull(), F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range and key, rules before urls of the same key."""
    stack: list[tuple[str, dict[str, tuple[int, int, int, str, str]], list[int]]] = []
    at = None
    for batch in batches:
        out = []
        for row, part, key, is_url, host, path, verdict in zip(
            batch._row, batch._range, batch._key, batch._is_url, batch.host, batch.path, batch.verdict, strict=True
        ):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                strength = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
                paths[path] = max(strength, paths.get(path, strength))
                lengths[:] = sorted({*lengths, len(path)})
                continue
            best = None
            for _, paths, lengths in stack:
                for n in lengths:
                    if n > len(path):
                        break
                    found = paths.get(path[:n])
                    if found and (best is None or found > best):
                        best = found
            out.append((row, host, path, best[3] if best else None, best[4] if best else None))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, the rule that decides (null if none) and the verdict.

    rules has host, path and verdict. Memory: a task holds one batch and the rules of one chain of enclosing hosts.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("string").alias("_row"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("_key", F.concat(reversed_host(F.col("host")), "path"))
    total = urls.count()
    sample = urls.select("_key").sample(min(1.0, 2 * SAMPLED_KEYS / max(total, 1)), 7).limit(2 * SAMPLED_KEYS).collect() if total else []
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = sorted(r[0] for r in sample)
    cuts = np.array([keys[i * len(keys) // n] for i in range(1, n)] if len(keys) >= n else sorted(set(keys)), dtype=object)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        """A key that is a cut several times may lie in any of the ranges between; its rows are dealt over them."""
        low, high = np.searchsorted(cuts, key.to_numpy(), "left"), np.searchsorted(cuts, key.to_numpy(), "right")
        return pd.Series(low + np.abs(salt.to_numpy()) % (high - low + 1))

    @F.pandas_udf("array<int>")
    def ranges_of(start: pd.Series) -> pd.Series:
        low = np.searchsorted(cuts, start.to_numpy(), "left")
        high = np.searchsorted(cuts, (start + "\U0010ffff").to_numpy(), "right")
        return pd.Series([list(range(a, b + 1)) for a, b in zip(low, high, strict=True)])

    urls = urls.select("_row", range_of("_key", F.xxhash64("_row")).alias("_range"), "_key", F.lit(True).alias("_is_url"), "host", "path", F.lit("").alias("verdict"))
    starts = rules.select("host", "path", "verdict").withColumn("_key", reversed_host(F.col("host")))
    starts = starts.select(F.lit(None).cast("string").alias("_row"), F.explode(ranges_of("_key")).alias("_range"), "_key", F.lit(False).alias("_is_url"), "host", "path", "verdict")
    swept = (
        urls.unionByName(starts)
        .repartition("_range")
        .sortWithinPartitions("_range", "_key", "_is_url")
        .mapInPandas(_sweep, "page_id string, host string, path string, rule string, verdict string")
    )
    return swept.select(F.col("page_id").cast(pages.schema[id_col].dataType).alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four production rules on every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(store.table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS tail FROM pages
), h AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(rule_host, rule_path, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT h.page_id, h.host, h.path, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM h LEFT JOIN r ON ('.' || h.host) LIKE ('%.' || rule_host) AND starts_with(h.path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
