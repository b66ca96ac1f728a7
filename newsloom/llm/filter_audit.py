"""What each quality filter removes, in every order: a Gray-code walk over the subsets of filters.

Documents are reduced to cells first: for each part (a source) and each mask of failed filters (a bit a filter) the numbers of all, good and toxic documents, at most 32
cells a part. For each part the 32 subsets of active filters are walked in Gray-code order, so that a step toggles one filter. A
counter for each cell says how many active filters it fails; where it leaves or reaches zero, the cell's documents leave or join the running survivors, and these are stored for each
subset. All 120 orders then read their steps off as differences of two stored states.

The filters that read one text are built-in expressions in the scan. The one that compares texts is decided on digests: documents are counted by digest, id, part and label first, and the least id of each digest is joined to
these counts, which adaptive execution splits where a text is repeated very often.

Defined cases: a null text reads as empty, fails A but not B and C (nothing is more than a share of nothing), and equals other empty ones; a null source and an empty one are one part; rows with a null id never fail E and make
no other fail it; rows that share an id and a text are no smaller than each other; a document with several labels is good or toxic if one says so; repeated rows count each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_SHARE, CAPITALS_SHARE = 200, 50, 2
COUNTS = ["n", "good", "toxic"]
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column, words: Column) -> Column:
    """The bits of the filters A to D that a text fails; words: its words."""
    n, letters = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * n, 100 * letters.cast("long") > CAPITALS_SHARE * F.length(text), F.rlike(text, F.lit("[#$%&*|]"))]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the set of filters that they fail. Written."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    narrow = text.select("id", "part", text_failures(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("print"))
    said = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = narrow.join(said, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["print", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy(*keys, "id").agg(F.count("*").alias("n"))
    with store.Tables(docs.sparkSession) as tables:
        groups = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("id").alias("lo"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_lo"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
        groups = tables.write(groups, "texts")
        least = groups.groupBy("print").agg(F.min("lo").alias("least"))
        first = F.col("n_null") + F.when(F.col("lo") == F.col("least"), F.col("n_lo")).otherwise(0)
        both = groups.join(least, "print").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
        number = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
        return store.durable(both.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), number("good"), number("toxic")), "cells")


def gray_states(cells: np.ndarray) -> np.ndarray:
    """(subsets, counts): what survives each subset of active filters; cells: (masks, counts)."""
    masks = np.arange(len(cells))
    fails, alive, active = np.zeros(len(cells), np.int64), cells.sum(0), 0
    states = np.zeros_like(cells)
    states[0] = alive
    for step in range(1, len(cells)):
        bit = step & -step  # the filter that the Gray code toggles
        active ^= bit
        hit = (masks & bit) > 0
        if active & bit:
            alive = alive - cells[hit & (fails == 0)].sum(0)
            fails[hit] += 1
        else:
            fails[hit] -= 1
            alive = alive + cells[hit & (fails == 0)].sum(0)
        states[active] = alive
    return states


def orders_of(cells: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of the filters."""
    states, whole = gray_states(cells), len(cells) - 1
    failing = [int(cells[(np.arange(len(cells)) >> k & 1) > 0, 0].sum()) for k in range(len(filters))]
    unique = [int(states[whole ^ (1 << k), 0] - states[whole, 0]) for k in range(len(filters))]
    out, shapley = [], [0] * len(filters)
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            gone = states[before] - states[after]
            shapley[k] += int(gone[0])
            out.append(("".join(filters[i] for i in order), step, k, int(states[after, 0]), *map(int, gone)))
            before = after
    return [(order, step, kept, removed, failing[k] - removed, unique[k], good, toxic, shapley[k]) for order, step, k, kept, removed, good, toxic in out]


def audit(cells: DataFrame) -> DataFrame:
    """One row for each part, order and step; cells as failure_cells gives them."""

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << len(FILTERS), len(COUNTS)), np.int64)
        table[pdf["mask"].to_numpy()] = pdf[COUNTS].to_numpy()
        return pd.DataFrame([(key[0], *r) for r in orders_of(table)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return cells.groupBy("part").applyInPandas(walk, _OUT)  # 32 rows a part at most


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the five filters, in all orders, for each source."""
    return audit(failure_cells(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM d LEFT JOIN l USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT o, s, o[s] AS x, string_split(o[1:s - 1], '') AS earlier, o[1:s - 1] = '' AS first FROM orders, (SELECT unnest(generate_series(1, 5)) AS s)),
cells AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: fails[k]) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
each AS (
  SELECT part, o, s, x, failed, n, good, toxic, list_contains(failed, x) AS own, CASE WHEN first THEN false ELSE len(list_intersect(failed, earlier)) > 0 END AS gone FROM cells, steps
), counted AS (
  SELECT part, o, s, x, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (own AND len(failed) = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
  FROM each GROUP BY ALL
)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
