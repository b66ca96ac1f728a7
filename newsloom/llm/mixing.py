"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed for each cell of source, language and topic. Raking scales the cells in turn to the target weights of each
margin until all agree; then each cell has a weight, and its documents are kept with probability
``scale * weight / tokens``, at most 1, with the scale that meets the token budget. A document's draw is a hash of its id,
so the sample is the same on every run.

Topics are clusters of the texts. Words are hashed to ``BUCKETS``; their document frequencies over all documents give weights, a fixed random
projection of a text's weighted distinct words its vector, from which the mean of its language is taken away, so that topics do not
repeat the languages. Spherical k-means over all vectors gives ``TOPICS`` topics; only the starting centres come from a bounded sample.

The table of cells is a DataFrame throughout; a raking round is one pass of grouped sums and joins, and ends in a written
table. Only sums of errors reach the driver. Cells without tokens take no part. Targets that no weights meet (margins that contradict
each other where cells are empty) leave a residual, which ``mixed`` returns, or raises if asked to be strict.

Defined cases: a null source, language or topic is a value of its own; a text without words has no topic and no tokens, and is kept with its cell's
probability, or certainly if the cell has no tokens; equal ids of a cell share a fate; targets for unknown values are ignored and values without a target keep
their share; ids may be of any type; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store
from newsloom.llm.bytesets import SPACE_SEPARATED, text_chunks, word_bounds, word_hashes

MARGINS = ["source", "lang", "topic"]
#: Default targets: each value's share of tokens to this power, so that large ones give way to small ones.
TEMPER = 0.7
#: Default budget: this share of all tokens.
BUDGET = 0.6
ROUNDS = 40
TOLERANCE = 1e-3
TOPICS = 8
BUCKETS = 4096
DIMENSIONS = 32
#: k-means: starting centres come from this many vectors, in the order of a hash; rounds over all vectors.
STARTS, LLOYD_ROUNDS = 1024, 6
_NONE = "(none)"
_PROJECTION = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32) / np.float32(np.sqrt(DIMENSIONS))


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each text, row and bucket of its distinct buckets), a chunk of texts at a time."""
    for row, data, offsets in text_chunks(column):
        starts, ends, first = word_bounds(data, offsets, SPACE_SEPARATED)
        counts = np.diff(first)
        bucket = (word_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
        seen = np.unique(np.repeat(np.arange(len(counts)), counts) * BUCKETS + bucket)
        yield row, counts, seen // BUCKETS, seen % BUCKETS


def bucket_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of the hashed words over all documents; BUCKETS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, counts, _, bucket in _words(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
                n += int((counts > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate(([n], total)))], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, rows.collect()))
    n = found.get(-1, 0)
    return np.array([np.log((n + 1) / (found.get(b, 0) + 1)) for b in range(BUCKETS)], np.float32)


def _key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id, text, source and language."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(_NONE)) for c in (id_col, text_col, *MARGINS[:2])]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2")]


def text_vectors(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, source, lang, n_tokens, v) of every document; v is null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = _PROJECTION * shared.value[:, None]
        for batch in batches:
            for row, counts, doc, bucket in _words(batch.column("_text")):
                v = np.zeros((len(counts), DIMENSIONS), np.float32)
                if len(doc):
                    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    v[doc[first]] = np.add.reduceat(scaled[bucket], first, axis=0)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-9))
                vectors = pa.array([x if n else None for x, n in zip(v, counts, strict=True)], pa.list_(pa.float32()))
                rest = [batch.column(i).slice(row, len(counts)) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), vectors], ["id", "k1", "k2", "source", "lang", "n_tokens", "v"])

    margins = [F.coalesce(F.col(m).cast("string"), F.lit(_NONE)).alias(m) for m in MARGINS[:2]]
    frame = docs.select(F.col(id_col).alias("id"), *_key(id_col, text_col), *margins, F.col(text_col).cast("string").alias("_text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, k1 long, k2 long, source string, lang string, n_tokens long, v array<float>")


def _unit(rows: pa.Array) -> np.ndarray:
    v = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def topic_centres(vectors: DataFrame, topics: int = TOPICS, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """Centres of spherical k-means over all vectors (v); a round moves one row a task and topic."""
    start = vectors.select("v").orderBy(F.xxhash64("v")).limit(STARTS).toArrow().column("v").combine_chunks()
    if not len(start):
        return np.zeros((0, DIMENSIONS))
    x = _unit(start)
    centres = x[:1]
    while len(centres) < topics:  # the farthest next
        far = (x @ centres.T).max(1)
        if far.min() > 1 - 1e-6:
            break
        centres = np.concatenate((centres, x[[int(far.argmin())]]))
    for _ in range(rounds):
        now = centres

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(now), DIMENSIONS))
            for batch in batches:
                u = _unit(batch.column("v"))
                np.add.at(total, (u @ now.T).argmax(1), u)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), pa.array(list(total), pa.list_(pa.float64()))], ["k", "s"])

        sums = vectors.select("v").mapInArrow(run, "k long, s array<double>").groupBy("k").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(DIMENSIONS)))
        moved = {row.k: np.array(row[1:]) for row in sums.collect()}
        centres = np.array([moved[k] / n if (n := np.linalg.norm(moved[k])) > 1e-9 else now[k] for k in range(len(now))])
    return centres


def placed_in_topics(docs: DataFrame, tables: store.Tables, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS) -> DataFrame:
    """(id, k1, k2, source, lang, topic, n_tokens) of every document, by two scans of the texts; the rest works on vectors."""
    vectors = tables.write(text_vectors(docs, bucket_weights(docs, text_col), id_col, text_col), "vectors")
    means = vectors.where("v IS NOT NULL").groupBy("lang").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(DIMENSIONS))).alias("m"))
    centred = F.zip_with("v", "m", lambda x, m: (x - m).cast("float"))
    vectors = tables.write(vectors.join(means, "lang", "left").withColumn("v", centred).drop("m"), "centred")
    centres = topic_centres(vectors.where("v IS NOT NULL"), topics)
    columns = ["id", "k1", "k2", "source", "lang", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            some = np.flatnonzero(np.array(v.is_valid()))
            topic = np.full(len(v), _NONE, object)
            if len(some):
                topic[some] = [f"topic {k}" for k in (_unit(v.take(pa.array(some))) @ centres.T).argmax(1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(topic, pa.string())], [*columns, "topic"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*columns).schema.fields)
    return vectors.select(*columns, "v").mapInArrow(run, f"{fields}, topic string")


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """(margin, target): shares of tokens to the power, as shares."""
    by = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    shares = by.select(margin, F.pow(F.col("t"), power).alias("s"))
    total = shares.agg(F.sum("s")).first()[0] or 1.0
    return shares.select(margin, (F.col("s") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tables: store.Tables, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, float]]:
    """cells (margins, tokens > 0) with weight: token weights that fit each margin's target shares; and the largest relative error of each
    margin, under the tolerance unless the rounds ran out."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted, errors = cells.withColumn("weight", F.col("tokens").cast("double")), dict.fromkeys(targets, 0.0)
    for _ in range(rounds):
        for margin, target in targets.items():
            now = fitted.groupBy(margin).agg(F.sum("weight").alias("w"))
            factor = now.join(target, margin, "left").select(margin, F.coalesce(F.col("target") * float(total) / F.col("w"), F.lit(1.0)).alias("f"))
            fitted = fitted.join(factor, margin).withColumn("weight", F.col("weight") * F.col("f")).withColumnRenamed("f", f"f_{margin}")
        before = fitted
        fitted = tables.write(fitted, "cells")
        worst = fitted.agg(*(F.max(F.abs(F.col(f"f_{m}") - 1)).alias(m) for m in targets)).first()
        errors = {m: worst[m] or 0.0 for m in targets}  # of the scaling that was needed, so of the weights before it
        fitted = fitted.drop(*(f"f_{m}" for m in targets))
        tables.drop(before)
        if max(errors.values(), default=0.0) < tolerance:
            break
    return fitted, errors


def probabilities(fitted: DataFrame, budget: float, steps: int = 60) -> tuple[DataFrame, float]:
    """fitted with p: weight / tokens scaled to the budget (a share of all tokens), at most 1; and the expected share less the budget."""
    ratio = F.col("weight") / F.col("tokens")
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    scale = 0.0
    for _ in range(steps):
        full = ratio * scale >= 1
        row = fitted.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        new = (budget * total - (row.full or 0)) / row.rest if row.rest else scale
        if new <= scale * (1 + 1e-9):
            break
        scale = new
    out = fitted.withColumn("p", F.least(F.lit(1.0), ratio * scale))
    met = out.agg(F.sum(F.col("p") * F.col("tokens"))).first()[0] or 0.0
    return out, met / total - budget if total else 0.0


def draw(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit("mixing")), 11) / float(1 << 53)


@dataclass(frozen=True)
class Mix:
    """rows: (id, k1, k2, source, lang, topic, n_tokens, p, kept) of every document; cells: with tokens, weight and p; residuals: the largest relative
    error of each margin's weights, and of the budget."""

    rows: DataFrame
    cells: DataFrame
    residuals: dict[str, float]


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", strict: bool = False) -> Mix:
    """Cells, weights and draws of docs, by ``source``, ``lang`` and topic. Targets are (value, target) for some of MARGINS; strict raises if they are not met."""
    with store.Tables(docs.sparkSession) as tables:
        placed = store.durable(placed_in_topics(docs, tables, id_col, text_col), "placed")
        cells = tables.write(placed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
        named = {m: t.toDF(m, "target") for m, t in (targets or {m: tempered(cells, m) for m in MARGINS}).items()}
        weighted, errors = rake(cells, named, tables)
        scaled, short = probabilities(weighted, budget)
        fitted = store.durable(scaled, "fitted")
    if strict and max(errors.values(), default=0.0) >= TOLERANCE:
        raise ValueError(f"mixing: the targets are not met, largest relative errors {errors}")
    rows = placed.join(fitted.select(*MARGINS, "p"), MARGINS, "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return Mix(rows.withColumn("kept", draw(F.coalesce(F.col("id").cast("string"), F.lit(""))) < F.col("p")), fitted, {**errors, "budget": short})


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept; only keys of the others are joined with them."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = mixed(docs, **options).rows.where("NOT kept").select(F.col("k1").alias(f"{store.RESERVED}k1"), F.col("k2").alias(f"{store.RESERVED}k2"))
    one, two = _key(id_col, text_col)
    keyed = docs.withColumns({f"{store.RESERVED}k1": one, f"{store.RESERVED}k2": two})
    return keyed.join(gone.distinct(), gone.columns, "left_anti").select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its calibrated probability, whether it is in the sample, and the largest residual of the fit."""
    mix = mixed(store.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mix.rows.select(F.col("id").alias("doc_id"), *MARGINS, "n_tokens", "p", "kept", F.lit(float(max(map(abs, mix.residuals.values())))).alias("residual"))
