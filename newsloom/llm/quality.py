"""Quality scores by Bradley-Terry ranking of preference pairs.

A document of label 1 beats a document of label 0. From a bounded sample of labelled documents, pairs of a winner and
a loser give differences of their features; logistic loss on these differences, without an intercept, gives
the weights (Bradley-Terry with scores linear in the features). The threshold is the quantile of the sample's scores at the
share of label 0 in it. Every document then gets ``sigmoid((score - threshold) / scale)``.

The fit sees at most ``SAMPLE`` labelled rows, taken in the order of a hash of their id, and ``PAIRS`` pairs. Scores use
the text alone, whole.

Defined cases: a null or empty text has all features zero and is scored like any other; without both labels the weights are
zero, every score 0.5 and every prediction 1; null labels teach nothing; repeated rows each get their row; extra columns
pass through unless they are named like the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store
from newsloom.llm.bytesets import SPACE_SEPARATED, sequence_hashes, text_chunks, word_bounds, word_hashes
from newsloom.llm.language_id import fold

SAMPLE = 12_000
PAIRS = 60_000
RIDGE = 1e-3

_CLASSES = {
    "digits": range(0x30, 0x3A), "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "beyond_ascii": range(0x80, 0x100),
    "newline": [0x0A], "space": [0x20], "stop": b".?", "comma": b",;:", "bang": b"!", "bars": b"|", "brackets": b"()[]{}<>", "marks": b"#$%&*+-/=@\\^_~`\"'",
}
_TABLES = [np.isin(np.arange(256), list(v)) for v in _CLASSES.values()]
_SHARES = ["repeated_next", "distinct", "distinct_pairs", "distinct_threes", "short", "long"]
FEATURES = [*_CLASSES, "any_upper", "word_length", *_SHARES, "log_words", "log_distinct", "words_per_line", "words_per_stop", "one_word_sentences"]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text."""
    mixed = np.unique(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(doc[mixed], minlength=n).astype(np.float64)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = []
    for _, data, offsets in text_chunks(column):
        n = len(offsets) - 1
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)
        shares = [_per_text(t[data], offsets) / size for t in _TABLES]
        starts, ends, first = word_bounds(data, offsets, SPACE_SEPARATED)
        words, counts = word_hashes(data, starts, ends), np.diff(first)
        doc = np.repeat(np.arange(n), counts)
        some = np.maximum(counts, 1).astype(np.float64)
        length = ends - starts
        inner = (doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, bool)
        same = inner & (words[1:] == words[:-1]) if len(doc) > 1 else inner
        columns = [np.bincount(doc[1:][same], minlength=n) / some if len(doc) > 1 else np.zeros(n), _distinct(words, doc, n) / some]
        for k in (2, 3):
            runs = sequence_hashes(words, k)
            whole = doc[: len(runs)] == doc[k - 1 :] if len(runs) else np.zeros(0, bool)
            columns.append(_distinct(runs[whole], doc[: len(runs)][whole], n) / np.maximum(counts - k + 1, 1))
        columns += [_per_text(length <= 2, first) / some, _per_text(length >= 15, first) / some]
        lines, stops = shares[4] * size + 1, shares[6] * size + 1
        stopped = np.isin(data[np.maximum(ends - 1, 0)], [0x2E, 0x3F, 0x21]) if len(ends) else np.zeros(0, bool)
        lone = np.zeros(len(stopped), bool)
        lone[1:] = stopped[1:] & stopped[:-1] & inner  # of one text, whatever stands before it
        out.append(np.column_stack([
            *shares, shares[1] > 0.1, _per_text(length, first) / some / 10, *columns,
            np.log1p(counts) / 10, np.log1p(columns[1] * some) / 10, np.log1p(counts / lines) / 5, np.log1p(counts / stops) / 5, _per_text(lone, first) / some,
        ]) * (np.diff(offsets) > 0)[:, None])
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Ranking:
    """A fitted score: standardised features times weights, and where to cut it."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((z - self.threshold) / self.scale, -40, 40)))


def fit_ranking(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, rounds: int = 25) -> Ranking:
    """Bradley-Terry weights by Newton steps on at most ``pairs`` differences."""
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    none = Ranking(mean, spread, np.zeros(len(FEATURES)), 0.0, 1.0)
    up, down = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(up) or not len(down):
        return none
    z = np.clip((x - mean) / spread, -8, 8)
    draw = np.random.default_rng(1)
    n = min(pairs, len(up) * len(down))
    d = z[draw.choice(up, n)] - z[draw.choice(down, n)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ p / n - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return Ranking(mean, spread, w, float(np.quantile(s, len(down) / len(s))), float(s.std() / 6 + 1e-9))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Ranking:
    """Fit on a bounded sample of the labelled documents."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label IN (0, 1) AND _id IS NOT NULL")
    chosen = marked.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_label").limit(sample)  # a bounded top-k
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("_print")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_label"), batch.column("_print"), pa.array(list(x), pa.list_(pa.float64()))], ["_id", "_label", "_print", "x"])

    rows = found.mapInArrow(run, "_id string, _label int, _print string, x array<double>")
    rows = rows.groupBy("_id", "_label").agg(F.min_by("x", "_print").alias("x")).toPandas().sort_values(["_id", "_label"])
    x = np.array(rows.x.tolist()).reshape(len(rows), len(FEATURES))
    return fit_ranking(x, rows._label.to_numpy())


def score(docs: DataFrame, ranking: Ranking, text_col: str = "text", keep_text: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted (or the names given); the text comes back from the tasks only if asked for."""
    kept = [c for c in docs.columns if c not in names and (keep_text or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(features(batch.column(source)))
            rest = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*kept, *names])

    source = text_col if keep_text else f"{store.RESERVED}text"
    frame = docs.select(*kept) if keep_text else docs.select(*kept, F.col(text_col).cast("string").alias(source))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[: len(kept)])
    return frame.mapInArrow(run, f"{fields + ', ' if fields else ''}`{names[0]}` double, `{names[1]}` int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels outside the held-out third."""
    docs = store.table(spark, sf_dir, "documents")
    held = fold("doc_id", 3) == 1
    ranking = fit(docs, store.table(spark, sf_dir, "labels").where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), ranking)
