"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

Vectors are normalised and rotated; the space is cut into two blocks with a random code of unit vectors each, and a
filter direction is one codeword per block; several rotations give independent codes. List decoding finds all filters whose inner product with a vector exceeds the
cap height: block scores are added block by block, and sums that can no longer reach the height are dropped. Vectors
that share a filter are candidates; those a single-precision product leaves open are verified in double precision.

The cap is so small that a filter holds about ``PER_FILTER`` of as many random vectors; the number of filters follows by
simulation: enough that pairs at the threshold share one with probability ``RECALL``. Equal vectors are one class
throughout, told apart by two 64-bit hashes and numbered. A filter with many vectors is split into blocks that meet pairwise, so a task holds two blocks at most.

Defined cases: a vector that is null, empty or zero, or that holds null or non-finite components, has no links and is its own component; vectors of different lengths
never link; a null id neither links nor is kept; equal rows count as different vectors; labels are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store
from newsloom.llm.components import components

COSINE = 0.9
PER_FILTER = 200
RECALL = 0.995
ROTATIONS = 32
SIMULATED = 2000
#: Filters of a vector beyond which codes are not refined; a recall under ``RECALL`` is then stated by a warning and by ``CodeShape.reached``.
MOST_FILTERS = 2000
#: Vectors of a filter that are verified against one another at a time.
BLOCK = 1024
#: Sums of block scores that are looked at at a time, and pairs that a task holds before it puts out the distinct ones.
DECODED, HELD_PAIRS = 1 << 21, 1 << 20


@dataclass(frozen=True)
class ProductCode:
    rotation: np.ndarray
    codes: list[np.ndarray]  # (codewords, dimensions of the block)
    height: float

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of all filters that exceed the cap height, for unit vectors."""
        turned = unit @ self.rotation
        first = turned[:, : self.codes[0].shape[1]] @ self.codes[0].T
        second = turned[:, self.codes[0].shape[1] :] @ self.codes[1].T if len(self.codes) > 1 else np.zeros((len(unit), 1))
        goal = self.height * math.sqrt(len(self.codes))
        row, left = np.nonzero(first + second.max(1, keepdims=True) >= goal)  # the others can no longer reach the height
        rows, numbers = [], []
        step = max(1, DECODED // second.shape[1])
        for at in range(0, len(row), step):
            r, i = row[at : at + step], left[at : at + step]
            k, j = np.nonzero(first[r, i][:, None] + second[r] >= goal)
            rows.append(r[k])
            numbers.append(i[k] * second.shape[1] + j)
        return (np.concatenate(rows), np.concatenate(numbers)) if rows else (row, left)


@dataclass(frozen=True)
class CodeShape:
    """What the codes are drawn from, so that tasks draw the same: they are not sent. ``reached`` is the simulated recall at the threshold."""

    dims: int
    words: int
    height: float
    rotations: int = ROTATIONS
    reached: float = 1.0

    def codes(self) -> list[ProductCode]:
        """Independent codes of two blocks each: a vector whose weight lies badly for one rotation lies well for another."""
        out = []
        for k in range(self.rotations):
            draw = np.random.default_rng([k, self.dims, self.words])
            rotation = np.linalg.qr(draw.standard_normal((self.dims, self.dims)))[0]
            codes = []
            for part in np.array_split(np.arange(self.dims), min(2, self.dims)):
                c = draw.standard_normal((self.words, len(part)))
                codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
            out.append(ProductCode(rotation, codes, self.height))
        return out


def decode(codes: list[ProductCode], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all codes, numbered apart."""
    rows, filters = zip(*(c.decode(unit) for c in codes), strict=True)
    return np.concatenate(rows), np.concatenate([f.astype(np.int64) + (k << 40) for k, f in enumerate(filters)])


def cap_height(p: float, dims: int) -> float:
    """Inner product that a random unit vector exceeds with probability p: the angle's density is a power of its sine."""
    if dims < 2:
        return 0.0
    angle = np.linspace(0, math.pi / 2, 200_001)[1:]
    share = np.cumsum(np.sin(angle) ** (dims - 2))
    return math.cos(angle[np.searchsorted(share, 2 * min(p, 0.5) * share[-1]).clip(0, len(angle) - 1)])


def product_codes(n: int, dims: int, cosine: float = COSINE, per_filter: int = PER_FILTER, recall: float = RECALL) -> CodeShape:
    """Codes for n vectors: the cap from per_filter / n, codewords until simulated pairs at the threshold meet often enough."""
    draw = np.random.default_rng(dims)
    p = min(0.05, per_filter / max(n, 1))
    u = draw.standard_normal((SIMULATED, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = draw.standard_normal((SIMULATED, dims))
    v -= (u * v).sum(1, keepdims=True) * u
    v = cosine * u + math.sqrt(1 - cosine**2) * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    expected = 8.0
    while True:
        shape = CodeShape(dims, max(2, math.ceil(math.sqrt(expected / ROTATIONS / p))), cap_height(p, dims))
        codes = shape.codes()
        (ru, fu), (rv, fv) = decode(codes, u), decode(codes, v)
        met = len(np.unique(np.intersect1d((ru << 48) + fu, (rv << 48) + fv) >> 48)) / SIMULATED
        if met >= recall:
            return replace(shape, reached=met)
        if expected > MOST_FILTERS:
            warnings.warn(f"{dims} dimensions: pairs at cosine {cosine} share a filter with probability {met:.4f}, under {recall}", stacklevel=2)
            return replace(shape, reached=met)
        expected *= 1.2
        if dims < 16:  # blocks of few dimensions have few directions: widen the caps as well
            p = min(0.5, 1.5 * p)


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Double-precision unit vectors of a list column whose lists are equally long, and the plain vectors."""
    x = lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)
    scaled = x / np.abs(x).max(1, initial=0, keepdims=True)  # squares of huge and tiny components stay finite and above zero
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True), x


def _decode(shape: CodeShape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shape.codes()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                row, found = decode(codes, _units(batch.column("v"))[0])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(batch.column("class").to_numpy()[row])], ["filter", "class"])

    return run


def _verify(cosine: float):
    """Rows sorted by (filter, i, j) to links (a, b) with a < b; of a block met with another only pairs across are new."""

    def pairs(cls: np.ndarray, block: np.ndarray, i: int, j: int, unit: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j))
        close = short[left] @ short[right].T >= cosine - 1e-5
        x, y = np.nonzero(np.triu(close, 1) if i == j else close)
        x, y = left[x], right[y]
        sure = (unit[x] * unit[y]).sum(1) >= cosine  # in double precision
        a, b = cls[x[sure]], cls[y[sure]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[np.ndarray] = []

        def groups(batch: pa.RecordBatch) -> np.ndarray:
            f, i, j = (batch.column(n).to_numpy() for n in ("filter", "i", "j"))
            return np.flatnonzero((f[1:] != f[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1

        def work(batch: pa.RecordBatch) -> None:
            cls, block, i, j = (batch.column(n).to_numpy() for n in ("class", "r", "i", "j"))
            unit = _units(batch.column("v"))[0]
            short = unit.astype(np.float32)
            edges = [0, *groups(batch).tolist(), len(cls)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                found.append(np.column_stack(pairs(cls[s:e], block[s:e], i[s], j[s], unit[s:e], short[s:e])))

        def distinct() -> pa.RecordBatch:
            """The pairs found so far, once each: the filters of a task find many of them again."""
            once = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            cut = groups(joined)
            if not len(cut):
                held = [joined]
                continue
            work(joined.slice(0, int(cut[-1])))
            held = [joined.slice(int(cut[-1]))]
            if sum(map(len, found)) > HELD_PAIRS:
                yield distinct()
        if held:
            work(held[0])
        if found:
            yield distinct()

    return run


def class_links(vectors: DataFrame, n: int, dims: int, cosine: float, tables: store.Tables) -> DataFrame:
    """(a, b) with a < b: linked classes of vectors (class, v) of one length."""
    shape = product_codes(n, dims, cosine)
    decoded = tables.write(vectors.mapInArrow(_decode(shape), "filter long, class long"), "decoded")
    held = decoded.groupBy("filter").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    rows = decoded.join(held, "filter").withColumn("r", F.pmod(F.xxhash64("class", "filter"), F.col("blocks")))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("filter", F.least("r", "s").alias("i"), F.greatest("r", "s").alias("j"), "r", "class").join(vectors, "class")
    rows = rows.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    links = tables.write(rows.mapInArrow(_verify(cosine), "a long, b long").distinct(), "links")
    tables.drop(decoded)
    return links


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(
        F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    prints = {"h1": F.when(fine, F.xxhash64(vector_col)), "h2": F.when(fine, F.xxhash64(F.lit("second"), F.col(vector_col)))}  # together 128 bits
    rows = embeddings.select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in prints.items()), F.when(fine, F.col(vector_col)).alias("v"))
    with store.Tables(embeddings.sparkSession) as tables:
        known = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("_id").alias("first"), F.first("v").alias("v"))
        known = tables.write(known.withColumn("class", F.monotonically_increasing_id()), "vectors")  # written, so the numbers hold
        links = None
        for row in known.groupBy(F.size("v").alias("dims")).count().collect():  # one row a vector length
            found = class_links(known.where(F.size("v") == row.dims).select("class", "v"), row["count"], row.dims, cosine, tables)
            links = found if links is None else links.unionByName(found)
        if links is None:
            return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
        found = components(links, tables)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        copies = known.select(F.col("class").alias("b"), "copies")
        degree = both.join(copies, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
        named = known.drop("v").join(found, F.col("class") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "class")).join(degree, "class", "left")
        least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
        named = store.durable(named.join(least, "comp").select("h1", "h2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = rows.drop("v").join(named, ["h1", "h2"], "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "_id") == F.col("_id"), F.lit(False)).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_duplicates(store.table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, r, e, sqrt(list_inner_product(e, e)) AS z FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.z * b.z) >= 0.9
), reach AS (
  WITH RECURSIVE t(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b) SELECT a, min(b) AS component_id FROM t GROUP BY a
), deg AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN deg ON deg.a = vec_id JOIN reach ON reach.a = vec_id
"""
