"""Codes for vectors: each of four parts of a vector becomes the number of its nearest codebook entry, by slice-and-intersect.

Components become integers, so that all results are exact. For each dimension of a part the entries' coordinates are sorted, and the mask of the
first k entries in that order (a bit an entry, in uint64 words) is kept for every k. A radius cuts a range out of each dimension: the exclusive or of two prefix masks is
what lies in it, and the masks of all dimensions are ANDed. What is left holds every entry within the radius, so once one of them lies
within it, the nearest is among them, ties included. The initial radius is the median distance of an entry to its nearest other one; parts whose best candidate lies beyond it are
asked again with that candidate's distance, parts without a candidate with twice the radius.

Codebooks are trained by rounds over all rows: tasks send one sum a codebook entry, the driver holds the codebooks alone (``ENTRIES`` x dimensions
numbers). The first entries are those of the smallest ids, found by merging the tasks' smallest ones in two steps.

Defined cases: rows whose vector is null or holds null or non-finite components go; vectors shorter than the longest kept one are filled with zeros, as is a
length that four does not divide; integer components saturate at +-2**27; with fewer ids than entries the codebooks are smaller; of rows that share an id the least vector starts an entry; a null id
counts as one id behind all others; repeated rows each get their row; sums of errors over a label that exceed a long saturate; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
MOST = 1 << 27
#: Components under this have products and sums that doubles hold exactly, for parts of up to 512 dimensions.
EXACT = 1 << 21
#: Tasks that merge the smallest ids of all; parts of vectors whose candidates are looked at at a time.
MERGERS, BLOCK = 32, 1024
#: Labels, and bytes of them, that are sent to all tasks; beyond, the sums are joined, a label's rows dealt over ``SALTS`` keys.
SMALL_LABELS, SMALL_BYTES, SALTS = 20_000, 4 << 20, 16
_FAR = np.iinfo(np.int64).max


def _roots(squares: np.ndarray) -> np.ndarray:
    """Whole parts of the square roots."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


@dataclass(frozen=True)
class Slices:
    """Entries (entries, dimensions) with, for each dimension, the sorted coordinates and the masks of their prefixes."""

    entries: np.ndarray
    coordinates: np.ndarray  # (dimensions, entries)
    prefixes: np.ndarray  # (dimensions, entries + 1, words)
    radius: int

    @staticmethod
    def of(entries: np.ndarray) -> Slices:
        n, dims = entries.shape
        order = np.argsort(entries, axis=0, kind="stable").T
        own = np.zeros((n, (n + 63) // 64), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        prefixes = np.zeros((dims, n + 1, own.shape[1]), np.uint64)
        for j in range(dims):
            prefixes[j, 1:] = np.bitwise_or.accumulate(own[order[j]], axis=0)
        apart = [int(np.min(((np.delete(entries, k, 0) - entries[k]) ** 2).sum(1), initial=_FAR)) for k in range(n)] if n > 1 else []
        near = [x for x in apart if 0 < x < _FAR]
        return Slices(entries, np.take_along_axis(entries.T, order, 1), prefixes, max(1, int(np.sqrt(np.median(near)))) if near else MOST)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(rows, entries): what lies within the radius of a row in every dimension."""
        mask = np.full((len(x), self.prefixes.shape[2]), ~np.uint64(0))
        for j in range(x.shape[1]):
            low, high = np.searchsorted(self.coordinates[j], x[:, j] - radius, "left"), np.searchsorted(self.coordinates[j], x[:, j] + radius, "right")
            mask &= self.prefixes[j, high] ^ self.prefixes[j, low]
        n = len(self.entries)
        if not x.shape[1]:
            return np.ones((len(x), n), bool)
        return np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)

    def _measured(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest candidate of each row and its squared distance, _FAR where there is none."""
        inside = self.candidates(x, radius)
        if max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0)) < EXACT:  # the candidates' distances, a block in one product
            a, b = x.astype(np.float64), self.entries.astype(np.float64)
            squares = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
            squares[~inside] = np.inf
            best = squares.argmin(1)
            least = squares[np.arange(len(x)), best]
            return best, np.where(np.isinf(least), _FAR, np.where(np.isinf(least), 0, least).astype(np.int64))
        row, entry = np.nonzero(inside)
        apart = np.full((len(x), len(self.entries)), _FAR)
        gap = x[row] - self.entries[entry]
        apart[row, entry] = np.einsum("ij,ij->i", gap, gap)
        best = apart.argmin(1)
        return best, apart[np.arange(len(x)), best]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lower of equals, and its squared distance."""
        best, apart = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            rows = np.arange(at, min(at + BLOCK, len(x)))
            radius = np.full(len(rows), self.radius, np.int64)
            while len(rows):
                found, square = self._measured(x[rows], radius)
                done = (square < _FAR) & (_roots(np.where(square < _FAR, square, 0)) <= radius)
                best[rows[done]], apart[rows[done]] = found[done], square[done]
                rows, radius, square = rows[~done], radius[~done], square[~done]
                radius = np.where(square < _FAR, _roots(np.where(square < _FAR, square, 0)), 2 * radius)
        return best, apart


def _whole(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integer vectors), these filled with zeros up to ``dims`` or the batch's longest."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls turn into NaN
    row = np.repeat(np.arange(len(column)), lengths)
    bad = np.bincount(row, weights=~np.isfinite(values), minlength=len(column)) > 0
    kept = np.flatnonzero(np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & ~bad)
    width = int(lengths[kept].max(initial=0)) if dims is None else dims
    out = np.zeros((len(column), width), np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    use = ~bad[row]
    out[row[use], place[use]] = np.floor(np.clip(values[use], -MOST / SCALE, MOST / SCALE) * SCALE).astype(np.int64)
    return kept, out[kept]


def _sortable(x: np.ndarray) -> pa.Array:
    """Rows as bytes in the order of their numbers."""
    return pa.array([r.tobytes() for r in (x + (1 << 31)).astype(">u4")], pa.binary())


def _unsorted(data: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(data), dims), np.int64)
    for k, b in enumerate(data):
        out[k, : len(b) // 4] = np.frombuffer(b, ">u4").astype(np.int64) - (1 << 31)
    return out


def _first_ids(table: pa.Table, n: int) -> pa.Table:
    """The least vector of each of the n smallest ids, nulls last; dims of a row is the longest vector seen."""
    dims = pc.max(table["dims"])
    table = table.take(pc.sort_indices(table, [("id", "ascending"), ("v", "ascending")], null_placement="at_end"))
    ids = table["id"].combine_chunks()
    same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, max(0, len(ids) - 1))), False).to_numpy(zero_copy_only=False)
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    fresh = np.flatnonzero(np.concatenate(([True], ~(np.asarray(same, bool) | (nulls[1:] & nulls[:-1])))) if len(ids) else [])[:n]
    out = table.take(pa.array(fresh, pa.int64()))
    return out.set_column(2, "dims", pa.array([dims.as_py()] * len(out), pa.int32()))


def _smallest(n: int, packed: bool):
    """The task's n smallest ids with their vectors, from plain vectors or packed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not packed and batch.num_rows:
                kept, x = _whole(batch.column("v"))
                batch = pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), _sortable(x), pa.array(np.full(len(kept), x.shape[1]), pa.int32())], ["id", "v", "dims"])
            if batch.num_rows:
                table = pa.Table.from_batches([batch.select(["id", "v", "dims"])])
                held = _first_ids(table if held is None else pa.concat_tables([held, table]), n)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def _sums(books: list[np.ndarray], dims: int):
    """Each task's count and sum of the parts that an entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, width = [Slices.of(b) for b in books], dims // PARTS
        counts, sums = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), width), np.int64)
        for batch in batches:
            _, x = _whole(batch.column("v"), dims)
            for p in range(PARTS if len(x) else 0):
                part = x[:, p * width : (p + 1) * width]
                best, _ = slices[p].nearest(part)
                order = np.argsort(best, kind="stable")
                entry, first = np.unique(best[order], return_index=True)
                counts[p, entry] += np.diff(np.append(first, len(order)))
                sums[p, entry] += np.add.reduceat(part[order], first, axis=0)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, width = [Slices.of(b) for b in books], dims // PARTS
        for batch in batches:
            kept, x = _whole(batch.column("v"), dims)
            found = [slices[p].nearest(x[:, p * width : (p + 1) * width]) for p in range(PARTS)]
            codes = ["".join(f"{k:02x}" for k in r) for r in np.stack([f[0] for f in found], 1).tolist()]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found))], ["id", "label", "code", "error"])

    return run


def first_entries(rows: DataFrame, n: int = ENTRIES) -> tuple[list[np.ndarray], int]:
    """(the codebooks that training starts from, dimensions); rows: id, v."""
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, v binary, dims int"
    merged = rows.select("id", "v").mapInArrow(_smallest(n, False), shape).repartition(MERGERS).mapInArrow(_smallest(n, True), shape)
    found = merged.toArrow()  # ``n`` rows from each of the MERGERS at most
    if not len(found):
        return [], 0
    found = _first_ids(found, n)
    dims = -(-max(1, found["dims"][0].as_py()) // PARTS) * PARTS
    x = _unsorted(found["v"].to_pylist(), dims)
    return np.split(x, PARTS, axis=1), dims


def train(rows: DataFrame, rounds: int = ROUNDS, n: int = ENTRIES) -> tuple[list[np.ndarray], int]:
    """(codebooks, dimensions) after rounds of assigning all parts and replacing each used entry by the floor of its parts' mean."""
    books, dims = first_entries(rows, n)
    for _ in range(rounds if dims else 0):
        width = dims // PARTS
        sums = rows.select("v").mapInArrow(_sums(books, dims), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)))
        for r in total.collect():  # one row an entry
            books[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return books, dims


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error), codebooks); the frame is written."""
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    books, dims = train(rows)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    shape = ", ".join([*kinds, "code string", "error long"])
    if not dims:
        return rows.sparkSession.createDataFrame([], shape), books
    return store.durable(rows.mapInArrow(_codes(books, dims), shape), "codes"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the sum of error over the rows of a label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(str(_FAR)).cast("decimal(30,0)")).cast("long")
    sums = store.durable(coded.groupBy("label").agg(total.alias("label_error")), "sums")
    size = sums.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0))).alias("b")).first()
    sums = sums.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if size.n <= SMALL_LABELS and (size.b or 0) <= SMALL_BYTES:
        return coded.join(F.broadcast(sums), same, "left").drop("_label")
    dealt = sums.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, same & (F.col("_salt") == F.col("_deal")), "left").drop("_label", "_salt", "_deal")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by codebooks trained on all of them."""
    coded, books = compress(store.table(spark, sf_dir, "embeddings"))
    out = label_errors(coded)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """Rounds are written out one after another: each assigns by the least (distance, entry) and takes floors of means."""
    assign = """a{k} AS MATERIALIZED (
  SELECT r, p, x, min_by(b.e, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + b.e) AS e,
         min(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) AS d2
  FROM part JOIN b{k} b USING (p) GROUP BY r, p, x)"""
    update = """m{k} AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS v FROM a{k}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM part))) AS i) GROUP BY p, e, i),
b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM m{k} GROUP BY p, e) l USING (p, e))"""
    steps = ",\n".join(f"{assign.format(k=k)},\n{update.format(k=k, n=k + 1)}" for k in range(ROUNDS))
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM v, (SELECT unnest(generate_series(0, {PARTS - 1})) AS p)
), b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {ENTRIES}) USING (r)
),
{steps},
{assign.format(k=ROUNDS)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d2)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), digest
"""


OP11_SQL = _op11_sql()
