"""Benchmark decontamination by Wu-Manber search on words.

Test strings are the windows of 13 consecutive words of each benchmark item (an item of fewer words is one window). Windows of
one length form one search: a shift table over blocks of two words says how far a position may jump without
missing a window, a bucket keyed by the last block and one keyed by the whole window select test strings, and
a comparison of the words themselves confirms. The search runs on arrays of word hashes: a chunk's word positions are cut
into strips, and all strips jump at once, each by its own shift.

The windows are sent to the tasks in blocks of at most ``BLOCK_WINDOWS``, so what is built and broadcast at once is bounded; with one
block, the usual case, a document is read once, with more the documents are read once for each block and the spans of all blocks are
united for each text before they are counted.

Defined cases: a null or empty text has no words and is clean; an item without words matches nothing; items with equal
texts are all reported; ids may be of any type that text can be cast to; items with a null id hit like others and are reported as one
null; repeated document rows each get their row; an empty benchmark leaves
all clean; extra columns are ignored or, in ``scan``, passed through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store
from newsloom.llm.bytesets import ALPHANUMERIC, PLACE, mix, sequence_hashes, text_chunks, word_bounds, word_hashes

WINDOW = 13
#: Windows searched in one scan: some 40 MB in the driver and in each task.
BLOCK_WINDOWS = 200_000
STRIP = 128
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_UPPER_TO_LOWER))


def _sorted(items: Iterable[str | None]) -> list[str | None]:
    return sorted(items, key=lambda i: (i is None, i or ""))


def _runs(words: np.ndarray) -> np.ndarray:
    """The sequence hash of each row of word hashes."""
    total = np.full(len(words), words.shape[1], np.uint64)
    for i in range(words.shape[1]):
        total += words[:, i] * PLACE[i]
    return mix(total)


@dataclass(frozen=True)
class Patterns:
    """Windows of one length: a shift for each block that occurs in one, and the windows in the order of their hashes."""

    length: int
    block: int
    blocks: np.ndarray  # sorted hashes of blocks
    shifts: np.ndarray
    tails: np.ndarray  # sorted hashes of windows
    data: bytes  # the windows one after another, words with a space between
    ends: np.ndarray
    owners: np.ndarray  # for each window the index of its set of items
    items: list[tuple[str | None, ...]]

    @staticmethod
    def of(windows: dict[bytes, set[str | None]], length: int) -> Patterns:
        block, joined = min(2, length), list(windows)
        hashes = []
        for _, data, offsets in text_chunks(pa.array(joined, pa.binary()).cast(pa.string()), 1 << 26):
            starts, ends, _ = word_bounds(data, offsets, ALPHANUMERIC)
            hashes.append(word_hashes(data, starts, ends))
        words = np.concatenate(hashes).reshape(len(joined), length)
        at = [np.unique(_runs(words[:, i : i + block])) for i in range(length - block + 1)]
        shift = np.repeat(np.arange(length - block, -1, -1), [len(x) for x in at])  # the last block of a window shifts by 0, the one before by 1 ...
        every = np.concatenate(at)
        order = np.lexsort((shift, every))
        blocks, first = np.unique(every[order], return_index=True)
        tails = _runs(words)
        by_hash = np.argsort(tails, kind="stable")
        sets: dict[tuple[str | None, ...], int] = {}
        owners = np.array([sets.setdefault(tuple(_sorted(windows[joined[k]])), len(sets)) for k in by_hash], np.int32)
        ends = np.cumsum([len(joined[k]) for k in by_hash])
        return Patterns(length, block, blocks, shift[order][first], tails[by_hash], b"".join(joined[k] for k in by_hash), ends, owners, list(sets))

    def matching(self, key: int, text: bytes) -> Iterator[tuple[str | None, ...]]:
        """The items of the windows of this hash that are this text."""
        low, high = np.searchsorted(self.tails, np.uint64(key), "left"), np.searchsorted(self.tails, np.uint64(key), "right")
        for k in range(low, high):
            if self.data[self.ends[k - 1] if k else 0 : self.ends[k]] == text:
                yield self.items[self.owners[k]]


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def search(words: np.ndarray, patterns: Patterns) -> np.ndarray:
    """Starts of the windows that may match: Wu-Manber jumps over all strips of positions at once."""
    last = len(words) - patterns.block
    if last < patterns.length - patterns.block:
        return np.empty(0, np.int64)
    blocks = sequence_hashes(words, patterns.block)  # at i: the block of words i, i + 1
    at = np.arange(patterns.length - patterns.block, last + 1, STRIP)
    end = np.minimum(at + STRIP, last + 1)
    found, far = [], patterns.length - patterns.block + 1
    while len(at):
        row, known = _lookup(patterns.blocks, blocks[at])
        shift = np.where(known, patterns.shifts[row], far)
        found.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        live = at < end
        at, end = at[live], end[live]
    starts = np.concatenate(found) - (patterns.length - patterns.block)
    if not len(starts):
        return starts
    total = np.full(len(starts), patterns.length, np.uint64)
    for i in range(patterns.length):
        total += words[starts + i] * PLACE[i]
    return np.sort(starts[_lookup(patterns.tails, mix(total))[1]])


def hits(column: pa.Array, searches: list[Patterns]) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None]]]:
    """For each text: number of words, the spans of words hit (start, end), ids of the items that occur."""
    for _, data, offsets in text_chunks(column):
        starts, ends, first = word_bounds(data, offsets, ALPHANUMERIC)
        words = word_hashes(data, starts, ends)
        found: dict[int, list[tuple[int, int, tuple[str | None, ...]]]] = defaultdict(list)
        raw = data.tobytes().translate(_UPPER_TO_LOWER)
        for p in searches:
            for s in search(words, p).tolist():
                doc = int(np.searchsorted(first, s, "right")) - 1
                if s + p.length > first[doc + 1]:
                    continue  # reaches into the next text
                text = b" ".join(raw[starts[i] : ends[i]] for i in range(s, s + p.length))
                for items in p.matching(int(sequence_hashes(words[s : s + p.length], p.length)[0]), text):
                    found[doc].append((s - int(first[doc]), s - int(first[doc]) + p.length, items))
        for doc, n in enumerate(np.diff(first).tolist()):
            spans: list[tuple[int, int]] = []
            for s, e, _ in sorted(found.get(doc, ()), key=lambda x: x[:2]):
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                else:
                    spans.append((s, e))
            yield n, spans, {i for *_, items in found.get(doc, ()) for i in items}


class Block(list[Patterns]):
    """The searches of one block of windows."""

    last = False  # no block follows


def pattern_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, limit: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The searches, at most ``limit`` windows in each block; the benchmark is read a partition at a time, a block is built when asked for."""
    by_length: dict[int, dict[bytes, set[str | None]]] = defaultdict(lambda: defaultdict(set))
    n = 0

    def made() -> Block:
        block = Block(Patterns.of(dict(w), length) for length, w in sorted(by_length.items()) if w)
        by_length.clear()
        return block

    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row.t)
        for k in range(max(1, len(words) - window + 1)) if words else ():
            w, length = b" ".join(words[k : k + window]), min(window, len(words))
            if w not in by_length[length]:
                if n >= limit:
                    yield made()
                    n = 0
                n += 1
            by_length[length][w].add(row.i)
    if n:
        block = made()
        block.last = True
        yield block


_HITS = {"n_words": "long", "spans": "array<struct<start: int, end: int>>", "items": "array<string>"}


def scan(docs: DataFrame, searches: list[Patterns], keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The kept columns with n_words, spans and items of every document, these with a prefix."""
    text, names = f"{store.RESERVED}text", [prefix + c for c in _HITS]
    shared = docs.sparkSession.sparkContext.broadcast(searches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(hits(batch.column(text), shared.value))
            spans = pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            made = [pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([_sorted(r[2]) for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])

    frame = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, fields + ", ".join(f"`{n}` {t}" for n, t in zip(names, _HITS.values(), strict=True)))


def _n_hit(prefix: str = "") -> Column:
    return F.aggregate(f"{prefix}spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _contaminated(prefix: str = "") -> Column:
    """Hit at all, and in a twentieth of the words at least."""
    return (_n_hit(prefix) > 0) & (20 * _n_hit(prefix) >= F.col(f"{prefix}n_words"))


def _print(text_col: str) -> Column:
    return F.sha2(F.col(text_col).cast("string").cast("binary"), 256)


def _text_hits(docs: DataFrame, blocks: Iterable[list[Patterns]], text_col: str, prefix: str = "") -> DataFrame:
    """(print, n_words, spans, items) of each text that is hit, spans and items united over the blocks; each block is searched and
    its hits written before the next one is built."""
    key, names = f"{prefix}print", [f"{prefix}{c}" for c in _HITS]
    texts = docs.select(_print(text_col).alias(key), F.col(text_col))
    found = None
    for searches in blocks:
        hit = scan(texts, searches, [key], text_col, prefix).where(F.size(names[1]) > 0).dropDuplicates([key])
        part = store.durable(hit, "hits")
        found = part if found is None else found.unionByName(part)
        del searches
    span = "array<struct<start: int, end: int>>"
    united = found.groupBy(key).agg(
        F.max(names[0]).alias(names[0]), F.array_sort(F.flatten(F.collect_list(names[1]))).alias(names[1]), F.array_distinct(F.flatten(F.collect_list(names[2]))).alias(names[2])
    )
    last = lambda a: F.try_element_at(a, F.lit(-1))
    merged = F.aggregate(
        names[1],
        F.expr(f"CAST(array() AS {span})"),
        lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] >= s["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))),
    )
    return united.withColumn(names[1], merged)


def _first_and_all(blocks: Iterable[list[Patterns]]) -> tuple[list[Patterns] | None, Iterator[list[Patterns]]]:
    """The searches if one block has them all, else None; and the blocks."""
    rest = iter(blocks)
    start = list(islice(rest, 1))
    if start and not isinstance(start[0], Block):
        start += islice(rest, 1)
    if not start:
        return [], rest
    return (start[0] if len(start) == 1 and getattr(start[0], "last", True) else None), chain(start, rest)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", limit: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids that occur), spans of words, contaminated."""
    only, blocks = _first_and_all(pattern_blocks(benchmark, item_col, limit=limit))
    if only is not None:
        found = scan(docs, only, [id_col], text_col)
    else:
        counted = scan(docs.select(id_col, text_col, _print(text_col).alias("_p")), [], [id_col, "_p"], text_col).select(id_col, "_p", "n_words")
        united = _text_hits(docs, blocks, text_col).select(F.col("print").alias("_p"), "spans", "items")
        found = counted.join(united, "_p", "left").select(id_col, "n_words", *(F.coalesce(c, F.expr(f"CAST(array() AS {_HITS[c]})")).alias(c) for c in ("spans", "items")))
    items = F.array_sort(F.col("items").cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>")).alias("items")
    return found.select(id_col, "n_words", _n_hit().alias("n_hit"), items, "spans", _contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, blocks: Iterable[list[Patterns]], text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, judged by the hits of all blocks together.

    With one block of patterns the texts pass the search and nothing is shuffled; with more, only hits and digests of texts move."""
    only, blocks = _first_and_all(blocks)
    if only is not None:
        return scan(docs, only, docs.columns, text_col, store.RESERVED).where(~_contaminated(store.RESERVED)).select(*docs.columns)
    key = f"{store.RESERVED}print"
    gone = _text_hits(docs, blocks, text_col, store.RESERVED).where(_contaminated(store.RESERVED)).select(key)
    return docs.withColumn(key, _print(text_col)).join(gone, key, "left_anti").select(*docs.columns)


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = contamination(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w,
         row_number() OVER () AS r
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT pos.r, pos.k, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
cover AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
