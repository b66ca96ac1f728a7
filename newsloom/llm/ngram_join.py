"""Exact Jaccard join of word-shingle sets by PartEnum signatures on two levels.

Sets are banded by size so that linked sets lie in one band or in two that meet. In a band the hashed feature domain is cut into
partitions, and each of these into ``SECOND`` = 3 second-level partitions. Sets of similarity s differ in at most
k = (1 - s) / (1 + s) * (sum of sizes) features; there are more than k / 2 first-level partitions, so one of them holds at most one
differing feature, and all but one of its second-level partitions agree. Signatures are therefore the subsets of two of the three
second-level partitions: what a set holds in them. k differing features change at most ``changed`` subsets; each set ranks its subsets by
size (ties by hash) and enumerates one more than that. Of two linked sets, the first subset in this order that both hold alike has
at most so many before it in either list, so both enumerate it: they share a signature, and none is lost.

Equal sets are one class from the start, told apart by two 64-bit hashes and numbered. The classes of a signature are tested against each other in blocks of
bounded size inside tasks: on bitmaps first, which give out a spanning forest of the pairs that may link, each of which is verified once; the signatures of pairs that
fail are then verified on whole sets, again for a spanning forest. So no operator's output grows with the square of a group.

Defined cases: a null or empty text, or one without words, has an empty set, 0 shingles and no link; a text under five
words is one shingle; repeated rows and copies fall in one class; a null id is linked like any other but names no component unless
all ids of it are null; ids may be of any type with an order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store
from newsloom.llm.bytesets import mix, shingle_sets, text_chunks
from newsloom.llm.components import components

#: Links when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
SHINGLE = 5
#: Second-level partitions of a partition; a signature covers all but one.
SECOND = 3
#: Bits of the membership filter that spares work on texts without candidates: 4 MB, whatever the input. It only lets rows through.
FILTER_BITS = 1 << 25
#: Features in a block of sets that are verified against one another.
BLOCK_FEATURES = 1 << 18
#: Classes a task remembers so as not to repeat their signatures; more are forgotten, and repeats are harmless.
REMEMBERED = 1 << 18
_U = np.uint64


def band_of(n: int) -> int:
    """Band of a size: sizes of 4 ** band to 4 ** (band + 1) - 1."""
    return (n.bit_length() - 1) // 2


def apart(a: int, b: int, similarity: int = SIMILARITY) -> int:
    """Most features in which linked sets of these sizes differ."""
    return (100 - similarity) * (a + b) // (100 + similarity)


def partitions(band: int, similarity: int = SIMILARITY) -> int:
    """First-level partitions of a band: more than half of what its largest sets may differ in, and some to choose from."""
    k = apart(4 ** (band + 1) - 1, 4 ** (band + 1) - 1, similarity)
    return k // 2 + 1 + (math.isqrt(k) + 1) // 2


def changed(k: int, m: int) -> int:
    """Most signatures that k differing features change: two of a partition with one of them, three of one with more."""
    return 2 * k if k <= m else min(k + m, SECOND * m)


def class_hashes(features: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, the same for equal sets."""
    n = np.array([len(features)], _U)
    one = np.add.reduce(mix(features ^ _U(0x5851F42D4C957F2D)))
    two = np.add.reduce(mix(features * _U(0xDA942042E4DD58B5) + _U(0x2545F4914F6CDD1D)))
    return int(mix(one + n).view(np.int64)[0]), int(mix((two ^ _U(0x9FB21C651E98DF25)) + n).view(np.int64)[0])


def signatures(features: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Signatures of a sorted set of hashes, as int64; the whole set where only equal sets can link."""
    n, out = len(features), []
    far = 100 * n // similarity  # size of the largest set that can link
    mixed = mix(features)
    second = ((features & _U(0xFFFFFFFF)) % _U(SECOND)).astype(np.int64)
    for band in sorted({band_of(n), band_of(far)}):
        k, m = apart(n, min(far, 4 ** (band + 1) - 1), similarity), partitions(band, similarity)
        if not k:
            continue
        cell = (((features >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64) * SECOND + second
        held = np.bincount(cell, minlength=m * SECOND).reshape(m, SECOND)
        sums = np.zeros(m * SECOND, _U)
        np.add.at(sums, cell, mixed)
        sums = sums.reshape(m, SECOND)
        size = (held.sum(1, keepdims=True) - held).ravel()  # of the subset that leaves one second-level partition out
        content = (sums.sum(1, keepdims=True, dtype=_U) - sums).ravel()
        made = mix(content + np.arange(m * SECOND, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(band))
        wanted = changed(k, m) + 1
        if wanted < len(made):
            rank = ((255 - np.minimum(size, 255)).astype(_U) << _U(56)) | (made >> _U(8))
            made = made[np.argpartition(rank, wanted - 1)[:wanted]]
        out.append(made)
    return np.concatenate(out).view(np.int64) if out else np.array([class_hashes(features)[0]], np.int64)


def _each_set(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, data, offsets in text_chunks(column):
        yield row, shingle_sets(data, offsets, SHINGLE)


def _pick(id_col: str, text_col: str) -> Column:
    """64 bits of a row's id and text: tells apart the texts of one id."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, pick, n_shingles, h1, h2); the hashes of the class are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _each_set(batch.column("_text")):
                found = [class_hashes(s) if len(s) else (None, None) for s in sets]
                arrays = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, len(sets)) for c in ("_id", "pick")), *arrays], ["_id", "pick", "n_shingles", "h1", "h2"])

    frame = docs.select(F.col(id_col).alias("_id"), _pick(id_col, text_col).alias("pick"), F.col(text_col).cast("string").alias("_text"))
    return frame.mapInArrow(run, f"_id {frame.schema['_id'].dataType.simpleString()}, pick long, n_shingles long, h1 long, h2 long")


def class_signatures(docs: DataFrame, text_col: str, similarity: int) -> DataFrame:
    """(sig, h1): every signature of every class, at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sets in _each_set(batch.column("_text")):
                out, ids = [], []
                for s in sets:
                    if len(s) and (c := class_hashes(s)) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                        out.append(signatures(s, similarity))
                        ids.append(c[0])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in out]))], ["sig", "h1"])

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "sig long, h1 long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, h1): those of signatures with two classes or more, each once. Streams: the last row waits for the next batch."""
    last: tuple[np.ndarray, np.ndarray] = np.empty(0, np.int64), np.empty(0, np.int64)
    shared = False  # whether the signature of the row that waits has had another class

    def out(sig: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls)], ["sig", "h1"])

    for batch in batches:
        sig, cls = (np.concatenate((held, batch.column(i).to_numpy())) for i, held in enumerate(last))
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[fresh], cls[fresh]
        same = sig[1:] == sig[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        keep[0] |= shared
        last, shared = (sig[-1:], cls[-1:]), bool(keep[-1])
        yield out(sig[:-1][keep[:-1]], cls[:-1][keep[:-1]])
    if shared:
        yield out(*last)


def _filter_of(picks: DataFrame) -> np.ndarray:
    """The fixed-size membership filter of the picks, as bytes of bits."""
    spot = F.col("pick").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts = picks.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.toLocalIterator():  # at most 1,024 rows of 4 KB
        bits[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(row.bits, np.uint8)
    return bits


def class_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(class, n, bits, features) of the wanted classes (class, h1, h2, pick), one row each: the text of the row that a class picks is read
    again, others only where the filter cannot tell them apart."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            spot = batch.column("pick").to_numpy() & (FILTER_BITS - 1)
            for _, sets in _each_set(batch.column("_text").filter(pa.array((bits[spot >> 3] >> (spot & 7) & 1).astype(bool)))):
                fresh = {class_hashes(s): s.view(np.int64) for s in sets if len(s)}
                if fresh:
                    arrays = [*(pa.array([c[i] for c in fresh], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in fresh.values()], pa.int32()), pa.array([parity_bits(s) for s in fresh.values()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(fresh.values()), pa.list_(pa.int64()))], ["h1", "h2", "n", "bits", "features"])

    frame = docs.select(_pick(id_col, text_col).alias("pick"), F.col(text_col).cast("string").alias("_text"))
    made = frame.mapInArrow(run, "h1 long, h2 long, n int, bits binary, features array<long>").dropDuplicates(["h1", "h2"])
    return made.join(wanted.select("class", "h1", "h2"), ["h1", "h2"]).select("class", "n", "bits", "features")


def parity_bits(features: np.ndarray) -> bytes:
    """A bitmap of 64 bits or more, at least two for each feature; a feature flips the bit at its low bits."""
    b = 1 << max(6, math.ceil(math.log2(2 * len(features))))
    return np.packbits(np.bincount((features & np.int64(b - 1)), minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words; the longer ones are folded to the length of the shortest."""
    words = [np.frombuffer(b, np.uint64) for b in bits]
    least = min(len(w) for w in words)
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, least), axis=0) for w in words])


def may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, similarity: int) -> np.ndarray:
    """Whether sets whose bitmaps differ in so many bits may link: they differ in as many features at least."""
    return (100 + similarity) * differ <= (100 - similarity) * (na + nb)


def linked(a: int, b: int, both: np.ndarray, similarity: int) -> np.ndarray:
    return 100 * both >= similarity * (a + b - both)


def forest(sets: list[np.ndarray], groups: list[int], similarity: int) -> list[tuple[int, int]]:
    """Links between the sets, as many as join what is not yet in one group; all pairs are tested by a product of incidences."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[code] > 1
    owner, code = owner[common], np.unique(code[common], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 4096
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, [start, start + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[low:high], code[low:high] - start] = 1
        both += m @ m.T
    group = np.array(groups)
    yes = linked(sizes[:, None], sizes[None, :], both, similarity) & (group[:, None] != group[None, :])
    root = {g: g for g in groups}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    out = []
    for i, j in zip(*np.nonzero(np.triu(yes, 1)), strict=True):
        x, y = top(groups[i]), top(groups[j])
        if x != y:
            root[x] = y
            out.append((int(i), int(j)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[int], list[int], list]]:
    """Rows (sig, i, j, class, comp, content) sorted by (sig, i, j), a block at a time."""
    key, ids, groups, content = None, [], [], []
    for batch in batches:
        last = batch.column(5)
        if pa.types.is_list(last.type):
            flat = last.flatten().to_numpy()
            ends = np.cumsum([0, *(len(x) for x in last)]).tolist()
            values = [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        else:
            values = last.to_pylist()
        for sig, i, j, c, g, v in zip(*(batch.column(k).to_pylist() for k in range(5)), values, strict=True):
            if (sig, i, j) != key:
                if ids:
                    yield key, ids, groups, content
                key, ids, groups, content = (sig, i, j), [], [], []
            ids.append(c)
            groups.append(g)
            content.append(v)
    if ids:
        yield key, ids, groups, content


def _near_rows(group: np.ndarray, content: list, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block of bitmaps the later rows of other groups that it may link to; group may change between rows."""
    n, bits = np.array([c["n"] for c in content], np.int64), _folded([c["bits"] for c in content])
    for k in range(len(group) - 1):
        later = np.flatnonzero(group[k + 1 :] != group[k]) + k + 1
        if len(later):
            differ = np.bitwise_count(bits[later] ^ bits[k]).sum(1, dtype=np.int64)
            yield k, later[may_link(n[later], n[k], differ, similarity)]


def _likely(similarity: int):
    """Of each block of bitmaps as many pairs (with its signature) that may link as join its groups: a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int, int]] = []
        for key, ids, groups, content in _blocks(batches):
            group = np.unique(np.array(groups), return_inverse=True)[1]
            for k, near in _near_rows(group, content, similarity):
                if len(near):
                    joined, first = np.unique(group[near], return_index=True)
                    pairs += [(key[0], ids[k], ids[j]) for j in near[first].tolist()]
                    group[np.isin(group, joined)] = group[k]
            if len(pairs) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["sig", "a", "b"])
                pairs = []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["sig", "a", "b"])

    return run


def _promising(similarity: int):
    """Of each block of bitmaps the rows that may link to a row of another group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, ids, groups, content in _blocks(batches):
            group, keep = np.array(groups), np.zeros(len(ids), bool)
            for k, near in _near_rows(group, content, similarity):
                keep[k] |= len(near) > 0
                keep[near] = True
            rows += [(*key, ids[k], groups[k]) for k in np.flatnonzero(keep)]
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["sig", "i", "j", "class", "comp"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["sig", "i", "j", "class", "comp"])

    return run


def _verify_blocks(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, groups, sets in _blocks(batches):
            pairs = forest(sets, groups, similarity) if len(set(groups)) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], ["a", "b"])

    return run


def class_links(docs: DataFrame, known: DataFrame, tables: store.Tables, id_col: str, text_col: str, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b): links between the known classes (class, h1, h2, n, pick) whose components are those of all links.

    Joins of tables that grow with the input are merge joins at every size, so that plans, and what they move, do not turn with a threshold.
    What moves: a signature and eight bytes of its class; then only classes that share one: a bitmap of a few bits a feature for each,
    whole sets for pairs and blocks that the bitmaps leave open.
    """
    rows = class_signatures(docs, text_col, similarity).repartition("sig").sortWithinPartitions("sig", "h1")
    buckets = tables.write(rows.mapInArrow(_shared, "sig long, h1 long"), "buckets")
    wanted = known.join(buckets.select("h1").distinct(), "h1", "left_semi")
    members = tables.write(buckets.join(known.select("h1", "class", "n"), "h1").select("sig", "class", "n"), "members")
    sets = tables.write(class_sets(docs, id_col, text_col, wanted), "sets")
    tables.drop(buckets)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link: only the sets of their classes move, each to its pairs."""
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("class"))
        held = ends.join(sets.select("class", "features").hint("merge"), "class").groupBy("a", "b").agg(F.collect_list("features").alias("f"))
        one, two = F.element_at("f", 1), F.element_at("f", 2)
        both = F.size(F.array_intersect(one, two))
        return tables.write(held.where(100 * both >= similarity * (F.size(one) + F.size(two) - both)).select("a", "b"), name)

    prints = [F.bit_xor(F.xxhash64("class")).alias("p1"), F.bit_xor(F.xxhash64(F.lit("second"), F.col("class"))).alias("p2")]

    def open_blocks(placed: DataFrame) -> DataFrame:
        """(sig, i, j, class, comp): the signatures whose classes lie in several components, equal groups once, in blocks that meet pairwise."""
        sig = placed.groupBy("sig").agg(F.count("*").alias("members"), F.max("n").alias("n_max"), F.min("comp").alias("low"), F.max("comp").alias("high"), *prints)
        blocks = F.ceil(F.greatest(F.col("members") * F.col("n_max") / BLOCK_FEATURES, F.col("members") / 1024))
        open_sigs = sig.where("low <> high").groupBy("p1", "p2", "members").agg(F.min("sig").alias("sig"), F.max(blocks).alias("blocks"))
        rows = placed.join(open_sigs.select("sig", "blocks").hint("merge"), "sig").withColumn("r", F.pmod(F.xxhash64("class", "sig"), F.col("blocks")))
        rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return tables.write(rows.select("sig", F.least("r", "s").alias("i"), F.greatest("r", "s").alias("j"), "class", "comp"), "rows")

    def block_rows(rows: DataFrame, content: Column) -> DataFrame:
        rows = rows.join(sets.select("class", content.alias("content")).hint("merge"), "class").select("sig", "i", "j", "class", "comp", "content")
        return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "class")

    likely = tables.write(block_rows(open_blocks(members.withColumn("comp", F.col("class"))), F.struct("n", "bits")).mapInArrow(_likely(similarity), "sig long, a long, b long"), "likely")
    tried = tables.write(likely.select("a", "b").distinct(), "tried")
    links = verified(tried, "links")
    # where every pair held, all that may link is joined; only signatures with a pair that failed can hold more
    again = members.join(likely.join(tried.join(links, ["a", "b"], "left_anti"), ["a", "b"], "left_semi").select("sig").distinct(), "sig", "left_semi")
    found = components(links, tables).select(F.col("node").alias("class"), F.col("component").alias("comp"))
    again = open_blocks(again.join(found, "class", "left").withColumn("comp", F.coalesce("comp", "class")))
    left = tables.write(block_rows(again, F.struct("n", "bits")).mapInArrow(_promising(similarity), "sig long, i long, j long, class long, comp long"), "promising")
    same = left.groupBy("sig", "i", "j").agg(*prints, F.count("*").alias("members"))
    once = same.groupBy("p1", "p2", "members").agg(F.min(F.struct("sig", "i", "j")).alias("at")).select("at.*")
    more = block_rows(left.join(once, ["sig", "i", "j"], "left_semi"), F.col("features")).mapInArrow(_verify_blocks(similarity), "a long, b long")
    more = tables.write(more.distinct(), "more_links")
    tables.drop(sets, members, left, likely, tried)
    return links.unionByName(more)


def _placed(docs: DataFrame, id_col: str, text_col: str, similarity: int) -> DataFrame:
    """(_id, pick, n_shingles, class, comp, component_id): class and comp are numbers, null for empty sets; comp tells components apart even
    where two have the same smallest id. What it reads is written and stays."""
    each = store.durable(classes(docs, id_col, text_col), "classes")
    with store.Tables(docs.sparkSession) as tables:
        known = each.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.max("n_shingles").cast("int").alias("n"), F.min("pick").alias("pick"), F.min("_id").alias("first"))
        known = tables.write(known.withColumn("class", F.monotonically_increasing_id()), "known")  # written, so the numbers hold
        found = components(class_links(docs, known, tables, id_col, text_col, similarity), tables)
        grouped = known.select("h1", "h2", "class", "first").join(found, F.col("class") == F.col("node"), "left").select("h1", "h2", "class", "first", F.coalesce("component", "class").alias("comp"))
        named = store.durable(grouped.join(grouped.groupBy("comp").agg(F.min("first").alias("component_id")), "comp"), "named")
    return each.join(named.drop("first"), ["h1", "h2"], "left").select("_id", "pick", "n_shingles", "class", "comp", F.coalesce("component_id", "_id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: id, n_shingles, class (equal sets share one; null without words) and component_id, the
    smallest id that links reach."""
    return _placed(docs, id_col, text_col, similarity).select(F.col("_id").alias(id_col), "n_shingles", "class", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """docs with one document of each component: the one with the smallest id; of rows with equal id in a component, one.

    Rows that share an id are judged each by its own text. Documents without words, and rows with a null id, stay. Only keys of rows
    that go and of equal rows of which one stays are joined with the documents."""
    key = [f"{store.RESERVED}id", f"{store.RESERVED}pick"]
    found = store.durable(_placed(docs, id_col, text_col, similarity), "found").where("_id IS NOT NULL AND class IS NOT NULL")
    rows = found.groupBy("comp", "_id", "class", "pick").agg(F.count("*").alias("copies"))
    first = rows.groupBy("comp").agg(F.min(F.struct("_id", "pick", "class")).alias("first"))
    judged = rows.join(first, "comp").withColumn("stays", F.struct("_id", "pick", "class") == F.col("first"))
    judged = store.durable(judged.select(F.col("_id").alias(key[0]), F.col("pick").alias(key[1]), "stays", "copies"), "judged")
    keyed = docs.withColumns({key[0]: F.col(id_col), key[1]: _pick(id_col, text_col)})
    rest = keyed.join(judged.where("NOT stays").select(*key), key, "left_anti")
    again = judged.where("stays AND copies > 1").select(*key)
    once = rest.join(again, key, "left_semi").dropDuplicates(key)
    return rest.join(again, key, "left_anti").unionByName(once).select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_components(store.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
), s AS (
  SELECT doc_id, r, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d
), e AS (SELECT r, len(x) AS n, unnest(x) AS h FROM s),
c AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.r, b.r),
l AS (SELECT x, y FROM c WHERE 100 * k >= 80 * (nx + ny - k) UNION ALL SELECT y, x FROM c WHERE 100 * k >= 80 * (nx + ny - k)),
t(a, b) AS (SELECT r, r FROM s UNION SELECT t.a, l.y FROM t JOIN l ON l.x = t.b)
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN t ON t.a = s.r JOIN s o ON o.r = t.b GROUP BY s.r, s.doc_id, s.x
"""
