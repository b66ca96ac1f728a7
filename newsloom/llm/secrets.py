"""Secret scan with built-in functions only: base patterns, and a randomness test battery for other tokens.

Spans come from one regular-expression pass: matches are fenced with a private-use character and the text is split at the
fences, so positions are running sums of lengths in code points.

Tokens of ``TOKEN`` characters are tested for randomness in the encoding their characters suggest (hex, base32, upper-case
or mixed alphanumeric, base64): chi-squared uniformity of the alphabet, a runs test about the middle of the alphabet and the lag-one
serial correlation. The least of the three p-values, times three, is the evidence against randomness. Text-like tokens are the
discoveries of a Benjamini-Hochberg procedure run in each class of lengths over the whole corpus, from a histogram of p-values of
fixed size; the tokens that it leaves are reported as ``random``, unless they meet a base span. Longer classes have sharper
tests and a threshold of their own; tokens under ``SHORTEST`` characters have no power and are left
alone, and so are tokens without a digit, which words glued together would imitate.

Defined cases: a null text reads as empty, with no spans; equal rows get equal results; very long tokens are tested whole, and texts of very many matches in time that grows with them; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store

KINDS = ["assign", "access", "hex"]
#: Fixed patterns of the base kinds; a match of assign counts if its value has 6 characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHORTEST = 24
TOKEN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST
#: Share of random tokens that may be taken for text in a class of lengths.
MISS_RATE = 0.01
_FENCE, _OTHER = "\ue000", "\ue001"
_SPAN = "array<struct<start: int, end: int, value: string>>"
_BINS = 400
#: Pieces of a text whose positions are summed together; even, so that a block's second piece is a match.
BLOCK_PIECES = 512
#: Characters of the encodings in order.
ALPHABET = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "mixed": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    Every second piece between fences is a match. Lengths are summed in blocks of pieces, then over the blocks, so an array that grows is copied within a block only."""
    safe = F.when(F.instr(text, _FENCE) > 0, F.translate(text, _FENCE, _OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(safe, pattern, f"{_FENCE}$0{_FENCE}"), _FENCE, -1)

    def inside(block: Column) -> Column:
        return F.aggregate(
            block,
            F.expr(f"named_struct('pos', 0, 'k', 0, 'out', CAST(array() AS {_SPAN}))"),
            lambda a, p: F.struct(
                (a["pos"] + F.length(p)).alias("pos"),
                (a["k"] + 1).alias("k"),
                F.when(a["k"] % 2 == 1, F.concat(a["out"], F.array(F.struct(a["pos"].alias("start"), (a["pos"] + F.length(p)).alias("end"), p.alias("value"))))).otherwise(a["out"]).alias("out"),
            ),
        )

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(
            blocks,
            F.expr("named_struct('pos', 0, 'out', CAST(array() AS array<int>))"),
            lambda a, b: F.struct((a["pos"] + b["pos"]).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")),
            lambda a: a["out"],
        )
        moved = lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK_PIECES).cast("int")), lambda b: F.slice(p, b * BLOCK_PIECES + 1, BLOCK_PIECES))
    found = _bound(_bound(pieces, cut), lambda blocks: _bound(F.transform(blocks, inside), joined))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-F.least(z * z, F.lit(1400.0)) / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def token_tests(tokens: DataFrame, col: str = "value") -> DataFrame:
    """tokens with encoding, p_uniform, p_runs, p_serial and p (the least, times three)."""
    body = F.regexp_replace(col, "=+$", "")
    encoding = (
        F.when(F.rlike(body, F.lit("^[0-9a-f]+$")) | F.rlike(body, F.lit("^[0-9A-F]+$")), "hex")
        .when(F.rlike(body, F.lit("^[A-Z2-7]+$")), "base32")
        .when(F.rlike(body, F.lit("^[A-Z0-9]+$")), "upper")
        .when(F.rlike(body, F.lit("^[A-Za-z0-9]+$")), "mixed")
        .otherwise("base64")
    )
    t = tokens.withColumn("encoding", encoding)
    letters = F.create_map(*(F.lit(x) for kv in ALPHABET.items() for x in kv))[F.col("encoding")]
    t = t.withColumn("_letters", letters).withColumn("_c", F.split(F.when(F.col("encoding") == "hex", F.lower(body)).otherwise(body), "(?!^)"))
    t = t.withColumn("_n", F.size("_c").cast("double")).withColumn("_k", F.when(F.col("encoding") == "base64", 64).otherwise(F.length("_letters")).cast("double"))
    t = t.withColumn("_x", F.expr("transform(_c, c -> CAST(instr(_letters, c) AS DOUBLE))"))
    squares = F.expr("aggregate(array_distinct(_c), 0D, (a, c) -> a + pow(size(filter(_c, x -> x = c)), 2))")
    t = t.withColumn("_chi", F.col("_k") / F.col("_n") * squares - F.col("_n")).withColumn("_df", F.col("_k") - 1)
    wilson = (F.pow(F.greatest(F.col("_chi"), F.lit(1e-9)) / F.col("_df"), 1 / 3) - (1 - 2 / (9 * F.col("_df")))) / F.sqrt(2 / (9 * F.col("_df")))
    t = t.withColumn("p_uniform", _upper_tail(wilson))
    t = t.withColumn("_up", F.expr("aggregate(_x, 0D, (a, x) -> a + IF(x > _k / 2, 1D, 0D))")).withColumn("_down", F.col("_n") - F.col("_up"))
    t = t.withColumn("_runs", F.expr("1D + aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (a, b) -> IF((a > _k / 2) <> (b > _k / 2), 1D, 0D)), 0D, (a, b) -> a + b)"))
    product = 2 * F.col("_up") * F.col("_down")
    spread = F.sqrt(F.greatest(product * (product - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1)), F.lit(1e-9)))
    t = t.withColumn("p_runs", F.when(product == 0, F.lit(1e-12)).otherwise(2 * _upper_tail(F.abs((F.col("_runs") - product / F.col("_n") - 1) / spread))))
    t = t.withColumn("_m", F.expr("aggregate(_x, 0D, (a, x) -> a + x) / _n"))
    t = t.withColumn("_v", F.expr("aggregate(_x, 0D, (a, x) -> a + (x - _m) * (x - _m))"))
    t = t.withColumn("_s", F.expr("aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (a, b) -> (a - _m) * (b - _m)), 0D, (a, b) -> a + b)"))
    serial = F.col("_s") / F.greatest(F.col("_v"), F.lit(1e-9)) * F.sqrt("_n")
    t = t.withColumn("p_serial", F.when(F.col("_v") == 0, F.lit(1e-12)).otherwise(2 * _upper_tail(F.abs(serial))))
    t = t.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial")))
    return t.drop("_letters", "_c", "_n", "_k", "_x", "_chi", "_df", "_up", "_down", "_runs", "_m", "_v", "_s")


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n / SHORTEST)), F.lit(8)).cast("int")


def text_thresholds(tested: DataFrame, miss_rate: float = MISS_RATE) -> dict[int, int]:
    """For each length class the first bin of -10 log10(p) whose tokens count as text (Benjamini-Hochberg).

    The histogram has at most 9 classes and 401 bins, whatever the corpus."""
    counts: dict[int, dict[int, int]] = {}
    for row in tested.groupBy("length_class", "bin").count().toLocalIterator():
        counts.setdefault(row.length_class, {})[row.bin] = row["count"]
    out = {}
    for k, bins in counts.items():
        total, above, first = sum(bins.values()), 0, _BINS + 1
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b / 10) <= miss_rate * above / total:
                first = b
        out[k] = first
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and extra: arrays of (start, kind index, end, kind), sorted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = lambda spans, i, name: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("at"), s["end"].alias("end"), F.lit(name).alias("kind")))
    maybe_assign = F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), text).otherwise("")
    assigned = F.filter(spans_of(maybe_assign, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(kind(assigned, 0, "assign"), kind(spans_of(text, ACCESS), 1, "access"), kind(spans_of(text, HEX), 2, "hex")))
    key = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h")]
    found = docs.select(*key, base.alias("base"))
    tokens = docs.select(*key, F.explode(spans_of(text, TOKEN)).alias("t")).select("_id", "_h", "t.*").where("value RLIKE '[0-9]'")
    tested = token_tests(tokens)
    tested = tested.select(
        "_id", "_h", "start", "end", length_class(F.col("end") - F.col("start")).alias("length_class"),
        F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(_BINS)).cast("int").alias("bin"),
    )
    tested = store.durable(tested, "tokens")
    limits = text_thresholds(tested)
    limit = F.lit(_BINS + 1)
    for k, b in limits.items():
        limit = F.when(F.col("length_class") == k, b).otherwise(limit)
    random = tested.where(F.col("bin") < limit).groupBy("_id", "_h").agg(F.collect_set(F.struct("start", F.lit(3).alias("at"), "end", F.lit("random").alias("kind"))).alias("extra"))
    joined = found.alias("f").join(random.alias("r"), F.col("f._id").eqNullSafe(F.col("r._id")) & (F.col("f._h") == F.col("r._h")), "left")
    clear = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return joined.select(F.col("f._id").alias(id_col), "base", F.coalesce(F.array_sort(clear), F.slice("base", 1, 0)).alias("extra"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and random secrets of every document."""
    found = scan_secrets(store.table(spark, sf_dir, "documents"))
    n = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id", *(n(k) for k in KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
