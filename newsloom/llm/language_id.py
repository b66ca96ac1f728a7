"""Language identification by compression with one raw-content zstandard dictionary per language.

What is compressed is a text's distinct words (runs of letters, lower-cased, in order of first appearance, a space
between), so that shouting, list marks and repeated lines do not drown the language. A language's dictionary is such words of
texts of that language. A text is compressed with each dictionary in turn; the language that gives the fewest bytes is
the answer, the score is the share of its likelihood when each byte saved counts, and an answer whose lead is under
``MARGIN`` of the size is marked rejected.

Only the dictionaries are sampled: at most ``DICTIONARY_BYTES`` for each language, from at most ``DICTIONARY_DOCS``
labelled texts taken in the order of a hash of their id and read whole; of a text's distinct words at most ``DICTIONARY_BYTES`` leave its
task, spread over the text. Every whole text is classified.

Defined cases: letters are the characters of the Unicode categories L*, so digits, superscripts and fractions are none; a null text or one
without a letter is ``und`` with score 0; labels that are null or blank teach nothing;
without labelled rows all is ``und``; ties go to the language with most labelled rows, then to the first in the alphabet; repeated rows each
get their row and teach once; ids may be of any type; an empty table gives no rows; extra columns are harmless.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import store

DICTIONARY_BYTES = 64 * 1024
DICTIONARY_DOCS = 200
LEVEL = 12
MARGIN = 0.01
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")  # letters, and some numerals that are sorted out below


def words_of(text: str) -> list[str]:
    """Distinct runs of letters in order of first appearance."""
    found = dict.fromkeys(_WORDS.findall(text.lower()))
    if all(map(str.isalpha, found)):  # true of the categories L* alone
        return list(found)
    return list(dict.fromkeys(part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()))


def letters_of(text: str) -> bytes:
    return " ".join(words_of(text)).encode()


def _spread(words: list[str], most: int) -> list[str]:
    """Words of at most so many bytes with their spaces, evenly from the whole list."""
    size = sum(len(w.encode()) + 1 for w in words)
    return words if size <= most else words[:: -(-size // most)]


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> dict[str, bytes]:
    """The dictionaries, the language with most labelled rows first, each within the bound."""
    usable = labelled.where(F.trim(label_col) != "").where(F.length(text_col) > 0)
    rows = usable.select(F.col(label_col).alias("_l"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_i"), F.col(text_col).cast("string").alias("_t"))
    order = rows.select("_l", "_i", F.xxhash64("_i").alias("_o"), F.xxhash64("_t").alias("_h")).distinct()
    first = order.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy("_o", "_i", "_h"))).where(F.col("_k") <= DICTIONARY_DOCS)
    chosen = rows.withColumn("_h", F.xxhash64("_t")).join(first, ["_l", "_i", "_h"]).select("_l", "_k", "_t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_t=[" ".join(_spread(words_of(t), DICTIONARY_BYTES)) for t in batch._t])

    known = [row._l for row in usable.groupBy(F.col(label_col).alias("_l")).count().orderBy(F.desc("count"), "_l").toLocalIterator()]
    parts: dict[str, dict[bytes, None]] = {label: {} for label in known}
    for row in chosen.dropDuplicates(["_l", "_k"]).mapInPandas(run, "_l string, _k int, _t string").orderBy("_l", "_k").toLocalIterator():
        if sum(map(len, parts[row._l])) < DICTIONARY_BYTES:
            parts[row._l][row._t.encode()] = None
    return {label: b" ".join(parts[label])[:DICTIONARY_BYTES] for label in known}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected; the text column is not kept."""
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionaries.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = []
        for label, content in shared.value:
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            known.append((label, zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False, write_checksum=False)))
        for batch in batches:
            labels, scores, rejected = [], [], []
            for text in batch.pop(f"{store.RESERVED}text"):
                data = letters_of(text or "")
                if not known or not data:
                    labels.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                sizes = [len(c.compress(data)) for _, c in known]
                best = min(sizes)
                label = known[at := sizes.index(best)][0]
                second = min(sizes[:at] + sizes[at + 1 :], default=2 * best)
                labels.append(label)
                scores.append(1 / sum(math.exp(max(-60.0, (best - n) / 4)) for n in sizes))
                rejected.append(second - best < margin * best)
            yield batch.assign(lang_pred=labels, score=scores, rejected=rejected)

    frame = docs.select(*kept, F.col(text_col).cast("string").alias(f"{store.RESERVED}text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInPandas(run, f"{fields}, lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents outside the held-out quarter."""
    docs = store.table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    dictionaries = learn(docs.where(~held).select("doc_id", "text", "lang"))
    return classify(docs.select("doc_id", held.alias("held_out"), "text"), dictionaries)
