"""Contiguous shards of near-equal bytes from global prefix sums of record sizes.

Only (id, size, crc32) moves. Equal records are folded to one row with a count before the shuffle, and counts over ``FOLD`` are
cut into pieces, so that copies never meet in one task. The rows are dealt into ranges of (id, size, crc32), ranges get totals, the totals'
prefix sums give each range its first byte, and a running sum inside the range gives each record its own.
Everything is built-in DataFrame work.

Defined cases: ids may be of any type with an order; a null text has the size of its overhead alone and a null crc32; a null id sorts first;
ties of id go by size and crc32, and equal records are interchangeable; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import store

SHARDS = 40
OVERHEAD = 16
#: Most equal records that one folded row stands for.
FOLD = 100_000


def record_size(text: Column, overhead: int = OVERHEAD) -> Column:
    """UTF-8 bytes of a text, none for null, and the bytes of its frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per record: id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in a shard).

    A record goes where its middle byte lies among equal cuts of all bytes, so shards differ by one record at most
    on either side of a cut. With a table of fewer bytes than cuts some shards stay empty.
    """
    text, order = F.col(text_col).cast("string"), ["_id", "_size", "_crc", "_piece"]
    sized = docs.select(F.col(id_col).alias("_id"), record_size(text).alias("_size"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"))
    folded = sized.groupBy("_id", "_size", "_crc").agg(F.count("*").alias("_all")).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1, F.lit(FOLD).cast("long"))))
    folded = folded.withColumn("_n", F.least(F.lit(FOLD).cast("long"), F.col("_all") - F.col("_piece"))).drop("_all")
    ranged = store.durable(folded.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")  # written, so the ranges hold
    by_range = ranged.groupBy("_range").agg(F.sum(F.col("_size") * F.col("_n")).alias("_bytes"), F.sum("_n").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select(
        "*",
        F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(inside), F.lit(0)).alias("_bytes_in"),
        F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_rows_in"),
    ).join(F.broadcast(before), "_range")
    copies = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    middle = 2 * (F.col("_bytes_before") + F.col("_bytes_in") + F.col("_k") * F.col("_size")) + F.col("_size")
    sharded = copies.select(
        "_id", "_size", "_crc",
        F.floor(middle.cast("decimal(30,0)") * shards / (2 * F.col("_all"))).cast("int").alias("_shard"),
        (F.col("_rows_before") + F.col("_rows_in") + F.col("_k")).alias("_index"),
    )
    first = sharded.groupBy("_shard").agg(F.min("_index").alias("_first"))  # one row a shard
    return sharded.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_index") - F.col("_first")).cast("long").alias("slot"),
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes."""
    return assign_shards(store.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
