"""The jobs as streams: first sightings, source health, reader sessions, tracking state and publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.reader import fold_tracking_events
from newsloom.operators.revisions import publish_revisions
from newsloom.operators.tables import upsert_by_key


def stream_discoveries(stream: DataFrame, at: str = "at", url: str = "url", delay: str = "1 hour") -> DataFrame:
    """First sighting of each url within the watermark; later ones and late rows are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([url])


def stream_source_health(stream: DataFrame, window: str = "48 hours", slide: str = "1 hour", delay: str = "1 hour", at: str = "at") -> DataFrame:
    """(source_id, start, fetches, failed, fetched): counts per source over sliding windows; batch frames work too."""
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, window, slide), "source_id")
    return grouped.agg(F.count("*").alias("fetches"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "fetched").alias("fetched")).select(
        "source_id", F.col("window.start").alias("start"), "fetches", "failed", "fetched"
    )


def stream_reader_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", at: str = "at") -> DataFrame:
    """(user_id, start, end, events, views, evidence): session windows for each reader. A row that comes after its session was put out, but before the watermark passes the row itself, opens a
    piece of its own, which ``joined_sessions`` joins."""
    grouped = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), "user_id")
    return grouped.agg(F.count("*").alias("events"), F.count_if(F.col("action") == "view").alias("views"), F.count_if(F.col("action") == "evidence").alias("evidence")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "views", "evidence"
    )


def joined_sessions(pieces: DataFrame) -> DataFrame:
    """What ``stream_reader_sessions`` put out, with the pieces of a reader that overlap as one session. A window holds the pieces of a reader."""
    order = Window.partitionBy("user_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy("user_id", "_session").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.sum(c).alias(c) for c in ("events", "views", "evidence"))).drop("_session")


_STATE = "saved boolean, saved_at long, saved_id long, followed boolean, followed_at long, followed_id long, viewed_at long"
_NAMES = ["saved", "saved_at", "saved_id", "followed", "followed_at", "followed_id", "viewed_at"]


def stream_tracking_state(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, story_id, saved, followed, viewed_at) after each micro-batch, by the rules of fold_tracking_events.

    An event that is older than what its field was last set by changes nothing, so order of arrival does not matter.
    With ttl_ms, state unused that long is dropped; such a query keeps running idle batches, so it does not end under availableNow. Without it, state
    grows with the pairs of reader and story, as the stored table does, and is kept by plain aggregates."""
    if not ttl_ms:
        return fold_tracking_events(stream).select("user_id", "story_id", "saved", "followed", "viewed_at")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved, saved_at, saved_id, followed, followed_at, followed_id, viewed_at = state.get if state.exists else (False, -1, -1, False, -1, -1, -1)
        for batch in batches:
            for action, second, event in zip(batch.action, batch.second, batch.event_id, strict=True):
                if action in ("save", "follow", "unsave") and (second, event) > (saved_at, saved_id):
                    saved, saved_at, saved_id = action != "unsave", int(second), int(event)
                if action in ("follow", "unfollow") and (second, event) > (followed_at, followed_id):
                    followed, followed_at, followed_id = action == "follow", int(second), int(event)
                if action == "view":
                    viewed_at = max(viewed_at, int(second))
        state.update((saved, saved_at, saved_id, followed, followed_at, followed_id, viewed_at))
        state.setTimeoutDuration(ttl_ms)
        if saved or followed or viewed_at >= 0:
            yield pd.DataFrame([(key[0], key[1], saved, followed, viewed_at)], columns=["user_id", "story_id", "saved", "followed", "viewed_at"])

    folded = stream.groupBy("user_id", "story_id").applyInPandasWithState(fold, "user_id long, story_id long, saved boolean, followed boolean, viewed_at long", _STATE, "update", "ProcessingTimeTimeout")
    return folded.withColumn("viewed_at", F.when(F.col("viewed_at") >= 0, F.col("viewed_at")))


#: Parts of a published table; a micro-batch rewrites those that it touches.
BUCKETS = 64


def latest_rows(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("_row")).select("_row.*")


def upsert(keys: list[str], order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for stream_publish: the batch's last row of a key replaces the stored one."""
    return lambda stored, batch: latest_rows(batch, keys, order) if stored is None else upsert_by_key(stored, latest_rows(batch, keys, order), keys)


def revise(order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for stream_publish: each story's last generated revision (story_id, tag, signature) is published into its history."""

    def merge(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = latest_rows(batch, ["story_id"], order).select("story_id", "tag", "signature")
        history = batch.sparkSession.createDataFrame([], new.withColumn("is_current", F.lit(True)).schema) if stored is None else stored
        return publish_revisions(history, new)[0]

    return merge


def stream_publish(stream: DataFrame, path: str, checkpoint: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch into a table under ``path``, in buckets of the keys.

    Batch n writes the buckets it touches under v{n}, and a manifest of the version in which each bucket was last written; all else stays as it is. A repeated batch starts from the
    manifest before it and writes the same. The manifest has a row a bucket."""
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        known = {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/v{number - 1}").collect()} if number else {}
        touched = sorted(r.bucket for r in batch.select(at.alias("bucket")).distinct().collect())
        held = [f"{path}/v{known[b]}/bucket={b}" for b in touched if b in known]
        merged = merge(spark.read.parquet(*held) if held else None, batch)
        merged.withColumn("bucket", at).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
        now = {**known, **dict.fromkeys(touched, number)}
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The table after batch ``number``."""
    parts = spark.read.parquet(f"{path}/manifest/v{number}").collect()
    return spark.read.parquet(*(f"{path}/v{r.version}/bucket={r.bucket}" for r in parts))


def finished(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over all that is there, and read what it put out; ``batch`` numbers the micro-batches."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")
