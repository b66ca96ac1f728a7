"""Versioned revisions: publishing, views for readers, and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def input_signature(*columns: str):
    """sha-256 of the JSON of the columns, in the order of their names; null and missing differ from empty."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def publish_revisions(history: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, changes). history: story_id, tag, signature, is_current; generated: story_id, tag, signature.

    The same signature as the current row changes nothing; one that is stored already is made current again; else a row is added.
    changes: story_id, tag, change (unchanged, create, update, reuse). One row of a touched story stays current."""
    current = history.where("is_current").select("story_id", F.col("signature").alias("_current"))
    stored = history.groupBy("story_id", "signature").agg(F.min("tag").alias("_stored"))
    g = generated.join(current, "story_id", "left").join(stored, ["story_id", "signature"], "left")
    change = F.when(F.col("_current") == F.col("signature"), "unchanged").when(F.col("_stored").isNotNull(), "reuse").when(F.col("_current").isNull(), "create").otherwise("update")
    decided = g.select("story_id", "signature", F.coalesce("_stored", "tag").alias("tag"), change.alias("change"))
    moved = decided.where("change <> 'unchanged'").select("story_id", F.col("tag").alias("_now"))
    added = decided.where("change IN ('create', 'update')").select("story_id", "tag", "signature", F.lit(False).alias("is_current"))
    joined = history.select("story_id", "tag", "signature", "is_current").unionByName(added).join(moved, "story_id", "left")
    flagged = joined.select("story_id", "tag", "signature", F.when(F.col("_now").isNull(), F.col("is_current")).otherwise(F.col("tag") == F.col("_now")).alias("is_current"))
    return flagged, decided.select("story_id", "tag", "change")


def version_events(changes: DataFrame, scope: str) -> DataFrame:
    return changes.where("change <> 'unchanged'").select(F.lit(scope).alias("scope"), F.col("story_id").alias("scope_id"), "tag", F.when(F.col("change") == "create", "create").otherwise("update").alias("kind"))


def revision_views(history: DataFrame, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """(story_id, current, previous[, seen]): the flagged or else newest revision, the newest other one, and the one a reader saw.

    history: story_id, revision, is_current and the order columns."""
    key = F.struct(*order)
    best = history.groupBy("story_id").agg(F.max_by("revision", F.struct("is_current", key)).alias("current"))
    other = history.join(best, "story_id").where("revision <> current").groupBy("story_id").agg(F.max_by("revision", key).alias("previous"))
    views = best.join(other, "story_id", "left")
    if seen is None:
        return views
    stored = history.select("story_id", F.col("revision").alias("seen"))
    return views.join(seen.join(stored, ["story_id", "seen"]), "story_id", "left")


def brief_changes(pairs: DataFrame, most: int = 3) -> DataFrame:
    """pairs with state and changes: current columns and the same with ``other_``: status, outlets, paragraphs, sections (array), points (array)."""
    c = F.col
    more = lambda col, up, down: F.when(c(col) > c(f"other_{col}"), up).when(c(col) < c(f"other_{col}"), down)
    listed = F.array(
        F.when(c("status") != c("other_status"), F.concat(F.lit("status is now "), c("status"))), more("outlets", "more outlets", "fewer outlets"), more("paragraphs", "longer text", "shorter text"),
        F.when(F.size(F.array_except("sections", "other_sections")) > 0, F.concat(F.lit("rewritten: "), F.array_join(F.array_except("sections", "other_sections"), ", "))),
        F.when(F.size(F.array_except("points", "other_points")) > 0, F.lit("new supporting points")),
    )
    changes = F.slice(F.filter(listed, lambda x: x.isNotNull()), 1, most)
    first = c("other_status").isNull()
    return pairs.withColumn("state", F.when(first, "first").when(F.size(changes) == 0, "same").otherwise("changed")).withColumn("changes", F.when(first, F.array().cast("array<string>")).otherwise(changes))


def perspective_changes(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The same for perspectives: status, outlets, framings (array), lenses (array of available ones), review."""
    c = F.col
    gained, lost = F.array_except("lenses", "other_lenses"), F.array_except("other_lenses", "lenses")
    wider, narrower = F.size(F.array_except("framings", "other_framings")) > 0, F.size(F.array_except("other_framings", "framings")) > 0
    listed = F.array(
        F.when(c("status") != c("other_status"), F.concat(F.lit("status is now "), c("status"))),
        F.when(wider & narrower, "source mix shifted").when(wider, "source mix widened").when(narrower, "source mix narrowed"),
        F.when(F.size(gained) > 0, F.concat(F.lit("gained: "), F.array_join(F.array_sort(gained), ", "))), F.when(F.size(lost) > 0, F.concat(F.lit("lost: "), F.array_join(F.array_sort(lost), ", "))),
        F.when(c("review") != c("other_review"), "review flag changed"), F.when(c("outlets") != c("other_outlets"), "source mix refreshed"),
    )
    changes = F.slice(F.filter(listed, lambda x: x.isNotNull()), 1, most)
    first = c("other_status").isNull()
    return pairs.withColumn("state", F.when(first, "first").when(F.size(changes) == 0, "same").otherwise("changed")).withColumn("changes", F.when(first, F.array().cast("array<string>")).otherwise(changes))


def tracked_history(views: DataFrame, tracking: DataFrame) -> DataFrame:
    """tracking (user_id, story_id, seen) with compared_to (what was seen, else the previous revision), state and has_updates."""
    j = tracking.join(views, "story_id", "left")
    state = F.when(F.col("current").isNull(), "pending").when(F.coalesce(F.col("seen"), F.col("previous")).isNull() | (F.col("seen") == F.col("current")), "current").otherwise("updated")
    return j.select("user_id", "story_id", "current", F.coalesce("seen", "previous").alias("compared_to"), state.alias("state"), (state == "updated").alias("has_updates"))


def change_timeline(events: DataFrame, order: list[str], limit: int = 8) -> DataFrame:
    """(story_id, timeline, latest): the labels of the latest events, newest first, and the first three. events: story_id, label."""
    newest = F.row_number().over(Window.partitionBy("story_id").orderBy(*(F.desc(c) for c in order)))
    top = events.withColumn("_k", newest).where(F.col("_k") <= limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "label"))), lambda x: x["label"])
    return top.groupBy("story_id").agg(listed.alias("timeline")).withColumn("latest", F.slice("timeline", 1, 3))
