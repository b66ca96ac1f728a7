"""What readers follow, have seen and are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracking_state(stories: DataFrame, saved: DataFrame, follows: DataFrame, views: DataFrame) -> DataFrame:
    """(user_id, story_id, saved_at, followed_at, viewed_at): one row where anything is set, for known stories."""
    keys = ["user_id", "story_id"]
    rows = saved.join(follows, keys, "full_outer").join(views, keys, "full_outer")
    return rows.join(stories.select("story_id"), "story_id", "left_semi")


def fold_tracking_events(events: DataFrame) -> DataFrame:
    """(user_id, story_id, saved, followed, viewed_at, seen): the state after events in order of (second, event_id).

    follow also saves; unsave and unfollow undo; a view keeps the tag seen before if it brings none. Rows with nothing set go.
    events: user_id, story_id, action, second, event_id and, where known, tag."""
    at = F.struct("second", "event_id")

    def last(value, test):
        return F.max_by(F.when(test, value), F.when(test, at))

    a = F.col("action")
    tag = F.col("tag") if "tag" in events.columns else F.lit(None).cast("string")
    folded = events.groupBy("user_id", "story_id").agg(
        last(a != "unsave", a.isin("save", "follow", "unsave")).alias("saved"), last(a == "follow", a.isin("follow", "unfollow")).alias("followed"),
        F.max(F.when(a == "view", F.col("second"))).alias("viewed_at"), last(tag, (a == "view") & tag.isNotNull()).alias("seen"),
    )
    folded = folded.fillna(False, ["saved", "followed"])
    return folded.where(F.col("saved") | F.col("followed") | F.col("viewed_at").isNotNull())


def import_tracking(state: DataFrame, imported: DataFrame) -> DataFrame:
    """Merge a reader's local records: existing save and follow win, the later view wins, a stored seen tag wins."""
    keys = ["user_id", "story_id"]
    j = state.alias("s").join(imported.alias("i"), keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"i.{c}")).alias(c)
    return j.select(*keys, pick("saved_at"), pick("followed_at"), F.greatest("s.viewed_at", "i.viewed_at").alias("viewed_at"), pick("seen"))


def tracked_stories(state: DataFrame, changes: DataFrame, history: DataFrame) -> DataFrame:
    """Saved or followed stories with change count, latest change and update state, and their place in the reader's list.

    changes: story_id, second; history: user_id, story_id, has_updates."""
    kept = state.where("saved_at IS NOT NULL OR followed_at IS NOT NULL")
    counted = changes.groupBy("story_id").agg(F.count("*").alias("changes"), F.max("second").alias("latest_change"))
    rows = kept.join(counted, "story_id", "left").join(history.select("user_id", "story_id", "has_updates"), ["user_id", "story_id"], "left")
    return rows.fillna(0, ["changes"]).fillna(False, ["has_updates"]).withColumn("sort_at", F.coalesce("followed_at", "saved_at", "viewed_at"))


def preview_state(records: DataFrame, stories: DataFrame) -> DataFrame:
    """(user_id, story_id, slug, saved_at, followed_at, viewed_at): the tracking state that a reader's own records give, as ``tracked_stories`` takes it.

    A record is of the story with its id, or, if there is none, with its slug; it counts if it has a slug and anything was done. Records of one story are taken together, the first save and follow and the last view.
    records: user_id, story_id, slug, saved_at, followed_at, viewed_at; stories: story_id, slug."""
    c = F.col
    kept = records.where(F.coalesce("slug", F.lit("")) != "").where("saved_at IS NOT NULL OR followed_at IS NOT NULL OR viewed_at IS NOT NULL")
    by_id = stories.select(c("story_id").alias("_asked"), c("story_id").alias("_by_id"))
    by_slug = stories.groupBy("slug").agg(F.min("story_id").alias("_by_slug"))
    found = kept.withColumnRenamed("story_id", "_asked").join(by_id, "_asked", "left").join(by_slug, "slug", "left").withColumn("story_id", F.coalesce("_by_id", "_by_slug")).where("story_id IS NOT NULL")
    state = found.groupBy("user_id", "story_id").agg(F.min("saved_at").alias("saved_at"), F.min("followed_at").alias("followed_at"), F.max("viewed_at").alias("viewed_at"))
    return state.join(stories.select("story_id", "slug"), "story_id").select("user_id", "story_id", "slug", "saved_at", "followed_at", "viewed_at")


def story_detail(stories: DataFrame, facts: DataFrame, members: DataFrame, packs: DataFrame, evidence: DataFrame, corrections: DataFrame, briefs: DataFrame, perspectives: DataFrame, lenses: list[str], hidden: list[str]) -> DataFrame:
    """One nested row a visible story: facts, articles and evidence in order, corrections newest first, a pack for every lens, empty ones too, and the current
    brief and perspective (story_id, revision), where there are any. Each kind of child is gathered by itself before it is joined."""
    gathered = lambda frame, name, fields, value: frame.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), value).alias(name))
    children = {
        "facts": (gathered(facts, "facts", ["sort_order", "fact_text"], lambda x: x["fact_text"]), "array<string>"),
        "articles": (gathered(members, "articles", ["rank_in_story", "article_id", "outlet", "framing_group"], lambda x: F.struct(x["article_id"].alias("article_id"), x["outlet"].alias("outlet"), x["framing_group"].alias("framing_group"))), None),
        "evidence": (gathered(evidence, "evidence", ["sort_order", "label"], lambda x: x["label"]), "array<string>"),
        "corrections": (corrections.groupBy("story_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "label")), asc=False), lambda x: x["label"]).alias("corrections")), "array<string>"),
    }
    p = packs.groupBy("story_id").agg(F.map_from_entries(F.array(*(
        F.struct(F.lit(x).alias("k"), F.transform(F.array_sort(F.collect_list(F.when(F.col("lens") == x, F.struct("rank", "article_id")))), lambda v: v["article_id"]).alias("v")) for x in lenses
    ))).alias("packs"))
    empty = F.map_from_entries(F.array(*(F.struct(F.lit(x).alias("k"), F.expr("CAST(array() AS array<bigint>)").alias("v")) for x in lenses)))
    out = stories.where(~F.col("origin").isin(hidden))
    for name, (rows, kind) in children.items():
        kind = kind or rows.schema[name].dataType.simpleString()
        out = out.join(rows, "story_id", "left").withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS {kind})")))
    out = out.join(p, "story_id", "left").withColumn("packs", F.coalesce("packs", empty))
    return out.join(briefs.withColumnRenamed("revision", "brief"), "story_id", "left").join(perspectives.withColumnRenamed("revision", "perspective"), "story_id", "left")
