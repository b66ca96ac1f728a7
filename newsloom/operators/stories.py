"""Choosing candidates, leads, summaries and rankings of stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scoring import is_title_only_stub, summary_quality
from newsloom.functions.text import clean_snippet, is_non_narrative, overlap_tokens, settled, squeeze, token_overlap
from newsloom.operators.similarity import cosine_pairs
from newsloom.sources.scratch import durable


def top_per(frame: DataFrame, by: list[str], order: list, k: int, rank: str = "_k") -> DataFrame:
    """The first k rows of each group in the given total order; the limit is applied before the shuffle too."""
    return frame.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def top_rows(frame: DataFrame, order: list, k: int | None = None) -> DataFrame:
    """The first k rows overall, by a distributed top-k."""
    return frame.orderBy(*order).limit(k)


def select_candidates(scored: DataFrame, score: str, source: str, tie: str, least: int = 4, cap: int = 4, floor: int = 18) -> DataFrame:
    """Items of ``least`` points, at most ``cap`` for a source; if fewer than ``floor`` stay, the best half of all items instead.

    The scores are written once; one aggregate over sources decides the branch."""
    scored, order = durable(scored, "scored"), [F.desc(score), F.asc(tie)]
    by_source = scored.groupBy(source).agg(F.count("*").alias("n"), F.count_if(F.col(score) >= least).alias("good"))
    sizes = by_source.agg(F.sum("n").alias("n"), F.sum(F.least("good", F.lit(cap))).alias("capped")).first()
    if (sizes.capped or 0) >= floor:
        return top_per(scored.where(F.col(score) >= least), [source], order, cap).drop("_k")
    return top_rows(scored, order, max(floor, (sizes.n or 0) // 2))


def lead_and_open_alternate(members: DataFrame, lead_least: int = 6, alternate_least: int = 7) -> DataFrame:
    """(story_id, lead, confident, alternate): the best read of a story, and the best open one of another outlet. members: story_id, rank_in_story, outlet, quality, is_open."""
    first = F.struct((-F.col("quality")).alias("q"), "rank_in_story", "outlet")
    lead = members.groupBy("story_id").agg(F.min_by(F.struct("rank_in_story", "outlet", "quality"), first).alias("lead"))
    other = members.where("is_open").join(lead, "story_id").where(F.col("outlet") != F.col("lead.outlet"))
    best = other.groupBy("story_id").agg(F.min_by(F.struct("rank_in_story", "quality"), first).alias("best"))
    return lead.join(best, "story_id", "left").select(
        "story_id", F.col("lead.rank_in_story").alias("lead"), (F.col("lead.quality") >= lead_least).alias("confident"),
        F.when(F.col("best.quality") >= alternate_least, F.col("best.rank_in_story")).alias("alternate"),
    )


def pair_features(pairs: DataFrame, a: str = "a", b: str = "b", broad: list[str] = (), low_signal: list[str] = (), anchor_stop: list[str] = (), generic_tags: list[str] = ()) -> DataFrame:
    """Overlap features of an item (columns ``{a}_tokens``, ``_tags``, ``_entities``, ``_contextual``) with a story (the same under ``b``,
    where sets are unions over members, ``_contextual`` says that all members are contextual), and ``similarity``."""
    lit = lambda values: F.array(*map(F.lit, values)) if len(values) else F.expr("CAST(array() AS array<string>)")
    shared = F.array_intersect(f"{a}_tokens", f"{b}_tokens")
    f = pairs.withColumn("_shared", shared).withColumn("_specific", F.array_except("_shared", lit(broad)))
    f = f.withColumn("_anchored", F.array_except("_specific", lit(low_signal))).withColumn("_tags", F.array_intersect(f"{a}_tags", f"{b}_tags"))
    return f.select(
        *pairs.columns,
        F.size("_shared").alias("overlap"), F.size("_specific").alias("specific"),
        F.size("_anchored").alias("anchored"), F.size(F.array_except("_anchored", lit(anchor_stop))).alias("event_anchors"),
        F.size(F.array_except("_tags", lit(generic_tags))).alias("strong_tags"), F.size(F.array_intersect("_tags", lit(generic_tags))).alias("generic_shared"),
        F.size(F.array_intersect(f"{a}_entities", f"{b}_entities")).alias("entities"),
        F.size(F.array_union(f"{a}_tokens", f"{b}_tokens")).alias("union_size"), F.least(F.size(f"{a}_tokens"), F.size(f"{b}_tokens")).alias("smaller"), F.size(f"{a}_tokens").alias("own_tokens"),
    )


# The similarities that join, that support, and that contextual items need; the score that joins.
JOIN_SIMILARITY, SUPPORT_SIMILARITY, CONTEXT_SIMILARITY, JOIN_SCORE = 0.42, 0.32, 0.66, 12.0


def _gates(a: str, b: str) -> Column:
    """Pairs that never match: a generic tag without support, or report and context that meet too loosely."""
    c = F.col
    loose = (c("generic_shared") > 0) & (c("strong_tags") == 0) & (c("entities") == 0) & (c("anchored") < 2)
    mixed = (c(f"{a}_contextual") != c(f"{b}_contextual")) & (c("event_anchors") < 2) & (c("entities") < 2) & (c("similarity") < CONTEXT_SIMILARITY)
    return loose | mixed


def _bare() -> Column:
    """No tag, entity or anchored token is shared."""
    return F.col("strong_tags") + F.col("generic_shared") + F.col("entities") + F.col("anchored") == 0


def match_score(features: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """features with score: the weighted sum of what item and story share; 0 for gated pairs, for items without tokens, and where neither a token nor a
    tag is shared, or nothing but a low similarity."""
    c = F.col
    ratio = lambda x, n: F.when(c(n) > 0, c(x) / c(n)).otherwise(0.0)
    bonus = lambda test, points: F.when(test, points).otherwise(0.0)
    supported = (c("strong_tags") > 0) | (c("anchored") > 0) | (c("entities") > 0)
    score = (
        8 * c("strong_tags") + 3 * c("generic_shared") + 2.5 * c("specific") + 3 * c("anchored") + 3.5 * c("event_anchors") + 1.25 * c("overlap")
        + 4 * ratio("overlap", "union_size") + 5 * ratio("specific", "smaller") + 2 * c("entities") + 12 * c("similarity")
        + bonus((c("strong_tags") > 0) & (c("specific") > 0), 3.0) + bonus((c("generic_shared") > 0) & (c("anchored") >= 2), 1.5)
        + bonus((c("similarity") >= JOIN_SIMILARITY) & supported, 3.0) - bonus(c(f"{a}_contextual"), 4.5) - bonus(c(f"{a}_contextual") & ~c(f"{b}_contextual"), 3.5)
    )
    nothing = (c("overlap") == 0) & (c("strong_tags") + c("generic_shared") == 0)
    zero = _gates(a, b) | nothing | (_bare() & (c("similarity") < JOIN_SIMILARITY)) | (c("own_tokens") == 0)
    return features.withColumn("score", F.when(zero, 0.0).otherwise(score))


def should_join(scored: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """scored with joins: by score, or, past the gates, by similarity alone if nothing else is shared, else by one of the supports."""
    c = F.col
    support = (
        ((c("similarity") >= JOIN_SIMILARITY) & ((c("anchored") > 0) | (c("entities") > 0) | (c("strong_tags") > 0)))
        | ((c("similarity") >= SUPPORT_SIMILARITY) & ((c("anchored") >= 2) | (c("entities") >= 1)))
        | ((c("strong_tags") > 0) & (c("anchored") >= 1)) | ((c("generic_shared") > 0) & (c("anchored") >= 2))
        | (c("event_anchors") >= 2) | (c("anchored") >= 4) | ((c("anchored") >= 3) & (c("overlap") >= 4))
    )
    return scored.withColumn("joins", (c("score") >= JOIN_SCORE) | (~_gates(a, b) & F.when(_bare(), c("similarity") >= JOIN_SIMILARITY).otherwise(support)))


def preferred_members(members: DataFrame) -> DataFrame:
    """Of each story the event-driven items that are no stubs; if there are none the reporting ones, then any that are no stubs, then all.

    members: story_id, signal, context, stub."""
    tier = F.when(~F.col("stub") & (F.col("signal") >= 3), 0).when(~F.col("stub") & (F.col("context") < 2), 1).when(~F.col("stub"), 2).otherwise(3)
    m = members.withColumn("_tier", tier)
    return m.join(m.groupBy("story_id").agg(F.min("_tier").alias("_tier")), ["story_id", "_tier"], "left_semi").drop("_tier")


def _most_frequent(rows: DataFrame, k: int) -> DataFrame:
    """(story_id, xs): the k most frequent x of each story, ties by text. rows: story_id, x."""
    best = top_per(rows.groupBy("story_id", "x").count(), ["story_id"], [F.desc("count"), F.asc("x")], k)
    return best.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "x"))), lambda v: v["x"]).alias("xs"))


def story_label(members: DataFrame, tokens: str, broad: list[str], k: int = 3, empty: str = "story") -> DataFrame:
    """(story_id, label): the k most frequent tokens of preferred items that are not broad, ties by token."""
    rows = preferred_members(members).select("story_id", F.explode(tokens).alias("x")).where(~F.col("x").isin(list(broad)))
    labels = _most_frequent(rows, k).select("story_id", F.array_join("xs", " ").alias("label"))
    return members.select("story_id").distinct().join(labels, "story_id", "left").fillna(empty, ["label"])


def story_query(members: DataFrame, tokens: str, entities: str, broad: list[str] = (), low_signal: list[str] = (), vague: list[str] = (), k: int = 6) -> DataFrame:
    """(story_id, tokens, entities): the k most frequent informative tokens and actionable entities of a story's anchors, ties by text; the search for more
    articles. Anchors are the substantive items that report and are no stubs; failing these any that are no stubs, any that are substantive, all.

    members: story_id, is_substantive, context, stub, and the two arrays. Entities of under four characters or in ``vague`` lead nowhere."""
    good = F.col("is_substantive")
    tier = F.when(good & (F.col("context") < 2) & ~F.col("stub"), 0).when(good & ~F.col("stub"), 1).when(good, 2).otherwise(3)
    m = members.withColumn("_tier", tier)
    m = durable(m.join(m.groupBy("story_id").agg(F.min("_tier").alias("_tier")), ["story_id", "_tier"], "left_semi").select("story_id", F.col(tokens).alias("tokens"), F.col(entities).alias("entities")), "anchors")
    words = m.select("story_id", F.explode("tokens").alias("x")).where(~F.col("x").isin([*broad, *low_signal]))
    names = m.select("story_id", F.explode("entities").alias("x")).where((F.length("x") >= 4) & ~F.col("x").isin(list(vague)))
    found = m.select("story_id").distinct().join(_most_frequent(words, k).withColumnRenamed("xs", tokens), "story_id", "left")
    return found.join(_most_frequent(names, k).withColumnRenamed("xs", entities), "story_id", "left")


def story_lead(members: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """(story_id, lead_id, lead_score). members: story_id, article_id, quality, signal, context, stub, extraction_quality, minute.
    pair_scores: story_id, article_id and score of each other member. Only preferred members lead."""
    central = pair_scores.groupBy("story_id", "article_id").agg(F.sum("score").alias("central"))
    newest = members.groupBy("story_id").agg(F.max("minute").alias("newest"))
    m = preferred_members(members).join(central, ["story_id", "article_id"], "left").join(newest, "story_id")
    body = F.when(F.col("extraction_quality") == "article_body", 6).when(F.col("extraction_quality") == "metadata_description", 2).otherwise(0)
    score = 2 * F.col("quality") + F.coalesce("central", F.lit(0.0)) + body + 1.5 * F.greatest("signal", F.lit(0)) - 6 * F.col("context") - F.when(F.col("stub"), 9).otherwise(0) - F.least((F.col("newest") - F.col("minute")) / 60, F.lit(12.0))
    scored = m.withColumn("lead_score", F.round(score, 6))
    best = scored.groupBy("story_id").agg(F.max_by(F.struct("article_id", "lead_score"), F.struct("lead_score", "minute", -F.col("article_id"))).alias("x"))
    return best.select("story_id", F.col("x.article_id").alias("lead_id"), "x.lead_score")


def needs_augmentation(members: DataFrame) -> DataFrame:
    """(story_id, needed, priority): thin stories; members has outlet, is_substantive, is_event, is_open."""
    c = members.groupBy("story_id").agg(
        F.countDistinct("outlet").alias("outlets"), F.count_if("is_substantive").alias("substantive"), F.count_if("is_event").alias("events"),
        F.count_if(F.col("is_open") & F.col("is_substantive")).alias("open_substantive"), F.count_if(~F.col("is_open")).alias("paid"),
    )
    paid = (F.col("paid") > 0) & (F.col("open_substantive") == 0)
    tests = [F.col("outlets") == 1, F.col("substantive") <= 1, F.col("events") <= 1, paid]
    priority = sum((F.when(t, p).otherwise(0) for t, p in zip(tests, (4, 3, 2, 2), strict=True)), F.lit(0))
    return c.select("story_id", (tests[0] | tests[1] | tests[2] | tests[3]).alias("needed"), priority.alias("priority"))


def story_priority(payloads: DataFrame, high_topics: list[str], points) -> DataFrame:
    """payloads (outlets, articles, topic, quality, substantive) with priority and eligible; points: a column of pattern points."""
    by = lambda test, yes, no=0: F.when(test, yes).otherwise(no)
    c = F.col
    priority = (
        12 * c("outlets") + 4 * c("articles") + by(c("topic").isin(high_topics), 10, -10) + F.least(F.greatest("quality", F.lit(-10)), F.lit(12)) + 6 * c("substantive")
        + F.when(c("outlets") >= 3, 8).when(c("outlets") == 1, -8).otherwise(0) + F.when(c("substantive") == 0, -8).when(c("substantive") == 1, -2).otherwise(0) + points
    )
    out = payloads.withColumn("priority", priority)
    return out.withColumn("eligible", (c("priority") >= 18) & (c("outlets") >= 2) & ((c("substantive") >= 2) | (c("quality") >= 8)))


def select_stories(ranked: DataFrame, tie: str, least: int = 6, floor: int = 10, most: int = 14) -> DataFrame:
    """The first ``most`` of priority ``least`` if there are ``floor`` such, else of all; then single-outlet stories without substance go."""
    good = ranked.where(F.col("priority") >= least)
    chosen = good if good.limit(floor).count() >= floor else ranked
    top = top_rows(chosen, [F.desc("priority"), F.asc(tie)], most)
    return top.where(~((F.col("outlets") == 1) & ((F.col("substantive") == 0) | (F.col("quality") < 0))))


def front_page_rank(stories: DataFrame, as_of_minute: int, mode: str = "front") -> DataFrame:
    """stories with score and position. Framing and reliability play no part, whatever columns are there.

    stories: story_id, quality, outlets, minute, section_points, origin (live, editorial, seed), eligible."""
    c, age = F.col, as_of_minute - F.col("minute")
    fresh = F.when(age <= 30, 12).when(age <= 90, 9).when(age <= 240, 6).when(age <= 720, 3).otherwise(0)
    score = (
        c("quality") + 14 * F.least("outlets", F.lit(4)) + fresh + c("section_points") + F.when(c("origin") == "seed", -8).when(c("origin") == "editorial", 10).otherwise(0)
        + F.when(c("eligible"), 18).otherwise(-18) - F.when((c("origin") == "live") & (c("outlets") == 1), 16).otherwise(0)
    )
    order = [F.desc("score"), F.desc("minute"), F.asc("story_id")] if mode == "front" else [F.desc("minute"), F.desc("score"), F.asc("story_id")]
    return stories.withColumn("score", score).orderBy(*order)


def story_payload(members: DataFrame, most: int = 5, details: list[DataFrame] = ()) -> DataFrame:
    """(story_id, articles, outlets, newest, picks, sources): counts, up to ``most`` articles, each outlet's best before second ones, and the picks' outlets.

    details are joined by story_id: labels, leads with title, summaries."""
    order = [F.asc("context"), F.asc("stub"), F.desc("signal"), F.desc("quality"), F.desc("minute"), F.asc("article_id")]
    ranked = members.withColumn("_in_outlet", F.row_number().over(Window.partitionBy("story_id", "outlet").orderBy(*order)))
    ranked = ranked.withColumn("_first", F.least("_in_outlet", F.lit(2)))
    best = top_per(ranked, ["story_id"], [F.asc("_first"), *order], most)
    listed = F.array_sort(F.collect_list(F.struct("_k", "article_id", "outlet")))
    picks = best.groupBy("story_id").agg(F.array_join(F.transform(listed, lambda x: x["article_id"].cast("string")), ",").alias("picks"), F.array_join(F.array_distinct(F.transform(listed, lambda x: x["outlet"].cast("string"))), ",").alias("sources"))
    counts = members.groupBy("story_id").agg(F.count("*").alias("articles"), F.countDistinct("outlet").alias("outlets"), F.max("minute").alias("newest"))
    out = counts.join(picks, "story_id")
    for detail in details:
        out = out.join(detail, "story_id", "left")
    return out


def slug(title, most: int = 60):
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def recluster_changes(old: DataFrame, new: DataFrame, key: str = "item", story: str = "story") -> DataFrame:
    """(kind, stories): stored stories that split over several new ones, new ones that merge several, and items that are new or gone."""
    both = old.select(key, F.col(story).alias("was")).join(new.select(key, F.col(story).alias("now")), key, "full_outer")
    links = both.where("was IS NOT NULL AND now IS NOT NULL").select("was", "now").distinct()
    split = links.groupBy("was").count().where("count > 1").agg(F.count("*").alias("stories")).select(F.lit("split").alias("kind"), "stories")
    merged = links.groupBy("now").count().where("count > 1").agg(F.count("*").alias("stories")).select(F.lit("merged").alias("kind"), "stories")
    rest = both.agg(F.count_if(F.col("was").isNull()).alias("a"), F.count_if(F.col("now").isNull()).alias("b"))
    rest = rest.select(F.explode(F.array(F.struct(F.lit("added").alias("kind"), F.col("a").alias("stories")), F.struct(F.lit("gone").alias("kind"), F.col("b").alias("stories")))).alias("x")).select("x.*")
    return split.unionByName(merged).unionByName(rest)


def low_confidence(scores: DataFrame, margin: float, threshold: float = JOIN_SCORE) -> DataFrame:
    """Memberships whose score lies within the margin of the threshold."""
    return scores.where(F.abs(F.col("score") - threshold) <= margin)


def story_record(members: DataFrame, options: DataFrame, product: str) -> DataFrame:
    """A story's stored row: outlets in first-seen order, distinct outlets by framing, breadth, key facts, timeline, evidence and the reading options.

    members: story_id, outlet, article_id, rank_in_story, framing_group, is_substantive, minute; options: as lead_and_open_alternate gives them."""
    by = lambda group: F.bool_or(F.col("framing_group") == group).alias(group)
    seen = members.groupBy("story_id", "outlet").agg(F.min("rank_in_story").alias("f"), by("left"), by("center"), by("right"), F.bool_or("is_substantive").alias("substantive"), F.count("*").alias("n"), F.max(F.struct("minute", "article_id")).alias("last"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("f", "outlet"))), lambda x: x["outlet"].cast("string"))
    n = F.count("*")
    stories = seen.groupBy("story_id").agg(
        listed.alias("_outlets"), n.alias("n_outlets"), F.sum("n").alias("n_articles"), *(F.count_if(g).alias(f"{g}_outlets") for g in ("left", "center", "right")), F.count_if("substantive").alias("substantive"),
        F.max_by("outlet", F.struct("last.minute", "last.article_id")).cast("string").alias("latest_outlet"), F.max("last.minute").alias("latest_minute"),
    )
    c, text = F.col, lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    several, outlets = c("n_outlets") >= 2, F.array_join("_outlets", ", ")
    row = stories.join(options, "story_id", "left")
    facts = F.array(
        F.when(several, text(f"{product} links ", c("n_articles"), " reports of ", c("n_outlets"), " outlets.")).otherwise(f"{product} links one outlet so far."), text("The latest came from ", c("latest_outlet"), "."),
        F.when(several, text("Framings can be compared across ", outlets, ".")).otherwise("There is nothing to compare with yet."),
        F.when(c("alternate").isNotNull(), "An open alternative is at hand.").when(F.coalesce("confident", F.lit(False)), "The lead reads well by itself.").otherwise("No report stands out yet."),
    )
    timeline = F.array(F.struct(c("latest_minute").alias("minute"), F.lit("summary").alias("kind"), text("Put together from ", c("n_outlets"), " outlets").alias("label")), F.struct(c("latest_minute").alias("minute"), F.lit("coverage").alias("kind"), text(c("latest_outlet"), " added the latest turn").alias("label")))
    evidence = F.array(F.struct(F.lit("report").alias("type"), outlets.alias("source")), F.struct(F.lit("dataset").alias("type"), c("latest_minute").cast("string").alias("source")), F.struct(F.lit("report").alias("type"), text(c("n_articles"), " articles of ", c("n_outlets"), " outlets").alias("source")))
    return row.select(
        "story_id", F.array_join("_outlets", ",").alias("outlets"), "left_outlets", "center_outlets", "right_outlets", F.when((c("substantive") >= 2) | (c("n_outlets") >= 3), "mixed").otherwise("early").alias("breadth"),
        facts.alias("key_facts"), timeline.alias("timeline"), evidence.alias("evidence"), "lead", "confident", "alternate",
    )


def story_summary(members: DataFrame, titles: DataFrame, product: str, aligned: float = 0.28) -> DataFrame:
    """(story_id, article_id, summary, score, n_sources, role): the summary of a story, and the role that gave it.

    A member's candidate is its first two body sentences if they are narrative and fit headline and summary (.18), else its summary, as a clean snippet. It is rated by D4 and selected by
    D4 + 1.5 x signal + 5 x alignment with the title - 4 x context - 8 for a stub. The first that holds: the best aligned one that is good and not far behind the best; the one of
    the title's own article; an open best; the best, or an open one near it if it is paywalled; a fair open one; a sentence of our own.

    members: story_id, article_id, outlet, headline, summary, body_text, sentences, extraction_quality, access_signal, signal, context; titles: story_id, title."""
    c = F.col
    two = F.array_join(F.slice("sentences", 1, 2), " ").alias("_excerpt")
    m = members.select(*(x for x in members.columns if x != "sentences"), two).join(titles, "story_id")  # the other sentences do not move
    excerpt = c("_excerpt")
    fits = token_overlap(overlap_tokens(F.concat_ws(" ", "headline", "summary")), overlap_tokens(excerpt), "alignment", few=0.0) >= 0.18
    use_body = (c("extraction_quality") == "article_body") & (excerpt != "") & ~is_non_narrative(excerpt) & fits
    m = settled(m.withColumn("_text", F.when(use_body, excerpt).otherwise(c("summary"))))
    m = settled(m.withColumn("_text", clean_snippet(c("_text"), 320)))
    rated = m.withColumns({
        "_score": summary_quality(c("headline"), c("_text"), c("extraction_quality"), c("body_text")), "_stub": is_title_only_stub(c("headline"), c("_text"), c("extraction_quality"), c("body_text")),
        "_al": F.round(token_overlap(overlap_tokens(c("title")), overlap_tokens(c("_text")), "alignment", few=0.0), 6),
    })
    rated = rated.select("story_id", "article_id", "outlet", "access_signal", "_text", "_score", "_al", (F.lower(squeeze(c("headline"))) == F.lower(squeeze(c("title")))).alias("_own"),
        F.round(c("_score") + 1.5 * F.greatest("signal", F.lit(0)) + 5 * c("_al") - 4 * c("context") - F.when(c("_stub"), 8).otherwise(0), 6).alias("_sel"))
    rated = settled(rated)
    pick, some = F.struct("article_id", c("_text").alias("text"), c("_score").alias("score"), c("_al").alias("al"), c("access_signal").alias("access")), c("_text") != ""
    role = lambda test, *order: F.max_by(F.when(test, pick), F.when(test, F.struct(*order, -F.col("article_id"))))
    best = rated.groupBy("story_id").agg(
        role(some, "_sel").alias("best"), role(some & (c("_al") >= aligned), "_al", "_sel").alias("fit"), role(some & (c("access_signal") == "open"), "_sel").alias("open"), role(some & c("_own"), "_sel").alias("own"),
        F.countDistinct(F.when(c("_score") >= 6, c("outlet"))).alias("n_sources"), F.array_join(F.slice(F.array_sort(F.collect_set(c("outlet").cast("string"))), 1, 3), ", ").alias("_names"),
    )
    none = c("best").isNull()
    use_fit = (c("fit.score") >= 6) & (none | (c("best.al") < c("fit.al") - 0.12) | (c("fit.score") >= c("best.score") - 3))
    use_own = (c("own.score") >= 6) & (c("own.al") >= aligned) & (none | (c("best.al") < c("own.al")) | (c("own.score") >= c("best.score") - 2))
    near_open = (c("best.access") == "likely_paywalled") & (c("open.score") >= F.greatest(F.lit(6), c("best.score") - 3))
    name = F.when(use_fit, "fit").when(use_own, "own").when(c("best.score") >= 6, F.when(near_open, "open").otherwise("best")).when(c("open.score") >= 4, "open").otherwise("none")
    out = best.withColumn("role", name).join(titles, "story_id")
    chosen = F.when(c("role") == "fit", c("fit")).when(c("role") == "own", c("own")).when(c("role") == "open", c("open")).when(c("role") == "best", c("best"))
    own_words = F.concat(F.regexp_replace(squeeze(c("title")), "[?!.]+$", ""), F.lit(": first coverage from "), "_names", F.lit(f"; {product} waits for fuller reports."))
    return out.withColumn("_use", chosen).select("story_id", "_use.article_id", F.coalesce("_use.text", own_words).alias("summary"), F.coalesce("_use.score", F.greatest(c("best.score"), F.lit(0)), F.lit(0)).alias("score"), "n_sources", "role")


def story_unions(members: DataFrame) -> DataFrame:
    """(story_id, tokens, tags, entities, contextual): what a story holds; contextual if all of it is."""
    union = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return members.groupBy("story_id").agg(union("tokens"), union("tags"), union("entities"), F.bool_and("contextual").alias("contextual"))


def augment_stories(needy: DataFrame, items: DataFrame, lexicons: dict[str, list[str]], stories: int = 4, per_story: int = 2, overall: int = 8, vectors: DataFrame | None = None) -> DataFrame:
    """(story_id, article_id, outlet, score): articles of other stories and outlets for the neediest stories.

    A candidate shares an entity or two tokens with the story's query; a contextual item or stub needs two of either where the story has event items. Its score is F1 against the story + 3 a query
    token + 2 a query entity + 2 if it may join (F2) - 4 x context - 8 for a stub + D4 + 3 if open + 4 with a body + 5 if event-driven. One an outlet, ``per_story`` a story, each article once, for the
    neediest story it is good for, ``overall`` in all; those caps are what the operator is for.

    vectors: article_id, vector; a candidate is as similar to a story as to its most similar member, 0 without vectors.
    needy: story_id, needed, priority; items: story_id, article_id, outlet, tokens, tags, entities, context, stub, signal, quality, is_substantive, is_open, has_body."""
    c = F.col
    items = durable(items.withColumn("contextual", c("context") >= 2), "items")
    chosen = durable(top_rows(needy.where("needed"), [F.desc("priority"), F.asc("story_id")], stories).withColumn("_need", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("priority"), F.asc("story_id")))), "needy")  # a handful of rows
    own = items.join(chosen, "story_id", "left_semi")
    queries = durable(story_query(own, "tokens", "entities", lexicons.get("broad", []), lexicons.get("low_signal", [])), "queries")
    keys = lambda kind: F.transform(F.coalesce(kind, F.expr("CAST(array() AS array<string>)")), lambda x: F.concat(F.lit(f"{kind}:"), x))
    asked = queries.select("story_id", F.explode(F.concat(keys("tokens"), keys("entities"))).alias("key"))
    offered = items.select(F.col("story_id").alias("_own"), "article_id", "outlet", F.explode(F.concat(keys("tokens"), keys("entities"))).alias("key"))
    hits = offered.join(asked, "key").where("_own <> story_id").groupBy("story_id", "article_id", "outlet").agg(F.count_if(F.startswith("key", F.lit("tokens:"))).alias("q_tokens"), F.count_if(F.startswith("key", F.lit("entities:"))).alias("q_entities"))
    hits = hits.where("q_entities > 0 OR q_tokens >= 2").join(own.select("story_id", "outlet").distinct(), ["story_id", "outlet"], "left_anti")
    prefers = own.groupBy("story_id").agg(F.bool_or((c("signal") >= 3) & ~c("stub")).alias("_event"))
    side = lambda frame, name, key: frame.select(F.col(key).alias(name), *(F.col(x).alias(f"{name}_{x}") for x in ("tokens", "tags", "entities", "contextual")))
    pairs = hits.withColumnsRenamed({"article_id": "a", "story_id": "b"}).join(side(items, "a", "article_id"), "a").join(side(story_unions(own), "b", "story_id"), "b")
    if vectors is None:
        pairs = pairs.withColumn("similarity", F.lit(0.0))
    else:
        mates = hits.select(c("article_id").alias("a"), "story_id").join(own.select("story_id", c("article_id").alias("b")), "story_id")
        like = cosine_pairs(mates.select("a", "b").distinct(), vectors, "article_id", "vector")
        like = mates.join(like, ["a", "b"]).groupBy("a", c("story_id").alias("b")).agg(F.greatest(F.max("similarity"), F.lit(0.0)).alias("similarity"))
        pairs = pairs.join(like, ["a", "b"])
    scored = should_join(match_score(pair_features(pairs, **lexicons))).select(c("b").alias("story_id"), c("a").alias("article_id"), "outlet", "q_tokens", "q_entities", c("score").alias("_f1"), "joins")
    scored = scored.join(items.select("article_id", "context", "stub", "signal", "quality", "is_open", "has_body"), "article_id").join(prefers, "story_id")
    scored = scored.where(~(c("_event") & ((c("context") >= 2) | c("stub")) & (c("q_tokens") < 2) & (c("q_entities") < 2)))
    when = lambda test, points: F.when(test, points).otherwise(0)
    score = c("_f1") + 3 * c("q_tokens") + 2 * c("q_entities") + when(c("joins"), 2) - 4 * c("context") - when(c("stub"), 8) + c("quality") + when(c("is_open"), 3) + when(c("has_body"), 4) + when((c("signal") >= 3) & ~c("stub"), 5)
    rows = scored.withColumn("score", F.round(score, 6)).join(chosen.select("story_id", "_need"), "story_id")
    once = rows.withColumn("_o", F.row_number().over(Window.partitionBy("article_id").orderBy("_need"))).where("_o = 1")
    order = [F.desc("score"), F.asc("article_id")]
    picked = top_per(top_per(once, ["story_id", "outlet"], order, 1).drop("_k"), ["story_id"], order, per_story)
    return top_rows(picked, [F.asc("_need"), F.asc("_k")], overall).select("story_id", "article_id", "outlet", "score")


def pick_supports(sections: list, supports: int = 5, spread: int = 3) -> list[int]:
    """Positions of the supports of a page whose stories, the featured one first, are of these sections: one a section for the first ``spread``, then two, then any."""
    taken, used = [], {sections[0]: 1} if sections else {}
    for k, section in enumerate(sections[1:], 1):
        if len(taken) < supports and used.get(section, 0) < (1 if len(taken) < spread else 2):
            taken.append(k)
            used[section] = used.get(section, 0) + 1
    rest = [k for k in range(1, len(sections)) if k not in taken]
    return [*taken, *rest[: supports - len(taken)]]


def home_layout(ranked: DataFrame, supports: int = 5, latest: int = 8, per_section: int = 4, enough: int = 10, filled: int = 12, good: int = 24) -> DataFrame:
    """(edition, slot, place, story_id): per edition a featured story, supports that spread over sections, the latest, and each section's best.

    The page is laid out from the stories that are eligible, live, or of quality ``good`` with an outlet; where fewer than ``enough`` are, the next ones fill up to ``filled``. The support pick is sequential, over the
    best of each section, as many as a page shows; no other story of it can be picked. All else is ranking. ranked: edition, section, story_id, score, minute, eligible, origin, quality, outlets."""
    order = [F.desc("score"), F.desc("minute"), F.asc("story_id")]
    fit = F.coalesce(F.col("eligible") | (F.col("origin") == "live") | ((F.col("quality") >= good) & (F.col("outlets") >= 1)), F.lit(False))
    rows = ranked.select("edition", "section", "story_id", "score", "minute", fit.alias("fit")).withColumn("_good", F.count_if("fit").over(Window.partitionBy("edition")))
    rows = rows.withColumn("_other", F.row_number().over(Window.partitionBy("edition", "fit").orderBy(*order)))
    rows = durable(rows.withColumn("pool", F.col("fit") | ((F.col("_good") < enough) & (F.col("_other") <= filled - F.col("_good")))).drop("_good", "_other"), "pool")
    first = [F.desc("pool"), F.desc("fit"), *order]
    pool = top_per(rows.where("pool"), ["edition", "section"], first, supports + 1)
    pool = pool.withColumn("rank", F.row_number().over(Window.partitionBy("edition").orderBy(*first))).select("edition", "section", "story_id", "rank")

    def pick(pdf):
        import pandas as pd

        page = pdf.sort_values("rank")
        out = [("featured", 1, page.story_id.iloc[0]), *(("support", i + 1, page.story_id.iloc[k]) for i, k in enumerate(pick_supports(page.section.tolist(), supports)))]
        return pd.DataFrame([(page.edition.iloc[0], *x) for x in out], columns=["edition", "slot", "place", "story_id"])

    pinned = durable(pool.groupBy("edition").applyInPandas(pick, "edition long, slot string, place int, story_id long"), "pinned")
    rest = rows.join(pinned.select("edition", "story_id"), ["edition", "story_id"], "left_anti")
    newest = top_per(rest, ["edition"], [F.desc("minute"), F.asc("story_id")], latest, "place").select("edition", F.lit("latest").alias("slot"), "place", "story_id")
    sections = top_per(rest, ["edition", "section"], first, per_section, "place").select("edition", F.concat(F.lit("section:"), "section").alias("slot"), "place", "story_id")
    return pinned.unionByName(newest).unionByName(sections)
