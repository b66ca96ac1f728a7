"""How a story is covered: presence counts, lenses and context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import settled
from newsloom.operators.stories import top_per

LENSES = ["balanced", "evidence", "local", "international"]


def presence_counts(members: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(story_id, kind, label, n): articles per label; kinds maps a kind to its column."""
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in kinds.items())))
    return members.select("story_id", stacked.alias("x")).groupBy("story_id", "x.kind", "x.label").agg(F.count("*").alias("n"))


def _distinct(value: Column) -> Column:
    """Distinct values of an aggregate, gathered as a set: labels and outlets of a story are few, and a row is not multiplied by the columns that are counted."""
    return F.size(F.collect_set(value)).cast("long")


def perspective_status(members: DataFrame) -> DataFrame:
    """(story_id, status, outlets, framings, families, review): ready with two substantive articles of two outlets."""
    c = members.groupBy("story_id").agg(
        F.count_if("is_substantive").alias("_sub"), _distinct(F.when(F.col("is_substantive"), F.col("outlet"))).alias("_sub_outlets"),
        _distinct(F.col("outlet")).alias("outlets"), _distinct(F.col("framing_group")).alias("framings"), _distinct(F.col("family")).alias("families"),
    )
    ready = (F.col("_sub") >= 2) & (F.col("_sub_outlets") >= 2)
    review = F.filter(F.array(F.when(F.col("framings") == 1, "one_framing"), F.when(F.col("families") == 1, "one_family"), F.when(F.col("outlets") == 1, "one_outlet")), lambda x: x.isNotNull())
    return c.select("story_id", F.when(ready, "ready").otherwise("early").alias("status"), "outlets", "framings", "families", F.array_join(review, ",").alias("review"))


def _lens_state() -> dict[str, tuple[Column, Column]]:
    """Of each lens its candidates and why it can't be offered, from the counts _s (substantive), _local and _far of these, and _outlets, _framings, _families, of which only 0, 1 and more matter."""
    c = F.col
    narrow = (c("_s") < 2) | (c("_outlets") < 2)
    state = {
        "balanced": ("_s", F.when(narrow, "few_outlets").when((c("_framings") < 2) & (c("_families") < 2), "one_lane")),
        "evidence": ("_s", F.when(c("_s") == 0, "nothing_read").when(c("_s") == 1, "thin")),
        "local": ("_local", F.when(narrow, "few_outlets").when(c("_local") == 0, "no_local")),
        "international": ("_far", F.when(narrow, "few_outlets").when(c("_far") == 0, "no_international").when(c("_far") == c("_s"), "no_counterpart")),
    }
    return {lens: (c(n), F.coalesce(why, F.lit("ready"))) for lens, (n, why) in state.items()}


def _offer(reason: Column) -> Column:
    return F.when(reason == "ready", "ready").when(reason == "thin", "limited").otherwise("unavailable")


def lens_status(members: DataFrame) -> DataFrame:
    """(story_id, lens, n, status, reason): how many candidates each of the four lenses has, and whether it can be offered.

    Only substantive articles are candidates. Balanced, local and international need two of them from two outlets; balanced then two framings or two families among all articles, local a local
    one, international an international one and another to hold it against. Evidence is limited with one. reason: few_outlets, one_lane, nothing_read, thin, no_local, no_international, no_counterpart, or ready."""
    c, sub = F.col, F.col("is_substantive")
    counts = members.groupBy("story_id").agg(
        F.count_if(sub).alias("_s"), _distinct(F.when(sub, c("outlet"))).alias("_outlets"), _distinct(c("framing_group")).alias("_framings"), _distinct(c("family")).alias("_families"),
        F.count_if(sub & (c("scope") == "local")).alias("_local"), F.count_if(sub & (c("scope") == "international")).alias("_far"),
    )
    rows = counts.select("story_id", F.explode(F.array(*(F.struct(F.lit(x).alias("lens"), n.alias("n"), why.alias("reason")) for x, (n, why) in _lens_state().items()))).alias("x")).select("story_id", "x.*")
    status = _offer(c("reason"))
    return rows.select("story_id", "lens", F.when(status == "unavailable", 0).otherwise(c("n")).alias("n"), status.alias("status"), "reason")


#: How many reads a lens offers.
LENS_SIZES = {"balanced": 3, "evidence": 3, "local": 2, "international": 2}


def lens_items(members: DataFrame, sizes: dict[str, int] = LENS_SIZES, codes: dict[str, str] | None = None) -> DataFrame:
    """(story_id, lens, article_id, rank, score, codes): the best candidates of each lens that ``lens_status`` offers.

    The balanced lens passes over repeats of its first framing until another one has come; so it is its best read, the best of another framing, and the next after that one.

    members: story_id, article_id, rank_in_story, is_substantive, access (open, likely_paywalled, unknown), extraction_quality, body_length, framing_group, family (wire, public_media, national ...), scope, local_words."""
    w = lambda *c: Window.partitionBy("story_id", *c)
    c, when = F.col, lambda test, yes, no=0.0: F.when(test, yes).otherwise(no)
    # The points of a read.
    base = (
        when(c("is_substantive"), 14) + F.when(c("access") == "open", 4).when(c("access") == "likely_paywalled", -2).otherwise(0) + F.when(c("extraction_quality") == "article_body", 8).when(c("extraction_quality") == "metadata_description", 3).otherwise(0)
        + F.least("body_length", F.lit(800)) / 200
    )
    terms = {
        "balanced": 10 / c("_nf") + 8 / c("_ns"), "evidence": when(c("is_substantive"), 10.0) + when(c("family").isin("wire", "public_media"), 6.0),
        "local": when(c("scope") == "local", 14.0, -4.0) + when(c("local_words"), 8.0), "international": when(c("scope") == "international", 14.0, -4.0) + when(c("family").isin("wire", "national"), 2.0),
    }
    # Members move once, by story: every window is over a story or a part of it, and whether a lens is offered is told by windows, too.
    m = members.where("story_id IS NOT NULL").withColumn("_base", base).select("story_id", "article_id", "rank_in_story", "is_substantive", "outlet", "framing_group", "family", "scope", "local_words", "_base").repartition("story_id")
    two = lambda x: F.when(F.min(x).over(w()) != F.max(x).over(w()), 2).when(F.min(x).over(w()).isNotNull(), 1).otherwise(0)
    sub, held = c("is_substantive"), lambda test: F.count_if(test).over(w())
    m = m.withColumns({
        "_s": held(sub), "_local": held(sub & (c("scope") == "local")), "_far": held(sub & (c("scope") == "international")), "_outlets": two(F.when(sub, c("outlet"))), "_framings": two(c("framing_group")), "_families": two(c("family")),
        "_nf": F.count("*").over(w("framing_group")), "_ns": F.count("*").over(w("family")),
    }).where(sub)
    fits = lambda x: (_offer(_lens_state()[x][1]) != "unavailable") & ((c("scope") == x) if x in ("local", "international") else F.lit(True))
    reads = F.array(*(F.when(fits(x), F.struct(F.lit(x).alias("lens"), F.round(c("_base") + t, 6).alias("score"))) for x, t in terms.items()))
    rows = m.select("story_id", "article_id", "rank_in_story", "framing_group", F.explode(reads).alias("x")).where("x IS NOT NULL").select("story_id", "article_id", "rank_in_story", "framing_group", "x.*")
    order = [F.desc("score"), F.asc("rank_in_story"), F.asc("article_id")]
    rows = rows.withColumn("_r", F.row_number().over(w("lens").orderBy(*order))).withColumn("_f", F.first("framing_group").over(w("lens").orderBy(*order)))
    rows = rows.withColumn("_second", F.min(F.when(c("framing_group") != c("_f"), c("_r"))).over(w("lens")))
    passed = (c("lens") == "balanced") & c("_second").isNotNull() & (c("_r") > 1) & (c("_r") < c("_second"))
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))[c("lens")]
    kept = rows.where(~passed).withColumn("rank", F.row_number().over(w("lens").orderBy(*order))).where(c("rank") <= size)
    reasons = F.create_map(*(F.lit(x) for kv in (codes or LENS_CODES).items() for x in kv))[c("lens")]
    return kept.select("story_id", "lens", "article_id", "rank", "score", reasons.alias("codes"))


#: Why a read is in a lens.
LENS_CODES = {"balanced": "framing,family", "evidence": "detail,density", "local": "consequences,operations", "international": "outside_view"}


def context_packs_basic(members: DataFrame) -> DataFrame:
    """(story_id, lens, article_id, rank): one of each framing first for balanced, longest for evidence, scope matches for the others."""
    c = F.col
    first = F.row_number().over(Window.partitionBy("story_id", "framing_group").orderBy("rank_in_story", "article_id"))
    m = members.withColumn("_first", F.least(first, F.lit(2)))
    packs = {
        "balanced": (m, [F.asc("_first"), F.asc("rank_in_story"), F.asc("article_id")], 3), "evidence": (m, [F.desc("body_length"), F.asc("article_id")], 3),
        "local": (m.where(c("scope") == "local"), [F.asc("rank_in_story"), F.asc("article_id")], 2), "international": (m.where(c("scope") == "international"), [F.asc("rank_in_story"), F.asc("article_id")], 2),
    }
    out = None
    for lens, (rows, order, k) in packs.items():
        found = top_per(rows, ["story_id"], order, k, "rank").select("story_id", F.lit(lens).alias("lens"), "article_id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def context_only_articles(packs: DataFrame, members: DataFrame) -> DataFrame:
    """(story_id, article_id, lenses): pack entries that are no members of their story, to be kept as articles for context only."""
    return packs.join(members.select("story_id", "article_id"), ["story_id", "article_id"], "left_anti").groupBy("story_id", "article_id").agg(F.array_join(F.array_sort(F.collect_set("lens")), ",").alias("lenses"))


def perspective_readiness(stories: DataFrame, current: DataFrame, packs: DataFrame) -> DataFrame:
    """One row a story: whether a revision stands, items per lens (zero where nothing is stored), the lenses that have any, whether all have, and whether the revision asks for a review.

    current: story_id, review (reasons)."""
    lenses = packs.groupBy("story_id").agg(*(F.count_if(F.col("lens") == x).alias(x) for x in LENSES))
    stored = current.select("story_id", F.lit(True).alias("has_current"), (F.size("review") > 0).alias("review_required"))
    rows = stories.select("story_id").join(stored, "story_id", "left").join(lenses, "story_id", "left").fillna(0, LENSES).fillna(False, ["has_current", "review_required"])
    available = F.filter(F.array(*(F.when(F.col(x) > 0, x) for x in LENSES)), lambda x: x.isNotNull())
    return rows.withColumn("available", available).withColumn("all_lenses", F.size("available") == len(LENSES))


def readiness_totals(rows: DataFrame) -> DataFrame:
    """One row of totals over perspective_readiness: stories, those with a revision, with a review to do, with all lenses, with evidence alone."""
    return rows.agg(
        F.count("*").alias("stories"), F.count_if("has_current").alias("with_current"), F.count_if("review_required").alias("with_review"), F.count_if("all_lenses").alias("with_all_lenses"),
        F.count_if(F.array_join("available", ",") == "evidence").alias("evidence_only"),
    )


def build_perspective(members: DataFrame, product: str) -> DataFrame:
    """The stored perspective of each story: status, summary, takeaways, three presence lists, snapshot, lens counts and statuses, review reasons and the signature of all that.

    members: as for lens_items, with outlet."""
    kinds = {"framing": "framing_group", "family": "family", "scope": "scope"}
    c, sub = F.col, F.col("is_substantive")
    told = F.struct("rank_in_story", "article_id", c("outlet").cast("string").alias("outlet"), "extraction_quality", *kinds.values(), "is_substantive")
    # The snapshot lists all members of a story, so what else is told of a story is read from that list.
    gathered = members.where("story_id IS NOT NULL").groupBy("story_id").agg(F.array_sort(F.collect_list(told)).alias("_told"), F.count("*").alias("articles"), F.count_if(sub).alias("substantive"), F.count_if(sub & (c("scope") == "local")).alias("_local"), F.count_if(sub & (c("scope") == "international")).alias("_far"))
    held = lens_items(members).groupBy("story_id").agg(*(F.count_if(c("lens") == x).alias(f"_n_{x}") for x in LENSES)).hint("shuffle_hash")
    gathered = gathered.join(held, "story_id", "left").fillna(0, [f"_n_{x}" for x in LENSES])  # both lie by story
    values = lambda name, only=lambda x: F.lit(True): F.array_distinct(F.transform(F.filter("_told", only), lambda x: x[name]))
    several = lambda values: F.size(F.filter(values, lambda x: x.isNotNull())).cast("long")
    listed = lambda kind: F.transform(F.array_sort(F.transform(values(kind), lambda v: F.struct((-F.size(F.filter("_told", lambda x: x[kind].eqNullSafe(v)))).alias("m"), v.alias("label")))), lambda x: F.struct(x["label"].alias("label"), (-x["m"]).cast("long").alias("n")))
    snapshot = F.transform("_told", lambda x: F.struct(x["article_id"].alias("article_id"), x["outlet"].alias("outlet"), x["extraction_quality"].alias("extraction_quality")))
    rows = settled(gathered.select(
        "story_id", "articles", "substantive", c("substantive").alias("_s"), "_local", "_far", *(f"_n_{x}" for x in LENSES), snapshot.alias("snapshot"), *(listed(kind).alias(name) for name, kind in kinds.items()),
        several(values("outlet")).alias("outlets"), several(values("outlet", lambda x: x["is_substantive"])).alias("substantive_outlets"),
    ))
    several_labels = lambda name: several(F.transform(name, lambda x: x["label"]))
    rows = rows.withColumns({"framings": several_labels("framing"), "families": several_labels("family"), "_outlets": c("substantive_outlets")})
    rows = rows.withColumns({"_framings": c("framings"), "_families": c("families"), "status": F.when((c("substantive") >= 2) & (c("substantive_outlets") >= 2), "ready").otherwise("early")})
    offered = {x: F.when(c(f"_n_{x}") == 0, "unavailable").otherwise(_offer(why)) for x, (_, why) in _lens_state().items()}
    rows = settled(rows.select(*(x for x in rows.columns if not x.startswith("_")), *(f"_n_{x}" for x in LENSES), *(state.alias(f"_{x}") for x, state in offered.items())))
    rows = rows.withColumn("lenses", F.array_sort(F.array(*(F.struct(F.lit(x).alias("lens"), c(f"_{x}").alias("status"), c(f"_n_{x}").alias("count")) for x in LENSES))))
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    names = lambda kind, k: F.array_join(F.slice(F.transform(kind, lambda x: x["label"]), 1, k), " and ")
    early = c("status") == "early"
    summary = F.when(early, text(f"{product} has few sources to compare yet, mostly ", names("family", 2), "; what shows is ", names("framing", 1), ".")).otherwise(text(f"{product} compares ", c("outlets"), " outlets here: ", names("framing", 1), " leads, ", names("family", 2), " carry most of it."))
    takeaways = F.when(early, F.array(text("Mostly read through ", names("family", 2), "."), text("Only ", names("framing", 1), " shows clearly."), F.lit("Another full report of a different kind would widen it."))).otherwise(
        F.array(text(c("substantive"), " full reports stand behind the same event."), text("Framings seen: ", names("framing", 2), "."), text("Seen as ", names("scope", 2), "."))
    )
    full = (c("substantive") >= 2) & (c("substantive_outlets") >= 2)
    holds = lambda kind, label: F.exists(kind, lambda x: x["label"] == label)
    review = F.filter(F.array(
        F.when(full & (c("_balanced") != "ready"), "balanced_not_ready"), F.when(full & (c("_evidence") != "ready"), "evidence_not_ready"),
        F.when(full & holds("scope", "local") & (c("_local") == "unavailable"), "local_missing"), F.when(full & holds("scope", "international") & (c("_international") == "unavailable"), "international_missing"),
    ), lambda x: x.isNotNull())
    stored = ["status", "summary", "takeaways", "framing", "family", "scope", "lenses", "review", "snapshot"]
    out = rows.select("story_id", "status", summary.alias("summary"), takeaways.alias("takeaways"), *kinds, "lenses", review.alias("review"), "snapshot", "articles", "substantive", "substantive_outlets", "outlets", "framings", "families")
    return out.withColumn("signature", F.sha2(F.to_json(F.struct(*sorted(stored))).cast("binary"), 256))
