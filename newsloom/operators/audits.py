"""Audits of briefs, sources and feeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import overlap_tokens, settled
from newsloom.operators.running import last_before, sum_before
from newsloom.sources.scratch import Tables, durable

#: States of a section.
GROUNDING = ["grounded", "weak", "ungrounded", "missing", "scaffold"]
MINIMUMS = {"paragraph": 0.16, "why": 0.11, "agree": 0.14, "differ": 0.13, "watch": 0.10}


def section_grounding(sections: DataFrame, support: DataFrame, stopwords: list[str], minimums: dict[str, float] = MINIMUMS) -> DataFrame:
    """(brief_id, section, kind, n_tokens, overlap, status): share of a section's tokens found in the support text.

    sections: brief_id, section, kind, text, mode, outlet; support: brief_id, text. Grounded at the kind's minimum, or at .65 of it if the
    outlet is named in the text; weak at .55 of it; empty text is missing, mode scaffold is scaffold."""
    tokens = support.groupBy("brief_id").agg(F.array_distinct(F.flatten(F.collect_list(overlap_tokens(F.col("text"), stopwords)))).alias("_support"))
    s = sections.withColumn("_tokens", overlap_tokens(F.col("text"), stopwords)).join(tokens, "brief_id", "left")
    n = F.size("_tokens")
    overlap = F.when((n > 0) & F.col("_support").isNotNull(), F.size(F.array_intersect("_tokens", "_support")) / n).otherwise(0.0)
    least = F.coalesce(F.create_map(*(F.lit(x) for kv in minimums.items() for x in kv))[F.col("kind")], F.lit(min(minimums.values())))
    named = F.coalesce(F.contains(F.col("text"), F.col("outlet")), F.lit(False))
    status = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing").when(F.col("mode") == "scaffold", "scaffold").when(F.col("_o") >= least, "grounded")
        .when((F.col("_o") >= 0.65 * least) & named, "grounded").when(F.col("_o") >= 0.55 * least, "weak").otherwise("ungrounded")
    )
    return s.withColumn("_o", F.round(overlap, 6)).select("brief_id", "section", "kind", n.alias("n_tokens"), F.col("_o").alias("overlap"), status.alias("status"))


def grounding_report(sections: DataFrame) -> DataFrame:
    """(brief_id, sections, grounded, ratio, weak): per brief, scaffold and missing sections left out of the ratio."""
    counted = F.col("status").isin("grounded", "weak", "ungrounded")
    return sections.groupBy("brief_id").agg(
        F.count("*").alias("sections"), F.count_if(F.col("status") == "grounded").alias("grounded"),
        F.round(F.try_divide(F.count_if(F.col("status") == "grounded"), F.count_if(counted)), 6).alias("ratio"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status").isin("weak", "ungrounded"), F.col("section").cast("string")))), ",").alias("weak"),
    )


def support_concentration(refs: DataFrame) -> DataFrame:
    """(brief_id, refs, articles, bodies, outlets, dominant_outlet, dominant_share); bodies are the articles read whole.

    refs: brief_id, article_id, outlet, has_body; ties go to the smaller outlet."""
    by = refs.groupBy("brief_id", "outlet").agg(F.count("*").alias("n"))
    top = by.groupBy("brief_id").agg(F.sum("n").alias("refs"), F.count("*").alias("outlets"), F.max_by("outlet", F.struct("n", -F.col("outlet"))).alias("dominant_outlet"), F.max("n").alias("_m"))
    articles = refs.groupBy("brief_id").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct(F.when(F.col("has_body"), F.col("article_id"))).alias("bodies"))
    return top.join(articles, "brief_id").select("brief_id", "refs", "articles", "bodies", "outlets", "dominant_outlet", F.round(F.col("_m") / F.col("refs"), 6).alias("dominant_share"))


def duplicate_paragraphs(paragraphs: DataFrame, least: float = 0.82) -> DataFrame:
    """(brief_id, i, j, overlap): pairs of paragraphs of a brief that share most tokens of the shorter."""
    p = paragraphs.select("brief_id", "position", overlap_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    pairs = p.toDF("brief_id", "i", "a").join(p.toDF("brief_id", "j", "b"), "brief_id").where("i < j")
    overlap = F.round(F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b")), 6)
    return pairs.select("brief_id", "i", "j", overlap.alias("overlap")).where(F.col("overlap") >= least)


def quotes_balanced(text):
    return (F.regexp_count(text, F.lit("“")) == F.regexp_count(text, F.lit("”"))) & (F.regexp_count(text, F.lit('"')) % 2 == 0)


def brief_rules() -> list[tuple[str, str, Column]]:
    """The rules (code, severity, condition) on a story and its stored brief. Where a graver rule of a kind holds, the milder one does not.

    Columns: has_brief, status, ready_now, stored_ready, alternate_expected, alternate_stored, agree_mode; of the sources now: comparison, stub_shells, contextual; of the snapshot: snapshot_stubs; of the sections:
    ratio, unsupported, weak; of the support: refs, outlets, articles, bodies, dominant_share; of the texts: duplicates, unbalanced, one_source, early_split, follow_on."""
    c = F.col
    stored, full = F.coalesce(c("has_brief"), F.lit(False)), c("status") == "full"
    agrees = F.coalesce(c("agree_mode"), F.lit("")) != "scaffold"
    groups: list[list[tuple[str, str, Column]]] = [
        [("full_without_breadth", "critical", full & ~c("ready_now")), ("ready_but_early", "warning", ~full & c("ready_now"))],
        [("readiness_stale", "warning", c("stored_ready") != c("ready_now"))],
        [("open_alternate_missing", "warning", c("alternate_expected") & ~c("alternate_stored"))],
        [("stub_drives_brief", "critical", agrees & (c("comparison") == 0) & ((c("stub_shells") > 0) | (c("snapshot_stubs") > 0))), ("context_drives_brief", "warning", agrees & (c("comparison") == 0) & (c("contextual") > 0))],
        [("no_section_support", "critical", c("refs") == 0), ("grounding_failures", "critical", (c("ratio") < 0.5) | (c("unsupported") >= 2)), ("grounding_warnings", "warning", (c("unsupported") > 0) | (c("weak") >= 2))],
        [("full_on_one_outlet", "critical", full & (c("outlets") < 2)), ("full_with_dominant_outlet", "warning", full & (c("dominant_share") >= 0.8))],
        [("full_on_one_article", "warning", full & (c("articles") < 2))],
        [("full_on_few_bodies", "warning", full & (c("bodies") < 2))],
        [("duplicate_paragraphs", "warning", c("duplicates") > 0)],
        [("unbalanced_quotes", "warning", c("unbalanced") > 0)],
        [("full_says_one_source", "critical", full & c("one_source"))],
        [("full_with_early_split", "warning", full & c("early_split"))],
        [("full_with_follow_on", "warning", full & c("follow_on"))],
    ]
    out = [("no_brief", "critical", ~stored)]
    for group in groups:
        before = F.lit(False)
        for code, severity, test in group:
            test = F.coalesce(test, F.lit(False))
            out.append((code, severity, stored & test & ~before))
            before = before | test
    return sorted(out, key=lambda rule: (rule[1] != "critical", rule[0]))


def quality_flags(briefs: DataFrame, rules: list[tuple[str, str, Column]] | None = None) -> DataFrame:
    """briefs with flags (critical ones first), risk (30 a critical, 12 a warning, 100 at most), priority. rules: code, severity, condition; brief_rules by default."""
    rules = brief_rules() if rules is None else rules
    listed = F.filter(F.array(*(F.when(test, code) for code, _, test in rules)), lambda x: x.isNotNull())
    grave = [code for code, severity, _ in rules if severity == "critical"]
    critical = F.size(F.filter("flags", lambda x: x.isin(grave)))
    out = settled(briefs.withColumn("flags", listed))
    warning = F.size("flags") - critical
    return out.withColumn("risk", F.least(F.lit(100), 30 * critical + 12 * warning)).withColumn("priority", F.when(critical > 0, "critical").when(warning > 0, "warning").otherwise("pass"))


def review_sample(evaluations: DataFrame, limit: int = 12, controls: int = 2) -> DataFrame:
    """All critical rows, warnings up to limit - controls, and the newest passing ones as controls; if nothing failed, newest passing ones.

    evaluations: brief_id, priority, risk, newest. Written once, since classes are counted before they are read; select what is wanted of them before."""
    evaluations = durable(evaluations, "evaluations")
    critical = evaluations.where("priority = 'critical'")
    warned = evaluations.where("priority = 'warning'").orderBy(F.desc("risk"), F.desc("newest"), "brief_id")
    passing = evaluations.where("priority = 'pass'").orderBy(F.desc("newest"), "brief_id")
    n_critical, n_warned = critical.limit(limit).count(), warned.limit(limit).count()
    if not n_critical + n_warned:
        return passing.limit(limit).withColumn("reason", F.lit("pass"))
    parts = [critical.withColumn("reason", F.lit("critical")), warned.limit(max(0, limit - controls - n_critical)).withColumn("reason", F.lit("warning")), passing.limit(controls).withColumn("reason", F.lit("control"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quality_report(evaluations: DataFrame, missing: str = "no_brief") -> DataFrame:
    """One row: briefs by class, those with the flag ``missing``, those ready for a full brief, mean risk and mean grounding ratio (of those that have one).

    evaluations: priority, risk, flags, ready, ratio."""
    c = F.col
    return evaluations.agg(
        F.count("*").alias("briefs"), *(F.count_if(c("priority") == p).alias(p) for p in ("critical", "warning", "pass")), F.count_if(F.array_contains("flags", missing)).alias("missing"), F.count_if("ready").alias("ready"),
        F.round(F.avg("risk"), 6).alias("mean_risk"), F.round(F.avg("ratio"), 6).alias("mean_grounding"),
    )


def grounding_totals(sections: DataFrame) -> DataFrame:
    """One row: briefs, and sections by status over all of them. sections: brief_id, status."""
    return sections.agg(
        F.countDistinct("brief_id").alias("briefs"), *(F.count_if(F.col("status") == x).alias(x) for x in GROUNDING), F.count_if(~F.col("status").isin(GROUNDING)).alias("other")
    )


def source_health(sources: DataFrame, discoveries: DataFrame, articles: DataFrame, feeds: DataFrame, as_of: int, hours: int = 48, top: int = 20) -> DataFrame:
    """Per source over the last hours: discoveries by status, articles and their quality, active feeds; each fact is summed before it is joined.

    discoveries: source_id, status, second, blocked; articles: source_id, story_id, second, is_substantive, is_open, is_paywalled, rendered; feeds: source_id, is_active."""
    since = as_of - 3600 * hours
    d = discoveries.where(F.col("second") >= since).groupBy("source_id").agg(F.count("*").alias("discoveries"), *(F.count_if(F.col("status") == s).alias(s) for s in ("fetched", "failed", "pending", "normalized")), F.count_if("blocked").alias("blocked"))
    f = feeds.groupBy("source_id").agg(F.count_if("is_active").alias("active_feeds"))
    a = articles.where(F.col("second") >= since).groupBy("source_id").agg(
        F.count("*").alias("articles"), F.count_if("is_substantive").alias("substantive"), F.count_if("is_open").alias("open_articles"), F.count_if("is_paywalled").alias("paywalled"),
        F.count_if(F.col("is_paywalled") & ~F.col("is_substantive")).alias("thin_paywalled"), F.count_if("rendered").alias("rendered"), F.countDistinct("story_id").alias("stories"),
    )
    rows = sources.join(d, "source_id", "left").join(a, "source_id", "left").join(f, "source_id", "left")
    rows = rows.fillna(0, [c for c in rows.columns if c not in sources.columns])
    rows = rows.withColumn("substantive_rate", F.round(F.try_divide("substantive", "articles"), 6))
    return rows.orderBy(F.desc("stories"), F.desc("substantive"), F.desc("discoveries"), "source_id").limit(top)


def health_snapshot(fetches: DataFrame, seconds: int = 3600) -> DataFrame:
    """(source_id, start, fetches, success_rate, parse_rate, freshness_lag, degraded): per source and window of time; the lag is the time from the last fetch that brought something to the window's end."""
    f = fetches.withColumn("start", F.floor(F.col("second") / seconds) * seconds)
    rate = lambda test: F.round(100 * F.count_if(test) / F.count("*"), 2)
    out = f.groupBy("source_id", "start").agg(F.count("*").alias("fetches"), rate(F.col("status") != "failed").alias("success_rate"), rate(F.col("status").isin("fetched", "normalized")).alias("parse_rate"), F.max(F.when(F.col("status").isin("fetched", "normalized"), F.col("second"))).alias("_newest"))
    out = out.withColumn("freshness_lag", F.col("start") + seconds - F.col("_newest")).drop("_newest")
    return out.withColumn("degraded", F.when(F.col("success_rate") < 50, "failing").when(F.col("parse_rate") < 25, "unparsed"))


def feed_state(polls: DataFrame, degraded_at: int = 3) -> DataFrame:
    """(feed_id, polls, failures, degraded): failures since the last success. polls: feed_id, ok, second, event_id.

    An aggregate of failures after the latest success, not a sorted window, so a busy feed is folded before the shuffle."""
    at = F.struct("second", "event_id")
    last = polls.groupBy("feed_id").agg(F.max(F.when(F.col("ok"), at)).alias("_last"), F.count("*").alias("polls"))
    after = polls.where(~F.col("ok")).join(last, "feed_id").where(F.col("_last").isNull() | (at > F.col("_last"))).groupBy("feed_id").agg(F.count("*").alias("failures"))
    out = last.select("feed_id", "polls").join(after, "feed_id", "left").fillna(0, ["failures"])
    return out.withColumn("degraded", F.col("failures") >= degraded_at)


#: Seconds of a bucket of running state.
DAY = 86400


def consecutive_failures(polls: DataFrame) -> DataFrame:
    """polls with run: failures in a row up to this poll.

    Failures so far, less those at the last success; both are carried from day to day, so a busy feed is not one task."""
    order = ["second", "event_id"]
    p = polls.withColumn("_day", F.floor(F.col("second") / DAY))
    failed = F.when(F.coalesce("ok", F.lit(False)), 0).otherwise(1)
    p = sum_before(p, ["feed_id"], "_day", order, failed, "_failed").withColumn("_failed", F.col("_failed") + failed)
    p = last_before(p, ["feed_id"], "_day", order, F.when(F.col("ok"), F.col("_failed")), "_at_success")
    return p.withColumn("run", F.when(F.col("ok"), 0).otherwise(F.col("_failed") - F.coalesce("_at_success", F.lit(0))).cast("long")).drop("_day", "_failed", "_at_success")


#: Bins of one pass over the values in the search for a median.
BINS = 4096


def exact_median(frame: DataFrame, value: str) -> float | None:
    """The median of a numeric column, the mean of the middle two where there are two; None without values. Nulls do not count.

    Each pass counts the values of a range in ``BINS`` bins; the bin that holds the middle one is the range of the next, until its values are equal. What the driver and any task hold is the bins."""
    values = frame.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole.n:
        return None

    def ranked(rank: int) -> float:
        lo, hi = whole.lo, whole.hi
        while lo < hi:
            step = (hi / BINS - lo / BINS) or math.ulp(hi)
            place = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1))
            bins = values.where(F.col("v").between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for b in sorted(bins, key=lambda r: r.bin):
                if rank < b.n:
                    lo, hi = b.lo, b.hi
                    break
                rank -= b.n
        return lo

    low = ranked((whole.n - 1) // 2)
    return low if whole.n % 2 else (low + ranked(whole.n // 2)) / 2


def ops_metrics(articles: DataFrame, known_outlets: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: median minutes from ingestion to story, share of articles whose outlet is known, mean days since refresh, median hours from a report to its correction.

    corrections: article_id, hours since the report (negative ones, which precede it, do not count)."""
    j = articles.join(known_outlets.select("outlet", "refreshed_days"), "outlet", "left")
    with Tables(articles.sparkSession) as tables:
        waits = tables.write(articles.select((F.col("story_minute") - F.col("minute")).cast("double").alias("v")), "waits")
        late = tables.write(corrections.where("hours >= 0").select(F.col("hours").cast("double").alias("v")), "late")
        wait, hours, n = exact_median(waits, "v"), exact_median(late, "v"), late.count()
    found = lambda x: F.lit(x).cast("double")
    return j.agg(F.round(F.avg(F.col("refreshed_days").isNotNull().cast("double")), 6).alias("outlet_hit_rate"), F.round(F.avg("refreshed_days"), 6).alias("mean_refresh_days")).select(
        found(wait).alias("median_latency"), "outlet_hit_rate", "mean_refresh_days", found(hours).alias("correction_hours"), F.lit(n).cast("long").alias("corrections")
    )


def reader_sessions(events: DataFrame, gap: int = 1800) -> DataFrame:
    """(user_id, start, end, events, views, evidence): sessions split where a reader pauses longer than ``gap`` seconds. Pauses and numbers of sessions are carried from day to day."""
    order = ["second", "event_id"]
    e = last_before(events.withColumn("_day", F.floor(F.col("second") / DAY)), ["user_id"], "_day", order, F.col("second"), "_last")
    fresh = F.when(F.col("second") - F.col("_last") <= gap, 0).otherwise(1)
    s = sum_before(e, ["user_id"], "_day", order, fresh, "_s").withColumn("_s", F.col("_s") + fresh)
    return s.groupBy("user_id", "_s").agg(F.min("second").alias("start"), F.max("second").alias("end"), F.count("*").alias("events"), F.count_if(F.col("action") == "view").alias("views"), F.count_if(F.col("action") == "evidence").alias("evidence")).drop("_s")


#: What a reader does with a context that was of use.
USEFUL = ["save", "follow", "compare", "useful"]


def reader_metrics(events: DataFrame, gap: int = 1800) -> DataFrame:
    """One row: sessions, share of viewing sessions that opened evidence, share of those that opened evidence and then saved, followed or compared (context usefulness), share of readers who
    follow and came back, rapid re-opens."""
    s = reader_sessions(events, gap)
    useful = events.where(F.col("action").isin(USEFUL)).select("user_id", F.col("second").alias("_u"))
    opened = durable(s.where("evidence > 0").select("user_id", "start", "end"), "opened")
    used = opened.join(useful, "user_id", "left").groupBy("user_id", "start").agg(F.coalesce(F.bool_or(F.col("_u").between(F.col("start"), F.col("end"))), F.lit(False)).alias("_used"))
    share = used.agg(F.round(F.avg(F.col("_used").cast("double")), 6).alias("context_usefulness"))
    paused = last_before(s.withColumn("_day", F.floor(F.col("start") / DAY)), ["user_id"], "_day", ["start"], F.col("end"), "_before").withColumn("_pause", F.col("start") - F.col("_before"))
    one = paused.agg(F.count("*").alias("sessions"), F.round(F.try_divide(F.count_if((F.col("views") > 0) & (F.col("evidence") > 0)), F.count_if(F.col("views") > 0)), 6).alias("follow_through"), F.count_if(F.col("_pause") <= 2 * gap).alias("rapid_reopens"))
    first = events.where("action = 'follow'").groupBy("user_id").agg(F.min("second").alias("_f"))
    back = first.join(events.groupBy("user_id").agg(F.max("second").alias("_l")), "user_id").agg(F.round(F.avg((F.col("_l") > F.col("_f") + gap).cast("double")), 6).alias("return_rate"))
    keyed = [x.withColumn("_one", F.lit(1)) for x in (one, share, back)]
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")
