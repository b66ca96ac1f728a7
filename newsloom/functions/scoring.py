"""Scores of articles as sums of terms over columns; rule tables are parameters.

An article has headline, summary, url, body_text, extraction_quality and access_signal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import looks_clipped, match_tokens, squeeze, title_like

#: Own default rules; the registered queries use words that occur in the test tables.
RULES = {
    "context_headline": r"(?i)^(how|why|what) |explained",
    "context_url": r"(?i)/(opinion|analysis|explainer)/",
    "commentary": r"(?i)\b(opinion|column|editorial)\b",
    "explainer": ["what to know", "what we know", "why it matters"],
    "event": r"(?i)\b(kills?|wins?|votes?|strikes?|signs?)\b",
    "context_tokens": ["analysis", "explain", "history", "guide"],
    "anchor_stop": ["people", "year", "time"],
}
QUALITY_POINTS = {"article_body": 6, "metadata_description": 3}


def total(*terms: tuple[Column, int] | Column) -> Column:
    """Sum of points for conditions that hold, and of plain numbers."""
    values = [F.when(F.coalesce(t[0], F.lit(False)), t[1]).otherwise(0) if isinstance(t, tuple) else t for t in terms]
    return reduce(lambda a, b: a + b, values).cast("int")


def steps(value: Column, rungs: list[tuple[int, int]], floor: int) -> Column:
    """Points of the first rung (at least, points) that the value reaches."""
    out = F.lit(floor)
    for least, points in sorted(rungs):
        out = F.when(value >= least, points).otherwise(out)
    return out


def two_sentences(body: Column) -> Column:
    """Whether a text holds two sentences at least, by its end marks."""
    return F.rlike(F.coalesce(body, F.lit("")), F.lit(r"(?s)[.!?]\s+[A-Z].*[.!?]"))


def is_title_only_stub(title: Column, summary: Column, quality: Column, body: Column) -> Column:
    """The summary only repeats the title and there is no body of two sentences to draw on."""
    return title_like(title, summary) & ~((quality == "article_body") & two_sentences(body))


def summary_quality(title: Column, summary: Column, quality: Column, body: Column) -> Column:
    clean = squeeze(summary)
    words = F.size(F.regexp_extract_all(clean, F.lit("([A-Za-z0-9']+)"), 1))
    return total(
        F.when(quality == "article_body", 6).when(quality == "metadata_description", 3).otherwise(0),
        steps(words, [(18, 5), (12, 3), (8, 1)], -5),
        steps(F.length(clean), [(180, 4), (110, 2), (80, 1)], -3),
        (F.rlike(clean, F.lit("[.!?]$")), 1),
        (F.length(squeeze(body)) >= 240, 2),
        (looks_clipped(clean), -4),
        (title_like(title, clean), -8),
    )


def context_score(title: Column, summary: Column, url: Column, quality: Column, body: Column, rules: dict = RULES) -> Column:
    both = F.concat_ws(" ", title, summary)
    headline = F.rlike(title, F.lit(rules["context_headline"]))
    plain = total(
        (headline, 3),
        (F.rlike(url, F.lit(rules["context_url"])), 2),
        (F.rlike(both, F.lit(rules["commentary"])), 3),
        (F.contains(title, F.lit("?")), 1),
        (F.size(F.array_intersect(match_tokens(both), F.array(*map(F.lit, rules["context_tokens"])))) >= 2, 1),
        (reduce(lambda a, b: a | b, (F.contains(F.lower(both), F.lit(p)) for p in rules["explainer"])), 1),
        (is_title_only_stub(title, summary, quality, body), 2),
        (F.rlike(title, F.lit(rules["event"])), -1),
    )
    return F.greatest(plain - F.when((quality == "article_body") & (plain > 0) & ~headline, 1).otherwise(0), F.lit(0)).cast("int")


def event_signal(title: Column, quality: Column, signal: Column, tags: Column, anchors: Column, entities: Column, context: Column, rules: dict = RULES) -> Column:
    upto = lambda c: F.least(F.size(c), F.lit(2))
    return total((F.rlike(title, F.lit(rules["event"])), 3), (quality == "article_body", 2), (signal == "open", 1), 2 * upto(tags), upto(anchors), upto(entities), -2 * context)


def pattern_points(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """Points of each pattern that occurs, once."""
    return total(F.lit(0), *((F.rlike(text, F.lit(p)), points) for p, points in patterns))


def item_quality(text: Column, bonus: Column, quality: Column, good: list[tuple[str, int]], bad: list[tuple[str, int]]) -> Column:
    clamped = F.least(F.greatest(quality, F.lit(-8)), F.lit(8))
    return (F.coalesce(bonus, F.lit(1)) + pattern_points(text, good) - pattern_points(text, bad) + clamped).cast("int")


def is_substantive(variant: str, body: Column, text: Column, quality: Column | None = None, mismatch: Column | None = None) -> Column:
    """item: body of 180 or quality of 6; report: 180 or summary of 110; perspective: 220 or 120; brief: 180 unmismatched or 110."""
    body_length, text_length = F.length(squeeze(body)), F.length(squeeze(text))
    if variant == "item":
        return (body_length >= 180) | (quality >= 6)
    if variant == "perspective":
        return (body_length >= 220) | (text_length >= 120)
    long_body = body_length >= 180
    if variant == "brief" and mismatch is not None:
        long_body = long_body & ~mismatch
    return long_body | (text_length >= 110)


def first_match(text: Column, ordered: list[tuple[str, str]], default: str) -> Column:
    """The key of the first pattern that matches."""
    out = F.lit(default)
    for key, pattern in reversed(ordered):
        out = F.when(F.rlike(text, F.lit(pattern)), key).otherwise(out)
    return out


def desk_label(text: Column, rules: list[tuple[str, list[tuple[str, int]]]], default: str = "general") -> Column:
    """The desk with most pattern points, the earlier of equals; none without points."""
    best, label = F.lit(0), F.lit(default)
    for desk, patterns in rules:
        points = pattern_points(text, patterns)
        label = F.when(points > best, desk).otherwise(label)
        best = F.greatest(best, points)
    return label


def read_quality(quality: Column, signal: Column, extraction: Column) -> Column:
    return total(quality, (signal == "open", 3), (signal == "likely_paywalled", -2), (extraction == "article_body", 2))


def source_family(outlet_type: Column, outlet: Column, policy_outlets: list) -> Column:
    return F.when(outlet_type == "wire", "wire").when(outlet_type == "regional", "local").when(outlet_type == "specialist", "specialist").when(outlet.isin(policy_outlets), "policy").otherwise("national")


def coverage_scope(family: Column, outlet: Column, international_outlets: list, text: Column, pattern: str) -> Column:
    return F.when(family == "local", "local").when(outlet.isin(international_outlets) | F.rlike(text, F.lit(pattern)), "international").otherwise("national")
