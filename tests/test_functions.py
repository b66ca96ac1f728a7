"""Values of single functions and operators on small frames."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions import pages as PG
from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import audits, briefs, enrich, grouping, neighbors, outlets, revisions, similarity, stories, tables


def one(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())] if columns else [(1,)], list(columns) or ["x"])
    return frame.select(expression.alias("r")).first().r


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTPS://www.News.example/a//b/index.html?utm_source=x&id=7&q=z#top", "https://news.example/a/b?id=7"),
    ("//host.example/x/", "https://host.example/x"),
    ("host.example", "https://host.example/"),
    ("http://host.example/INDEX.HTML", "http://host.example/"),
    ("https://h.example/a?ArticleID=3&storyid=&p=2&ref=9", "https://h.example/a?ArticleID=3&p=2"),
    ("   ", ""),
    (None, ""),
])
def test_canonical_url(spark, url, expected):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(U.canonical_url(F.col("u"))).first()[0] == expected


def test_normalize_domain(spark):
    assert one(spark, U.normalize_domain(F.lit(" HTTPS://www.A.example/x "), {"a.example": "b.example"})) == "b.example"


def test_stems(spark):
    words = ["stories", "running", "closed", "rated", "boxes", "houses", "cars", "glass", "ed"]
    got = [one(spark, X.stem(F.lit(w))) for w in words]
    assert got == ["stor", "runn", "clos", "rated", "box", "hous", "cars", "glass", "ed"]


def test_access_by_parent_domain(spark):
    tier = outlets.access_tier(F.lit("unknown"), F.lit("m.news.example"), ["other.example"], ["news.example"])
    assert one(spark, tier) == "likely_paywalled"


def test_title_from_url(spark):
    assert one(spark, U.title_from_url(F.lit("https://a.example/x/big-story-2024-today.html"))) == "Big story today"
    assert one(spark, U.title_from_url(F.lit("https://a.example/x/12.html"))) is None


def test_dates(spark):
    forms = ["Tue, 05 Mar 2024 10:00:00 +0200", "2024-03-05T08:00:00Z", "2024-03-05T10:00:00+02:00", "Tue, 05 Mar 2024 08:00:00 GMT"]
    got = {one(spark, F.unix_seconds(X.parse_published_at(F.lit(f)))) for f in forms}
    assert got == {1709625600}
    assert one(spark, X.parse_published_at(F.lit("soon"))) is None


FIRST = "A long enough paragraph that tells what happened in the town on that day, in full."
SECOND = "Another paragraph that goes on & on about the very same events in the town."


def test_page_text():
    page = f"<html><article><p>{FIRST}</p><p>{FIRST}</p><p>Short.<p>{SECOND.replace('&', '&amp;')}</article><p>{FIRST} outside</p>"
    assert PG.article_paragraphs(page) == [FIRST, SECOND]
    found = PG.enrich(page, "https://open.example/a", "fallback")
    assert (found.lede, found.body_preview, found.extraction_quality, found.access_signal, found.block_reason) == (FIRST, f"{FIRST} {SECOND}", "article_body", "open", None)
    blocked = PG.enrich(page, None, "<b>fall</b> back", 403)
    assert (blocked.lede, blocked.body_preview, blocked.extraction_quality, blocked.block_reason, blocked.block_vendor) == ("<b>fall</b> back", "", "rss_only", "http_access_denied", "generic")
    assert PG.enrich("<title>403 Forbidden</title>").block_vendor == "refused"
    assert PG.enrich(None).lede == "" and PG.enrich("").extraction_quality == "rss_only"


def test_page_metadata_image_and_access():
    text = "The council of the town described in two sentences what it means to build. It named the price as well."
    page = f"<meta content='{text}' property='og:description'><meta property=\"og:image\" content=\"https://i.example/1.jpg\"><p>No.</p>"
    found = PG.enrich(page, "https://www.paid.example/story", "fallback")
    assert (found.lede, found.extraction_quality, found.access_signal, found.image) == (text, "metadata_description", "likely_paywalled", "https://i.example/1.jpg")
    assert PG.enrich(page + '<div class="paywall">', "https://open.example").access_signal == "likely_paywalled"
    assert "Mayor Jane Doe" in PG.enrich(f"<p>{FIRST} Mayor Jane Doe of ROME said so on Monday.</p>").entities


def test_paragraphs_skip_what_is_no_narrative():
    bad = [
        "state.load(row[0].cells, other[1].cells); and so on in this way for a while longer", "Related: the mayor of the town leaves the council after a long dispute over money", "This automatic transcript of the session may differ from what was said in the room.",
        "Visitors by the station on a grey afternoon, with the tower of the old town far away", "Crowds walk past a window in the old quarter of the town on Friday morning, as in May", "A boat on the river (illustration by Jane Doe) in the early light of a long summer day", "Copyright of the publisher, see the terms for what that means to readers elsewhere.",
    ]
    page = "<article>" + "".join(f"<p>{x}</p>" for x in [bad[0], FIRST, *bad[1:], SECOND.replace("&", "and")]) + "</article>"
    assert PG.article_paragraphs(page) == [FIRST, SECOND.replace("&", "and")]
    assert not PG.non_narrative("Workers at the station confirmed that the council had told them of the flood for a week.")


def test_source_windows_and_site_texts():
    body = "".join(f"<p>{x}</p>" for x in (FIRST, SECOND))
    page = f"<article><p>{FIRST}</p></article><div class=\"x body-text\">{body}</div>"
    assert PG.enrich(page, "https://news.example.org/a").paragraphs == (FIRST, SECOND) and PG.enrich(page, "https://other.example/a").paragraphs == (FIRST,)
    rules = PG.PageRules(site_texts={"example.net": ("(?i)hub for polls",)})
    page = f"<meta property='og:description' content='The ultimate hub for polls and results of every race in the land.'><p>The ultimate hub for polls and results of every race in the land, updated daily.</p><p>{SECOND}</p>"
    assert PG.enrich(page, "https://www.example.net/a", rules=rules).lede == SECOND.replace("&", "&") and PG.enrich(page, "https://x.example", rules=rules).lede.startswith("The ultimate hub")


def test_live_updates_that_fit_the_headline():
    update = lambda head, body: {"@type": "BlogPosting", "headline": head, "articleBody": body}
    fits = "The harbor island raid hit the oil terminal before dawn, the ministry told reporters, and fires burned through the morning."
    also = "Officials said the raid on the harbor island was ordered after oil tankers came under attack in the strait last week."
    other = "A school reform bill passed the lower chamber by a narrow vote, and teachers welcomed the result with relief and hope."
    import json

    blog = {"@type": "LiveBlogPosting", "headline": "Live: raid strikes harbor island oil terminal", "liveBlogUpdate": [update("Raid hits terminal", fits), update("School bill", other), update("Why the raid was ordered", also)]}
    page = f'<script type="application/ld+json">{json.dumps(blog)}</script><article><p>state.load(row[0].cells, other[1].cells); and more lines of that very same sort</p></article>'
    assert PG.live_updates(page) == [fits, also]
    found = PG.enrich(page, "https://live.example.com/x", "fallback")
    assert found.extraction_quality == "article_body" and found.lede.startswith("The harbor island raid") and "school" not in found.body_preview.lower()


def test_sentences():
    assert PG.split_sentences('Dr. Smith spoke. "It is done. We go," he said. U.S. aid came.') == ["Dr. Smith spoke.", '"It is done. We go," he said.', "U.S. aid came."]
    quoted = PG.split_sentences("He has a plan. “I have my own idea. But what good does it do?” The mayor recalled that they had heard that before. It may last.")
    assert quoted == ["He has a plan.", "“I have my own idea. But what good does it do?” The mayor recalled that they had heard that before.", "It may last."]
    assert PG.split_sentences(None) == [] and PG.split_sentences("no end mark here") == ["no end mark here"]


def test_names_in_both_forms(spark):
    for text in ["At McDonald Hall", "Rome,Oslo-Lima met IN\nNew  York City Of Light today", "UN and EU leaders; Mayor Jane Doe of ROME", "Abc_Def x9 Ab12 Über Paris", "", None]:
        assert one(spark, X.named_entities(F.lit(text))) == PG.named_entities(text or ""), text
    assert PG.named_entities("Rome,Oslo-Lima At McDonald Hall") == ["Rome", "Oslo", "Lima At", "Hall"]


def test_hidden_text():
    body, about, long = f"{FIRST} More.", f"{SECOND} About.", "The council met in the evening and said that the bridge would be built before the end of the year at last."
    page = f'<script type="application/ld+json">{{"@graph": [{{"articleBody": "{body}"}}, {{"description": "{about}"}}]}}</script><script type="application/ld+json">{{broken</script>'
    assert PG.jsonld_text(page) == [body, about]
    assert PG.embedded_json_text(f'{{"excerpt": "{long}", "text": "{long} Not under this key."}}') == [long]
    assert PG.embedded_json_text(f'{{"subHeadline": "{long[:-1]}, \\u00e9t\\u00e9."}}') == [f"{long[:-1]}, été."]
    assert PG.embedded_json_text('{"description": "too short"}') == [] and len(PG.embedded_json_text("".join(f'"summary": "{long} Number {i}."' for i in range(20)))) == 8


def test_column_and_python_forms_agree(spark):
    texts = [FIRST, SECOND, "", "short", FIRST[:-1], FIRST + " And then", FIRST + ' "open', f"{FIRST} J", "Smoke rises near the harbor after the strike in the early hours, as seen from far away.", f"{FIRST} {SECOND} " * 9, "Jane D.", "x" * 400, f"{FIRST} to a b"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in frame.select("t", X.is_non_narrative(F.col("t")).alias("n"), X.looks_clipped(F.col("t")).alias("c"), X.clean_snippet(F.col("t"), 320).alias("s")).collect():
        clean = " ".join(r.t.split())
        assert (r.n, r.c, r.s) == (PG.non_narrative(clean), PG.clipped(clean), PG.snippet(r.t, 320)), r.t
    assert one(spark, X.clean_snippet(F.lit(f"{FIRST} {'word ' * 100}"), 320)) == FIRST and one(spark, X.clean_snippet(F.lit("word " * 100), 320)) == ""


def test_sanitize_reaches_a_fixpoint():
    text = PG.sanitize("By Jane Doe. Photo: A. B. Read more here. The town met .")
    assert PG.sanitize(text) == text


def test_embedding_text_trims_sentences(spark):
    body = "A first sentence of fifty characters or more stands here. 185 entries of the second sentence stand here, as long as the first. 222 of the third are here as well, which is long enough, too."
    text = one(spark, similarity.embedding_text(F.lit("T"), F.lit("S"), F.lit(body), F.array(F.lit("Rome")), F.array(F.lit("b"), F.lit("a"))))
    assert text == "t s a first sentence of fifty characters or more stands here 185 entries of the second sentence stand here as long as the first 222 of the third are here as well which is long enough too rome a b"
    twice = "The very same sentence of fifty characters or more stands here. " * 2
    assert one(spark, similarity.embedding_text(F.lit("T"), F.lit("T"), F.lit(twice), F.array().cast("array<string>"), F.array().cast("array<string>"))).count("very same") == 1


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = tables.upsert_by_key(a, b, ["k"])
    twice = tables.upsert_by_key(once, b, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_last_by_key(spark):
    rows = spark.createDataFrame([("u", 1, "x"), ("u", 3, "z"), ("u", 2, "y")], "url string, seq int, v string")
    assert tables.last_by_key(rows, "url", "seq").collect() == [("u", 3, "z")]


def test_publish_revisions(spark):
    history = spark.createDataFrame([(1, "a", "s1", False), (1, "b", "s2", True), (2, "c", "s1", True)], "story_id int, tag string, signature string, is_current boolean")
    new = spark.createDataFrame([(1, "n1", "s1"), (2, "n2", "s1"), (3, "n3", "s9")], "story_id int, tag string, signature string")
    table, changes = revisions.publish_revisions(history, new)
    assert sorted(changes.collect()) == [(1, "a", "reuse"), (2, "c", "unchanged"), (3, "n3", "create")]
    current = table.where("is_current").groupBy("story_id").count().collect()
    assert sorted(current) == [(1, 1), (2, 1), (3, 1)]
    again, unchanged = revisions.publish_revisions(table, new)
    assert sorted(again.collect()) == sorted(table.collect()) and {r.change for r in unchanged.collect()} == {"unchanged"}


def test_front_page_ignores_framing(spark):
    rows = [(i, i % 7, 1 + i % 4, 100 - i, 10, "live", i % 2 == 0) for i in range(20)]
    frame = spark.createDataFrame(rows, "story_id int, quality int, outlets int, minute int, section_points int, origin string, eligible boolean")
    plain = [r.story_id for r in stories.front_page_rank(frame, 100).collect()]
    framed = [r.story_id for r in stories.front_page_rank(frame.withColumn("framing", F.col("story_id") % 3).withColumn("reliability", F.rand(1)), 100).collect()]
    assert plain == framed


PAIR = "a int, b int, a_tokens array<string>, a_tags array<string>, a_entities array<string>, a_contextual boolean, b_tokens array<string>, b_tags array<string>, b_entities array<string>, b_contextual boolean, similarity double"


def joined(spark, rows, **lexicons):
    pairs = spark.createDataFrame(rows, PAIR)
    return {r.a: (r.score, r.joins) for r in stories.should_join(stories.match_score(stories.pair_features(pairs, **lexicons))).collect()}


def test_matching(spark):
    item = (["quake", "town", "rescue"], ["disaster"], ["rome"], False)
    got = joined(spark, [(1, 2, *item, *item, 0.0), (3, 4, *item, ["sport"], [], [], False, 0.1)])
    assert {k: (s > 0, j) for k, (s, j) in got.items()} == {1: (True, True), 3: (False, False)}


def test_joins_without_shared_words(spark):
    """Nothing but a similarity may join; an entity needs less of it. Neither scores."""
    a, b = (["quake"], [], ["rome"], False), (["goal"], [], ["rome"], False)
    bare = (["goal"], [], [], False)
    got = joined(spark, [(1, 9, *a, *bare, 0.42), (2, 9, *a, *bare, 0.41), (3, 9, *a, *b, 0.32), (4, 9, *a, *b, 0.31), (5, 9, [], [], [], False, *bare, 0.5)])
    assert got == {1: (0.0, True), 2: (0.0, False), 3: (0.0, True), 4: (0.0, False), 5: (0.0, True)}


def test_contextual_items_need_more(spark):
    report, guide = (["quake", "town"], [], [], False), (["quake", "guide"], [], [], True)
    got = joined(spark, [(1, 9, *guide, *report, 0.65), (2, 9, *guide, *report, 0.66), (3, 9, *report, *guide, 0.65), (4, 9, *guide, *guide, 0.5)], low_signal=["town", "guide"])
    assert [got[k][1] for k in (1, 2, 3, 4)] == [False, True, False, True] and got[1][0] == 0
    generic = (["quake", "town"], ["crisis"], [], False)
    got = joined(spark, [(1, 9, *generic, *generic, 0.9), (2, 9, ["quake", "town", "aid"], ["crisis"], [], False, ["quake", "aid"], ["crisis"], [], False, 0.0)], low_signal=["town"], generic_tags=["crisis"])
    assert got[1] == (0.0, False) and got[2][1]


ITEM = "article_id long, minute long, tokens array<string>, tags array<string>, entities array<string>, contextual boolean"
LEXICONS = {"broad": ["news"], "low_signal": ["price"], "anchor_stop": ["know", "explainer"], "generic_tags": ["crisis"]}


def grouped(spark, rows, near, **options):
    links = spark.createDataFrame([x for a, b, s in near for x in ((a, b, s), (b, a, s))], "item long, neighbor long, similarity double")
    return grouping.build_stories(spark.createDataFrame(rows, ITEM), links, **LEXICONS, **options).toPandas().set_index("article_id").story_id.to_dict()


def test_grouping(spark):
    rows = [(1, 10, ["quake", "town", "rescue", "aid"], [], [], False), (2, 9, ["quake", "town", "rescue", "dog"], [], [], False), (3, 8, ["match", "goal"], [], [], False)]
    assert grouped(spark, rows, [(1, 2, 0.5)]) == {1: 1, 2: 1, 3: 3}


def test_grouping_cases(spark):
    """Reports of one event meet, another event and guides around it stay apart from them."""
    reserve = [(1, 30, ["oil", "reserve", "release", "price"], ["reserve_release"], ["united states"], False), (2, 20, ["oil", "reserve", "release", "fuel", "price"], ["reserve_release"], ["united states"], False), (3, 10, ["settlers", "sanctions", "review"], [], ["west bank"], False)]
    assert grouped(spark, reserve, [(1, 2, 0.55), (2, 3, 0.12)]) == {1: 1, 2: 1, 3: 3}
    ships = [(1, 30, ["attack", "shipping", "ship", "strait"], ["shipping_attack"], ["iran", "strait"], False), (2, 20, ["commercial", "ship", "reroute"], ["shipping_attack"], ["iran"], False), (3, 10, ["congress", "meeting", "political"], ["congress"], ["china"], False)]
    assert grouped(spark, ships, [(1, 2, 0.4), (1, 3, 0.1), (2, 3, 0.1)]) == {1: 1, 2: 1, 3: 3}
    island = [(1, 30, ["fire", "retaliation", "island", "hub"], [], ["harbor", "island one"], False), (2, 20, ["island", "explainer", "know", "shipping"], [], ["island one", "iran"], True), (3, 10, ["island", "know", "site", "struck"], [], ["island one", "iran"], True)]
    assert grouped(spark, island, [(1, 2, 0.45), (1, 3, 0.4), (2, 3, 0.5)]) == {1: 1, 2: 2, 3: 2}


def test_grouping_by_the_union_of_a_story(spark):
    """The third shares two words with each of the others, four with both, which alone admits it."""
    rows = [(1, 30, ["a1", "a2", "x1", "x2"], ["t"], [], False), (2, 20, ["b1", "b2", "x1", "x2"], ["t"], [], False), (3, 10, ["a1", "a2", "b1", "b2", "z1", "z2", "z3"], [], [], False)]
    lexicons = {**LEXICONS, "anchor_stop": ["a1", "a2", "b1", "b2"]}
    links = spark.createDataFrame([(a, b, 0.2) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2))], "item long, neighbor long, similarity double")
    got = grouping.build_stories(spark.createDataFrame(rows, ITEM), links, **lexicons).toPandas().set_index("article_id").story_id.to_dict()
    assert got == {1: 1, 2: 1, 3: 1}


def test_neighbors(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 24))
    x = np.repeat(centres, 10, axis=0) + 0.7 * draw.normal(size=(600, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 24), (901, None)], "k long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9)
    np.fill_diagonal(near, -2)
    want = {i: [j for j in np.lexsort((np.arange(600), -near[i]))[:6] if near[i, j] >= 0.1] for i in range(600)}
    exact = similarity.top_k_neighbors(vectors, "k", "v", vectors.where("k % 50 = 0"), block=64).toPandas()
    assert exact.sort_values(["item", "rank"]).groupby("item").neighbor.apply(list).to_dict() == {i: want[i] for i in range(0, 600, 50)}
    found = similarity.lsh_neighbors(vectors, "k", "v", bucket=100, recall=0.9).toPandas().groupby("item").neighbor.apply(set).to_dict()
    assert np.mean([len(found.get(i, set()) & set(want[i])) / len(want[i]) for i in range(600)]) >= 0.9


def test_texts_are_read_once_for_their_tokens(spark):
    """A title and a text give their tokens once, however often they are asked about."""
    from newsloom.functions.scoring import two_sentences

    rows = spark.createDataFrame([("Ships sail", "Ships sail north.\u2028 Who   Knows? yes"), (None, "")], "t string, s string")
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    alias = X.title_like(F.col("t"), F.col("s")).alias("x")
    assert plan(rows.select(alias)).count("regexp_extract_all") == 2
    assert [r[0] for r in rows.select(X.title_like(F.col("t"), F.col("s"))).collect()] == [True, False]
    two = rows.select(two_sentences(F.regexp_replace("s", "\u2028", "\n\t")), two_sentences(F.col("t"))).collect()
    assert [tuple(r) for r in two] == [(True, False), (False, False)]
    assert [r[0] for r in rows.select(X.marked_sentences(F.col("s"))).collect()] == [["Ships sail north.", "\u2028 Who   Knows?"], []]


def test_hashed_neighbors_are_merged_and_come_once(spark):
    """Codes of all tables take few bytes in a file, but not in memory, so none may be sent to every task; a pair met in several tables takes one rank."""
    import numpy as np

    x = np.random.default_rng(7).normal(size=(2000, 64))
    found = similarity.lsh_neighbors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), "k", "v", bucket=256)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.toPandas()
    assert not rows.duplicated(["item", "neighbor"]).any() and rows.groupby("item")["rank"].max().max() == 6


def test_neighbors_by_lists(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(5)
    centres = draw.normal(size=(60, 24))
    x = np.repeat(centres, 10, axis=0) + 0.7 * draw.normal(size=(600, 24))
    x[100:140] = x[100]  # forty copies
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 24), (901, None)], "k long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 5)
    np.fill_diagonal(near, -2)
    want = {i: {j for j in np.lexsort((np.arange(600), -near[i]))[:6] if near[i, j] >= 0.1} for i in range(600)}
    for options, least in (({}, 0.99), ({"size": 40, "probes": 8}, 0.9), ({"size": 20, "top": 6, "probes": 15}, 0.9)):
        rows = neighbors.ivf_neighbors(vectors, "k", "v", **options).toPandas()
        found = rows.groupby("item").neighbor.apply(set).to_dict()
        assert np.mean([len(found.get(i, set()) & want[i]) / len(want[i]) for i in range(600)]) >= least, options
        assert not rows.duplicated(["item", "neighbor"]).any() and (rows["item"] != rows.neighbor).all() and rows.groupby("item")["rank"].apply(list).map(lambda r: sorted(r) == list(range(1, len(r) + 1))).all()
        assert np.allclose(rows.similarity, near[rows["item"], rows.neighbor], atol=2e-5)
        assert found[120] == set(range(100, 106)) and found[100] == set(range(101, 107))
    assert neighbors.ivf_neighbors(vectors.where("k >= 900"), "k", "v").count() == 0


def test_blocks_of_queries_and_vectors_do_not_travel_as_pairs(spark):
    """A row that holds both blocks would put thousands of them into one batch."""
    vectors = spark.createDataFrame([(i, [1.0, float(i % 7), float(i % 3)]) for i in range(200)], "k long, v array<double>")
    found = similarity.top_k_neighbors(vectors, "k", "v", vectors.where("k % 50 = 0"), block=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan.split("CoGroup")[0] and "CoGroup" in plan and "Join" not in plan
    assert found.groupBy("item").count().where("count = 6").count() == 4


def test_pairs_of_common_tokens_move_once(spark):
    """In blocks and by the join alike every pair comes out once, and no other is made."""
    import random

    from newsloom.sources.scratch import Tables

    draw = random.Random(3)
    sets = sorted({tuple(sorted(draw.sample([f"w{i}" for i in range(9)] + [f"rare{i}" for i in range(6)], draw.choice([1, 2, 3, 5, 6])))) for _ in range(200)})
    frame = spark.createDataFrame(list(enumerate(sets)), "print long, tokens array<string>")
    want = {(i, j): len({*s} & {*t}) / max(len(s), len(t)) for i, s in enumerate(sets) for j, t in enumerate(sets) if i < j and len({*s} & {*t}) / max(len(s), len(t)) >= 0.6}
    with Tables(spark) as tables:
        for block, few in ((16, 4), (1024, 4), (1024, 1000)):
            got = similarity.similar_pairs(frame, 0.6, tables, block, few).collect()
            assert len(got) == len(want) > 50 and {(r.a, r.b): r.similarity for r in got} == want


def test_relations_hold_every_link_of_unlike_headlines(spark):
    rows = [(1, None, "alpha beta gamma delta epsilon", "x"), (2, None, "alpha beta gamma delta other", "y"), (3, None, "alpha beta gamma other words", "z"), (4, "u", "epsilon delta gamma beta alpha", "X"), (5, "u", "", "")]
    got = similarity.article_relations(spark.createDataFrame(rows, "k long, u string, h string, b string"), "k", "u", F.col("h"), F.col("b"), 0.6).collect()
    assert sorted((r.kind, r.article, r.other) for r in got) == [("body", 4, 1), ("headline", 2, 1), ("headline", 3, 1), ("headline", 3, 2), ("headline", 4, 1), ("url", 5, 4)]


def test_near_pairs_are_all_found(spark):
    import random

    draw = random.Random(8)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(draw.sample(words, draw.choice([1, 2, 5, 6, 7, 12])))) for i in range(150)] + [(150, ""), (151, None), (152, "word1 word2"), (153, "word2 word1")]
    got = {(r.a, r.b) for r in similarity.near_pairs(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t"), 0.6).collect()}
    first = {}
    for i, t in rows:
        if t:
            first.setdefault(frozenset(t.split()), i)
    sets = sorted((i, s) for s, i in first.items())
    assert got == {(i, j) for i, s in sets for j, t in sets if i < j and len(s & t) / max(len(s), len(t)) >= 0.6}


def test_syndicated_bodies(spark):
    """A report under another headline, a report inside a longer text, a shared line, and one house's own copy."""
    line = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    report, other = line("r", 60), line("o", 300)
    rows = [(1, "a", report), (2, "b", "Another headline. " + report.upper()), (3, "c", f"{line('x', 100)} {report} {line('y', 40)}"), (4, "a", report), (5, "d", f"{other} {line('r', 12)}"), (6, "e", None), (7, "f", "short text"), (8, "g", line("r", 7)), (9, "h", f"{line('o', 200)}")]
    found = {(r.article, r.other): r for r in similarity.syndicated_bodies(spark.createDataFrame(rows, "k long, outlet string, t string"), "k", "outlet", F.col("t")).collect()}
    assert set(found) == {(2, 1), (3, 1), (3, 2), (9, 5)}  # three meets two where the report begins in both behind other words
    assert found[2, 1].share_of_other == 1 and found[2, 1].place - found[2, 1].place_in_other == 2 and found[2, 1].share > 0.9
    assert found[3, 1].share_of_other > 0.8 and 0.2 < found[3, 1].share < 0.4 and found[3, 1].place - found[3, 1].place_in_other == 100
    assert found[9, 5].share > 0.9 and found[9, 5].share_of_other > 0.5
    prints = {(r.k, r["print"]) for r in similarity.body_fingerprints(spark.createDataFrame(rows, "k long, outlet string, t string"), "k", F.col("t")).collect()}
    pieces = spark.createDataFrame([(i, " ".join(report.split()[i : i + 15])) for i in range(46)], "k long, t string")  # any copy of fifteen words shares a fingerprint
    shared = {r.k for r in similarity.body_fingerprints(pieces, "k", F.col("t")).collect() if (1, r["print"]) in prints}
    assert shared == set(range(46))


def test_similar_groups_are_those_of_all_pairs(spark):
    """Blocks of four meet pairwise; chains and large groups of like sets come out as one."""
    import random

    from newsloom.sources.scratch import Tables

    draw = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    sets = {frozenset(draw.sample(words, draw.choice([1, 2, 5, 6, 7, 12]))) for _ in range(150)} | {frozenset([*words[:9], f"own{i}"]) for i in range(40)}
    rows = list(enumerate(sorted(map(sorted, sets))))
    frame = spark.createDataFrame([(i, i, t) for i, t in rows], "print long, at long, tokens array<string>")
    parent = dict.fromkeys(range(len(rows)))
    top = lambda x: x if parent[x] is None else top(parent[x])
    for i, s in rows:
        for j, t in rows[:i]:
            if len(set(s) & set(t)) / max(len(s), len(t)) >= 0.6 and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i, _ in rows}
    with Tables(spark) as tables:
        got = {r["print"]: r.group for r in similarity.similar_groups(frame, 0.6, tables, block=4).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want and set(got) == {i for i in want if sum(g == want[i] for g in want.values()) > 1}


def test_hash_vector():
    v = similarity.hash_vector("one two three")
    assert abs((v * v).sum() - 1) < 1e-9 and not similarity.hash_vector("").any()


def test_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/orders.parquet").limit(0)
    assert tables.upsert_by_key(docs, docs, ["o_orderkey"]).count() == 0
    events = spark.createDataFrame([], "feed_id int, ok boolean, second long, event_id long")
    assert audits.feed_state(events).count() == 0


def test_keep_better(spark):
    old = spark.createDataFrame([(1, "old", "article_body"), (2, "old", "rss_only")], "k int, summary string, extraction_quality string")
    new = spark.createDataFrame([(1, "new", "rss_only"), (2, "new", "rss_only"), (3, "new", "rss_only")], "k int, summary string, extraction_quality string")
    assert sorted((r.k, r.summary) for r in enrich.keep_better_enrichment(old, new, "k", ["summary"]).collect()) == [(1, "old"), (2, "new"), (3, "new")]


def test_shuffled_input_gives_the_same(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("rank_in_story"), F.col("l_suppkey").alias("outlet"), F.col("l_quantity").cast("int").alias("quality"), (F.col("l_linestatus") == "O").alias("is_open"))
    a = stories.lead_and_open_alternate(lines).toPandas().sort_values("story_id").reset_index(drop=True)
    b = stories.lead_and_open_alternate(lines.orderBy(F.rand(3))).toPandas().sort_values("story_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


SOURCE = {"article_id": 0, "outlet": "", "snippet": "", "detail": "", "followup": "", "body_paragraphs": [], "focus": "", "comparison_ready": True, "shell_aligned": True, "contextual": False, "stub": False, "title_like": False, "has_body": True}
STORY = {"headline": "Council approves the harbor bridge after a long debate", "summary": "The council approved the harbor bridge on Monday after a debate of many hours in the old hall.", "family": "politics", "facts": ["The bridge is long.", "The bridge will cost ninety million.", "The bridge will cost ninety million!"], "corrections": []}
LEAD = {**SOURCE, "article_id": 1, "outlet": "One", "focus": "harbor bridge vote", "snippet": "The council approved the harbor bridge on Monday after a debate of many hours in the old hall. Ninety people spoke.", "detail": "Builders are expected to start in spring, according to the plan that officials laid out in public."}
OTHER = {**SOURCE, "article_id": 2, "outlet": "Two", "focus": "ferry jobs", "snippet": "Ferry workers warned that two hundred jobs hang on the crossing, which the new bridge would replace.", "detail": "Their union said that it would challenge the decision in court before the summer begins.", "followup": "A study of the port counted four thousand daily passengers on the boats last year."}


def brief(sources, **changes):
    options = {"lead_id": 1, "divergent_id": 2, "comparison_id": 1, "alternate_id": None, "ready": True, "product": "The desk"} | changes
    return briefs.compose_brief(STORY, sources, *options.values())


def test_full_brief():
    got = brief([LEAD, OTHER])
    assert got["status"] == "full" and [p["role"] for p in got["paragraphs"]] == ["opening", "baseline", "detail", "difference"]
    assert [p["support"] for p in got["paragraphs"]] == [[1, 2], [1, 2], [2], [1, 2]] and all(p["mode"] == "required" for p in got["paragraphs"])
    assert got["paragraphs"][0]["text"] == STORY["summary"] and got["paragraphs"][1]["text"].startswith("All of One and Two agree on this much. Their union said")
    assert "Two goes on from there" in got["paragraphs"][3]["text"] or "Two turns to ferry jobs" in got["paragraphs"][3]["text"]
    sections = {s["name"]: s for s in got["sections"]}
    assert sections["why"]["text"] == "The bridge will cost ninety million." and sections["why"]["mode"] == "required" and sections["differ"]["support"] == [1, 2] and sections["watch"]["mode"] == "scaffold"
    assert got["points"] == ["The bridge is long.", "The bridge will cost ninety million."] and got["visible"] and {s["article_id"] for s in got["snapshot"]} == {1, 2}


def test_early_brief():
    got = brief([LEAD], divergent_id=None, ready=False)
    assert got["status"] == "early" and [p["role"] for p in got["paragraphs"]] == ["opening", "detail"] and got["visible"]
    sections = {s["name"]: s for s in got["sections"]}
    assert sections["agree"]["text"].startswith("The fullest report so far is from One:") and sections["agree"]["support"] == [1] and sections["differ"]["mode"] == "scaffold"
    stub = {**LEAD, "stub": True, "comparison_ready": False, "detail": "", "snippet": STORY["headline"], "title_like": True, "has_body": False}
    got = brief([stub], divergent_id=None, comparison_id=None, ready=False)
    assert {s["name"]: s for s in got["sections"]}["agree"]["support"] == [] and not got["visible"] and got["reason"] == "no_distinct_grounded_followup"
    opened = brief([stub, OTHER], divergent_id=None, comparison_id=None, alternate_id=2, ready=False)
    assert any(2 in p["support"] for p in opened["paragraphs"])
    none = brief([], lead_id=None, divergent_id=None, comparison_id=None, ready=False)
    assert none["status"] == "early" and none["paragraphs"] == [{"text": STORY["summary"], "role": "opening", "mode": "scaffold", "support": []}] and none["snapshot"] == []


def test_brief_repeats_nothing():
    same = {**OTHER, "snippet": LEAD["snippet"], "detail": LEAD["detail"], "followup": "", "focus": LEAD["focus"]}
    got = brief([LEAD, same])
    texts = [p["text"] for p in got["paragraphs"]]
    assert len(texts) == len(set(texts)) and texts[-1] == briefs.BriefWords().same


def test_opening_takes_the_report_where_the_summary_is_clipped():
    story = {**STORY, "summary": "The council of the town approved the harbor bridge on Monday after a debate of many hours in"}
    assert briefs._opening(story["headline"], story["summary"], LEAD) == "The council approved the harbor bridge on Monday after a debate of many hours in the old hall."


def test_briefs_of_stories(spark):
    """Two outlets with full reports make a full brief, one makes an early one, a story without sources keeps its summary."""
    body = lambda d: [d["snippet"].split(". ")[0] + ".", "Ninety people spoke in the hall before the vote was taken late at night.", d["detail"] + " The harbor bridge was approved by the council.", "The council said that the harbor bridge will open in ten years from now."]
    members = [(1, 1, 1, "One", "left", STORY["headline"], STORY["summary"], body(LEAD)), (1, 2, 2, "Two", "right", "Council approves harbor bridge, ferry workers warn", "The council approved the harbor bridge; ferry workers warned of lost jobs.", ["The council approved the harbor bridge on Monday, and ferry workers warned that two hundred jobs are at risk.", *body(OTHER)[1:]]), (2, 3, 1, "One", "left", STORY["headline"], STORY["summary"], [])]
    frame = spark.createDataFrame(members, "story_id long, article_id long, rank long, outlet string, framing string, headline string, summary string, sentences array<string>")
    frame = frame.withColumns({"extraction_quality": F.when(F.size("sentences") > 0, "article_body").otherwise("rss_only"), "access_signal": F.lit("open"), "context": F.lit(0), "blocked": F.lit(False), "body_length": F.lit(900), "mismatch": F.lit(False), "focus": F.concat(F.lit("focus of "), "outlet")})
    told = spark.createDataFrame([(s, STORY["headline"], STORY["summary"], "politics", ["A fact."], None) for s in (1, 2, 3)], "story_id long, story_headline string, story_summary string, family string, facts array<string>, corrections array<string>")
    flagged = briefs.source_flags(briefs.source_rows(told, briefs.source_texts(frame)))
    got = {r.story_id: r for r in briefs.build_brief(told, flagged, "The desk").collect()}
    assert {k: r.status for k, r in got.items()} == {1: "full", 2: "early", 3: "early"} and {s.outlet for s in got[1].snapshot} == {"One", "Two"}
    assert [p.mode for p in got[3].paragraphs] == ["scaffold"] and not got[3].visible


def test_dedupe_sources_drops_what_repeats_the_title(spark):
    rows = spark.createDataFrame([(1, 1, 1, "quake hits northern town"), (1, 2, 2, "rescuers reach the valley"), (2, 3, 1, "quake hits northern town")], "story_id long, article_id long, rank long, snippet string").withColumn("title", F.lit("Quake hits northern town"))
    assert {r.article_id for r in briefs.dedupe_sources(rows, text="snippet", anchors=["title"]).collect()} == {2, 3}


def test_supports_spread_over_sections():
    assert stories.pick_supports(list("aabab")) == [2, 1, 3, 4] and stories.pick_supports(list("aaaaaaa")) == [1, 2, 3, 4, 5] and stories.pick_supports(["a"]) == [] and stories.pick_supports([]) == []
    assert stories.pick_supports(list("abcdefgh")) == [1, 2, 3, 4, 5] and stories.pick_supports(list("abcdabcd")) == [1, 2, 3, 4, 5]


def test_home_layout(spark):
    rows = [(1, f"s{i % 3}", i, 100 - i, i, i % 2 == 0) for i in range(30)] + [(2, "s", 100, 1, 1, False), (2, "s", 101, 2, 2, False)]
    frame = spark.createDataFrame(rows, "edition long, section string, story_id long, score long, minute long, eligible boolean").withColumns({"origin": F.lit("seed"), "quality": F.lit(0), "outlets": F.lit(1)})
    got = stories.home_layout(frame).collect()
    slots = {}
    for r in sorted(got, key=lambda r: (r.edition, r.slot, r.place)):
        slots.setdefault((r.edition, r.slot), []).append(r.story_id)
    pool = [i for i in range(30) if i % 2 == 0]
    want = [pool[k] for k in stories.pick_supports([f"s{i % 3}" for i in pool])]
    assert slots[1, "featured"] == [0] and slots[1, "support"] == want and slots[1, "latest"] == [i for i in range(29, -1, -1) if i not in [0, *want]][:8]
    rest = [*[i for i in pool if i not in [0, *want]], *[i for i in range(30) if i % 2]]
    assert slots[1, "section:s1"] == [i for i in rest if i % 3 == 1][:4] and slots[2, "featured"] == [101] and slots[2, "support"] == [100]


def test_home_layout_reads_as_far_as_it_has_to(spark):
    """A section whose best story is the 301st still gives a support; live stories and good ones are on the page without being eligible."""
    rows = [(1, "a", i, 1000 - i, 0, True, "seed", 0, 0) for i in range(300)] + [(1, "b", 300, 1, 0, True, "seed", 0, 0), (1, "c", 301, 900, 0, False, "live", 0, 0), (1, "d", 302, 800, 0, False, "seed", 24, 1), (1, "e", 303, 999, 0, False, "seed", 24, 0)]
    frame = spark.createDataFrame(rows, "edition long, section string, story_id long, score long, minute long, eligible boolean, origin string, quality long, outlets long")
    got = {(r.slot, r.place): r.story_id for r in stories.home_layout(frame).collect()}
    assert [got["support", k] for k in range(1, 6)] == [301, 302, 300, 1, 2] and got["featured", 1] == 0


def test_lenses_need_what_they_compare(spark):
    """One outlet gives no pack but evidence; a far report needs one to hold it against; articles that are not substantive are no candidates."""
    from newsloom.operators import perspective

    rows = [(1, "A", "L", "wire", "local", True), (1, "A", "R", "wire", "international", True), (1, "B", "R", "wire", "local", False), (2, "A", "L", "wire", "international", True), (2, "B", "L", "wire", "international", True), (3, "A", "L", "wire", "national", False),
            (4, "A", "L", "wire", "local", True), (4, "B", "L", "press", "international", True), (5, "A", "L", "wire", "national", True)]
    frame = spark.createDataFrame([(s, i, i, o, f, m, c, v) for i, (s, o, f, m, c, v) in enumerate(rows)], "story_id long, article_id long, rank_in_story long, outlet string, framing_group string, family string, scope string, is_substantive boolean")
    frame = frame.withColumns({"access": F.lit("open"), "extraction_quality": F.lit("article_body"), "body_length": F.lit(900), "local_words": F.lit(False)})
    got = {(r.story_id, r.lens): (r.n, r.reason) for r in perspective.lens_status(frame).collect()}
    assert [got[1, x] for x in perspective.LENSES] == [(0, "few_outlets"), (2, "ready"), (0, "few_outlets"), (0, "few_outlets")]
    assert [got[2, x] for x in perspective.LENSES] == [(0, "one_lane"), (2, "ready"), (0, "no_local"), (0, "no_counterpart")]
    assert got[3, "evidence"] == (0, "nothing_read") and got[5, "evidence"] == (1, "thin") and [got[4, x] for x in perspective.LENSES] == [(2, "ready"), (2, "ready"), (1, "ready"), (1, "ready")]
    packs = {(r.story_id, r.lens): r.article_id for r in perspective.lens_items(frame).where("rank = 1").collect()}
    assert set(packs) == {(1, "evidence"), (2, "evidence"), (5, "evidence"), *((4, x) for x in perspective.LENSES)} and packs[4, "local"] == 6 and packs[4, "international"] == 7


def test_a_long_chain_of_similar_sources_takes_few_rounds(spark):
    """Each text is like the next: every second one stays, whatever the slices."""
    n = 3000
    rows = [(1, i, i, " ".join(f"word{j}" for j in range(2 * i, 2 * i + 10))) for i in range(n)]
    sets = [set(t.split()) for *_, t in rows]
    assert len(sets[0] & sets[1]) / 10 >= briefs.REPEATS > len(sets[0] & sets[2]) / 10
    began = time.time()
    got = briefs.dedupe_sources(spark.createDataFrame(rows, "story_id long, article_id long, rank long, summary string"))
    assert sorted(r.article_id for r in got.select("article_id").collect()) == list(range(0, n, 2)) and time.time() - began < 200
    at = spark.createDataFrame([("s", f"p{i:04}", i) for i in range(60)], "story_id string, print string, at long")
    links = spark.createDataFrame([("s", f"p{i:04}", f"p{i + 1:04}") for i in range(59)], "story_id string, a string, b string")
    assert {r["print"] for r in briefs._repeating(at, links, size=16).collect()} == {f"p{i:04}" for i in range(1, 60, 2)}


def test_medians_are_exact(spark):
    for values in ([], [None], [5], [1, 2], [7] * 900, [*range(10_001)], [1e300, -1e300, 0.0, 5e-324], [x * x for x in range(500)], [float("nan"), 3.0, 1.0]):
        clean = sorted(v for v in values if v is not None and v == v)
        want = None if not clean else (clean[(len(clean) - 1) // 2] + clean[len(clean) // 2]) / 2
        assert audits.exact_median(spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double"), "x") == want


def test_lens_items_pass_over_the_first_framing(spark):
    rows = [(1, i, i, f, 900 - i) for i, f in enumerate("LLLRLC")] + [(2, 10, 1, "L", 0), (2, 11, 2, "L", 0)]
    frame = spark.createDataFrame(rows, "story_id long, article_id long, rank_in_story long, framing_group string, body_length long")
    frame = frame.withColumns({"is_substantive": F.lit(True), "access": F.lit("open"), "extraction_quality": F.lit("article_body"), "outlet": F.col("article_id"), "family": F.lit("wire"), "scope": F.when(F.col("article_id") % 2 == 0, "local").otherwise("national"), "local_words": F.lit(False)})
    from newsloom.operators import perspective

    got = {}
    for r in perspective.lens_items(frame).orderBy("rank").collect():
        got.setdefault((r.story_id, r.lens), []).append(r.article_id)
    assert got[1, "balanced"] == [3, 5, 0] and got[1, "evidence"] == [0, 1, 2] and got[1, "local"] == [0, 2] and (2, "balanced") not in got and got[2, "evidence"] == [10, 11]


def test_quality_rules(spark):
    sound = {"brief_id": 1, "has_brief": True, "status": "full", "ready_now": True, "stored_ready": True, "alternate_expected": False, "alternate_stored": False, "agree_mode": "required", "comparison": 2, "stub_shells": 0, "contextual": 0, "snapshot_stubs": 0, "ratio": 0.9, "unsupported": 0, "weak": 0, "refs": 5, "outlets": 2, "articles": 3, "bodies": 2, "dominant_share": 0.5, "duplicates": 0, "unbalanced": 0, "one_source": False, "early_split": False, "follow_on": False}
    cases = [
        ({}, []), ({"has_brief": False, "refs": 0}, ["no_brief"]), ({"ready_now": False}, ["full_without_breadth", "readiness_stale"]), ({"status": "early"}, ["ready_but_early"]), ({"alternate_expected": True}, ["open_alternate_missing"]), ({"comparison": 0, "stub_shells": 1, "contextual": 1}, ["stub_drives_brief"]),
        ({"comparison": 0, "contextual": 1}, ["context_drives_brief"]), ({"comparison": 0, "contextual": 1, "agree_mode": "scaffold"}, []), ({"refs": 0}, ["no_section_support"]), ({"unsupported": 2}, ["grounding_failures"]), ({"weak": 2}, ["grounding_warnings"]), ({"outlets": 1, "dominant_share": 1.0}, ["full_on_one_outlet"]),
        ({"dominant_share": 0.8}, ["full_with_dominant_outlet"]), ({"articles": 1}, ["full_on_one_article"]), ({"bodies": 1}, ["full_on_few_bodies"]), ({"duplicates": 1, "unbalanced": 2}, ["duplicate_paragraphs", "unbalanced_quotes"]), ({"one_source": True}, ["full_says_one_source"]), ({"early_split": True, "follow_on": True}, ["full_with_early_split", "full_with_follow_on"]),
    ]
    assert len(audits.brief_rules()) == 19
    got = {r.brief_id: r for r in audits.quality_flags(spark.createDataFrame([{**sound, **change, "brief_id": k} for k, (change, _) in enumerate(cases)])).collect()}
    assert [got[k].flags for k in range(len(cases))] == [flags for _, flags in cases]
    assert (got[2].risk, got[2].priority) == (42, "critical") and (got[0].risk, got[0].priority) == (0, "pass") and (got[15].risk, got[15].priority) == (24, "warning")


def _exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Expand")


def test_members_of_stories_move_once(spark):
    """A lens, a status or a perspective moves each member once for each table that it makes of them, and multiplies no rows to count distinct ones."""
    from newsloom.operators import perspective

    rows = [(s, a, a % 4, a % 5 > 0, "open", "article_body", 300 + a, "lcr"[a % 3], ["wire", "local"][a % 2], ["local", "international", "national"][a % 3], a % 2 == 0, a % 7) for s in (1, 2, None) for a in range(6)]
    frame = spark.createDataFrame(rows, "story_id long, article_id long, rank_in_story long, is_substantive boolean, access string, extraction_quality string, body_length long, framing_group string, family string, scope string, local_words boolean, outlet long")
    assert _exchanges(perspective.perspective_status(frame)) == (1, 0)
    assert _exchanges(perspective.lens_status(frame)) == (1, 0)
    assert _exchanges(perspective.lens_items(frame)) == (1, 0)
    assert _exchanges(perspective.build_perspective(frame, "It")) == (2, 0)
    assert {r.story_id for r in perspective.lens_items(frame).collect()} == {1, 2}
    status = {r.story_id: r for r in perspective.perspective_status(frame).collect()}
    built = {r.story_id: r for r in perspective.build_perspective(frame, "It").collect()}
    assert set(built) == {1, 2} and all(built[s].outlets == 6 == status[s].outlets and built[s].framings == 3 and built[s].families == 2 for s in built)
    items = perspective.lens_items(frame).where("story_id = 1").groupBy("lens").count().collect()
    assert {(x.lens, x["count"]) for x in built[1].lenses if x["count"]} == {(r.lens, r["count"]) for r in items}


def _counting(spark, frame, column):
    """frame, and a count of how often a value of ``column`` was computed."""
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    return frame.withColumn(column, F.udf(look, "string").asNondeterministic()(column)), seen


def test_source_rows_are_computed_once(spark):
    rows = spark.createDataFrame([(1, 1, 1, "alpha beta gamma delta", "title"), (1, 2, 2, "alpha beta gamma delta", "title"), (1, 3, 3, "other words stand here", "title")], "story_id long, article_id long, rank long, snippet string, title string")
    counted, seen = _counting(spark, rows, "snippet")
    assert {r.article_id for r in briefs.dedupe_sources(counted, text="snippet", anchors=["title"]).collect()} == {1, 3}
    assert seen.value == 3


def test_evaluations_are_computed_once(spark):
    rows = [(i, ["critical", "warning", "pass"][i % 3], i, i) for i in range(30)]
    counted, seen = _counting(spark, spark.createDataFrame(rows, "brief_id long, priority string, risk long, newest long"), "priority")
    got = audits.review_sample(counted).collect()
    assert sorted((r.brief_id, r.reason) for r in got if r.reason != "critical") == [(26, "control"), (29, "control")] and sum(r.reason == "critical" for r in got) == 10
    assert seen.value == 30


def test_windows_of_a_text_are_not_compared_all_with_all(spark):
    """array_distinct on structs compares each with all kept before; what repeats in winnowing is the neighbour."""
    frame = spark.createDataFrame([(1, " ".join(f"word{i * i % 97}" for i in range(3000)))], "article_id long, body string")
    prints = similarity.body_fingerprints(frame, "article_id", F.col("body"))
    assert "array_distinct" not in prints._jdf.queryExecution().executedPlan().toString()
    rows = prints.collect()
    assert rows and len({r.print for r in rows}) == len(rows)


def test_bodies_are_squeezed_once_for_their_prints(spark, monkeypatch):
    seen, whole = [], similarity.squeeze
    monkeypatch.setattr(similarity, "squeeze", lambda text: (seen.append(1), whole(text))[1])
    rows = spark.createDataFrame([(1, "u", "a head here", "Same  body"), (2, None, "other words there", " same body "), (3, None, "third thing now", "  "), (4, None, "fourth thing seen", None)], "k long, url string, h string, b string")
    got = similarity.article_relations(rows, "k", "url", F.col("h"), F.col("b"), 0.9).collect()
    assert [(r.article, r.other, r.kind) for r in got] == [(2, 1, "body")] and len(seen) == 1


def test_every_pair_of_syndicated_bodies_comes_out(spark):
    """Not those alone that share with the first holder of a passage: near copies of a report, a line that all have, copies, and texts without an outlet; whatever the blocks."""
    import random

    draw = random.Random(6)
    report, line = [f"r{i}" for i in range(80)], " ".join(f"line{i}" for i in range(20))
    rows = []
    for i in range(70):
        words = list(report) if i % 3 else [f"own{i}x{j}" for j in range(40)]
        for _ in range(draw.choice([0, 1, 2, 5])):
            words[draw.randrange(len(words))] = f"new{i}"
        rows.append((i, draw.choice("abc") if i % 13 else None, f"{' '.join(words[draw.randrange(20):])} {line}"))
    rows += [(100 + i, draw.choice("ab"), draw.choice(rows)[2].upper()) for i in range(20)] + [(200, "a", line), (201, "b", f"Tail {line}")]
    frame = spark.createDataFrame(rows, "k long, outlet string, t string")
    places = {}
    for r in similarity.body_fingerprints(frame, "k", F.col("t")).collect():
        places.setdefault(r.k, {})[r.print] = r.place
    texts = {}
    for k, _, t in rows:
        texts.setdefault(t.lower(), []).append(k)
    outlet, want = {k: o for k, o, _ in rows}, {}
    for many in texts.values():
        first = places[many[0]]
        want |= {(k, many[0]): (len(first), 1.0, 1.0, min(first.values()), min(first.values())) for k in many[1:]}
        for others in texts.values():
            if many[0] > others[0] and any(None not in (outlet[k], outlet[o]) and outlet[k] != outlet[o] for k in many for o in others):
                other = places[others[0]]
                both = first.keys() & other.keys()
                if max(len(both) / len(first), len(both) / len(other)) >= 0.5:
                    want[many[0], others[0]] = (len(both), len(both) / len(first), len(both) / len(other), min(first[p] for p in both), min(other[p] for p in both))
    assert len(want) > 300
    for block in (4, 1024):
        got = similarity.syndicated_bodies(frame, "k", "outlet", F.col("t"), own=True, block=block).collect()
        assert len(got) == len(want) and {(r.article, r.other): tuple(r)[2:] for r in got} == want


def test_lists_are_met_in_rounds(spark, monkeypatch):
    """Copies of vectors for a part of the lists alone lie on disk at a time; the neighbours are the same."""
    import numpy as np

    draw, seen, whole = np.random.default_rng(9), [], neighbors.Tables.write
    x = np.repeat(draw.normal(size=(30, 16)), 10, axis=0) + 0.5 * draw.normal(size=(300, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    monkeypatch.setattr(neighbors.Tables, "write", lambda self, frame, name: (seen.append(name), whole(self, frame, name))[1])
    once, parts = (sorted(tuple(r) for r in neighbors.ivf_neighbors(vectors, "k", "v", size=20, probes=6, rounds=n).collect()) for n in (1, 5))
    assert once == parts and len(once) > 1000 and seen.count("best") == 6
