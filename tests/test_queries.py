"""Every query of the library against its DuckDB text, and the physical plans against row-at-a-time Python and cross products."""

import random

import pytest

from newsloom.operators import briefs
from newsloom.plans import registry
from tests.oracle import assert_same, connection

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    frame = QUERIES[name](spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    result = frame.toPandas()
    if name in ORACLES:
        assert_same(result, connection(small).sql(ORACLES[name]).df())
    else:
        assert len(result)


def test_every_story_item_once(spark, small):
    rows = QUERIES["f3_build_stories"](spark, small).toPandas()
    assert rows.article_id.is_unique and set(rows.article_id) == set(range(len(rows)))


def test_sources_of_large_stories_are_all_compared(spark):
    draw = random.Random(5)
    words = [f"word{i}" for i in range(14)]
    rows = [(s, i, (i * 37) % 50, " ".join(draw.sample(words, draw.choice([0, 1, 7, 8, 9, 10, 11])))) for s, n in ((1, 150), (2, 90), (3, 5)) for i in range(n)]
    rows += [(4, i, i, f"only{i} text{i} here{i}") for i in range(100)]
    want = set()
    for story in (1, 2, 3, 4):
        sets = []
        for _, i, _, text in sorted((r for r in rows if r[0] == story), key=lambda r: (r[2], r[1])):
            t = set(text.split())
            if not any(t and u and len(t & u) / max(len(t), len(u)) >= 0.72 for u in sets):
                want.add((story, i))
                sets.append(t)
    got = briefs.dedupe_sources(spark.createDataFrame(rows, "story_id long, article_id long, rank long, summary string")).collect()
    assert sorted((r.story_id, r.article_id) for r in got) == sorted(want)


def test_entry():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["f8_story_summary", "g7_refresh_story"])
def test_only_the_sentences_of_an_excerpt_move_to_their_story(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    cut = [i for i, line in enumerate(plan) if "AS _excerpt" in line]
    assert cut and any("Join" in line for line in plan[: cut[0]])
