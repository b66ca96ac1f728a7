"""Text columns against row-at-a-time Python over random texts, on edge rows and on long texts."""

import html
import random
import re

from pyspark.sql import functions as F

from newsloom.functions import pages as PG
from newsloom.functions import prose as R
from newsloom.functions import text as T

ATOMS = [
    "&amp;", "&lt", "&copyright", "&notit;", "&#128;", "&#x1F600;", "&#0;", "&#xD800;", "&nosuch;", "&#99999999999;", "&eacute;", "&#13;", "&#xFEFF;", "<b>", "</p>", "a < b", " ", "\xa0", "Dr. ", " Mr.", "A", "B. ", "it ended.", " The",
    ' "We go."', '"', " said so.", "“open", "close”", " (Photo", "picture: a b.", "(picture of x)", "!", "? ", "words by Jane Doe.", "\n", "more on this: ", "é", " ;", "3.5", "U.S. ",
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_random_texts_in_both_forms(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(ATOMS) for _ in range(draw.randint(0, 40))) for _ in range(1500)] + ["", None, "x", " ", "."]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", R.plain_text(t).alias("plain"), R.sanitized(t, PG.RULES.fragments).alias("clean"), R.sentences(t).alias("sentences")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.plain == re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", r.t or ""))).strip(), r.t
        assert (r.clean, r.sentences) == (PG.sanitize(r.t or ""), PG.split_sentences(r.t)), r.t


def test_narrative_sentences(spark):
    twice, other = "The council voted on the new bridge over the river on Monday evening.", "Farmers along the coast waited for rain through a long and dusty summer."
    again = "The council voted on the new bridge over the river on Tuesday evening."
    text = f"{twice} {twice} Too short. Write to our mailing list for more of what the council does every week. {other} {again} {other}"
    assert one(spark, R.narrative_sentences(F.lit(text))) == [twice, other]
    assert one(spark, R.narrative_sentences(F.lit(text), similar=1.1, overlap=1.1)) == [twice, other, again]
    assert one(spark, R.narrative_sentences(F.lit(None).cast("string"))) == [] and one(spark, R.narrative_sentences(F.lit(""))) == []


def test_states_over_blocks(spark):
    for n in (0, 1, 255, 256, 257, 70_000):
        sums = R.running(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), F.lit(0).cast("long"), lambda s, x: s + x)
        got = one(spark, F.struct(F.size(sums).alias("n"), F.element_at(F.concat(F.array(F.lit(0).cast("long")), sums), -1).alias("last")))
        assert (got.n, got["last"]) == (n, n * (n + 1) // 2)


def test_long_texts(spark):
    piece = 'The council met today &amp; left. He said "no. Not" twice. '
    frame = spark.createDataFrame([(piece * 15_000,)], "t string")
    t = F.col("t")
    got = frame.select(F.length(R.plain_text(t)).alias("plain"), F.length(R.sanitized(t, PG.RULES.fragments)).alias("clean"), F.size(R.sentences(t)).alias("n")).first()
    assert got.n == 30_000 and got.clean == 15_000 * len(piece) - 1 and got.plain == 15_000 * (len(piece) - 4) - 1


def test_nested_fragments_go(spark):
    text = "((picture one) picture (credit two)) it stayed ."
    assert one(spark, R.sanitized(F.lit(text), PG.RULES.fragments)) == PG.sanitize(text)
    assert one(spark, R.sanitized(F.lit("aaaaaaaaab"), ["^a"])) == "b"


def test_patterns_read_from_the_end_agree_with_those_that_are_searched_for(spark):
    draw = random.Random(11)
    parts = ["Mr", "Prof", "No", "xMr", "U.S", "A", "é", ".", "!", '"', "”", ")", " ", "  ", "\t", " ", "  ", "to", "of x", "Ann B", "a'", "word", "\n", ".\"", " to ab."]
    rows = [("".join(draw.choice(parts) for _ in range(draw.randrange(1, 9))),) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "t string").withColumn("line", F.regexp_replace("t", "\n", ""))
    like = lambda c, p: F.rlike(c, F.lit(p))
    line, back = F.col("line"), F.reverse(F.col("line"))
    stump = "(?i)^[^a-z']*[a-z']{1,2}[^a-z']"
    got = frame.select(
        (like(line, R.SHORT) == like(back, R.SHORT_BACK)) & (like(line, R.QUOTED) == like(back, R.QUOTED_BACK)) & (~like(line, T.STUMP) | like(back, stump)),
        R.flat(F.col("t")) == F.trim(F.regexp_replace("t", R.BLANKS, " ")), T.squeeze(F.col("t")) == F.trim(F.regexp_replace("t", r"\s+", " ")), like(line, R.SHORT), like(line, R.QUOTED), like(line, T.STUMP),
    ).collect()
    assert all(r[0] and r[1] and r[2] for r in got) and all(10 < sum(r[i] for r in got) < 3900 for i in (3, 4, 5))
