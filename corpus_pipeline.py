"""From documents to balanced shards in five stages; each is written as Parquet and read again by the next.

quality: documents that the quality ranking rejects go. ngram_join: one document of each near-duplicate group stays.
decontaminate: documents that hold benchmark passages go. mix: documents are sampled so that source, language and topic
meet their target weights. shards: what is left is put into 40 shards of near-equal bytes.

Defined cases: null and empty texts score like any other, are never near-duplicates or contaminated, and go or stay by their quality and cell;
rows that share an id are judged each by its own text; rows with a null id stay unless their quality, contamination or cell drops them;
repeated equal rows with an id become one in the n-gram join, if they have words; an empty table gives no rows; extra columns, whatever their
names, pass through all stages but the last, which has columns of its own. Names that start with ``__nl_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import contamination, mixing, ngram_join, quality, sharding, store

#: Training a ranking and drawing a sample are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranking = quality.fit(docs, store.table(spark, sf_dir, "labels"))
    names = (f"{store.RESERVED}score", f"{store.RESERVED}predicted")
    return quality.score(docs, ranking, keep_text=True, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, contamination.pattern_blocks(store.table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [("quality", rank_quality), ("ngram_join", join_ngrams), ("decontaminate", decontaminate), ("mix", mix_sources), ("shards", cut_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.durable(docs, name)
    return docs.select(*(F.col(c) for c in docs.columns))
