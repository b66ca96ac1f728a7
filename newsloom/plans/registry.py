"""All registered queries; importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import article_plans, brief_plans, desk_plans, page_plans, prose_plans, source_plans, story_plans, stream_plans  # noqa: F401
from newsloom.plans.catalog import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each outlet domain: distinct articles, open ones and the best headline."""
    return QUERIES["flagship_outlet_headlines"](spark, sf_dir)
