"""Input tables, written tables and reserved names of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.scratch import Tables, durable, new_path, shared_folder

__all__ = ["RESERVED", "Tables", "durable", "new_path", "shared_folder", "table"]

#: Columns that operators add beside those passed through start like this; no input column may.
RESERVED = "__nl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
