"""Merging tables by key: upserts, child replacement, pruning, set operations and rule checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_discoveries(items: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key is not stored, one row a key (repeats in the batch are folded)."""
    return items.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert_by_key(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the incoming rows in place of those of equal key."""
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def replace_children(child: DataFrame, new_rows: DataFrame, parent_key: str) -> DataFrame:
    """Child rows of untouched parents, and all new rows."""
    return child.join(new_rows.select(parent_key), parent_key, "left_anti").unionByName(new_rows)


def prune_children(stored: DataFrame, wanted: DataFrame, parent_key: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): of touched parents only the wanted rows stay."""
    touched = stored.join(wanted.select(parent_key), parent_key, "left_semi")
    deleted = touched.join(wanted.select(*keys), keys, "left_anti")
    return stored.join(deleted.select(*keys), keys, "left_anti"), deleted


def retire_stale(stories: DataFrame, current: DataFrame, key: str, live: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): live stories that the current batch lacks are removed."""
    removed = stories.where(live).join(current.select(key), key, "left_anti")
    return stories.join(removed.select(key), key, "left_anti"), removed


def last_by_key(items: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row a key, the last in sequence: an aggregate, so a hot key is folded before the shuffle."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_last")).select(key, "_last.*").select(*items.columns)


def stored_not_wanted(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return stored.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti")


def preview_merge(by_id: DataFrame, by_slug: DataFrame, keys: list[str]) -> DataFrame:
    return by_id.unionByName(by_slug).dropDuplicates(keys)


def constraint_violations(table: DataFrame, allowed: dict[str, list], unique: list[list[str]], one_current: tuple[str, str] | None = None) -> DataFrame:
    """(rule, key, rows): values outside an enum, repeated unique keys, and parents with more than one current row."""
    found = [table.where(~F.col(c).isin(values)).groupBy(F.col(c).cast("string").alias("key")).count().select(F.lit(f"enum:{c}").alias("rule"), "key", F.col("count").alias("rows")) for c, values in allowed.items()]
    for keys in unique:
        found.append(table.groupBy(*keys).count().where("count > 1").select(F.lit("unique:" + ",".join(keys)).alias("rule"), F.concat_ws(",", *keys).alias("key"), F.col("count").alias("rows")))
    if one_current:
        parent, flag = one_current
        found.append(table.where(F.col(flag)).groupBy(parent).count().where("count > 1").select(F.lit(f"current:{parent}").alias("rule"), F.col(parent).cast("string").alias("key"), F.col("count").alias("rows")))
    return reduce(DataFrame.unionByName, found)
