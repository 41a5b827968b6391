"""Aggregates of the engine."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_max(rows: DataFrame, key: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """The largest value of each kind, a column for each."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds))


def collisions(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more than one name (without case), and their names in order."""
    return (
        rows.groupBy(key).agg(F.sort_array(F.collect_set(F.lower(name))).alias("names")).where(F.size("names") > 1)
    )


def collided(rows: DataFrame, key: str, name: str) -> int:
    """How many keys ``collisions`` gives, by hash aggregates that hold no sets."""
    named = rows.select(key, F.lower(name).alias("__name")).repartition(key).distinct()
    return named.groupBy(key).agg(F.count("__name").alias("__n")).where("__n > 1").count()


def aliases(rows: DataFrame, alias: str, name: str) -> DataFrame:
    """Names by the alias they share; null and 0 are no alias."""
    return rows.where(F.col(alias).isNotNull() & (F.col(alias) != 0)).groupBy(alias).agg(F.sort_array(F.collect_list(name)).alias("names"))


def conditional_counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return rows.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def metrics(**counted: DataFrame) -> DataFrame:
    """(metric, value) of tables with one row and one column each."""
    rows = [df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("long").alias("value")) for name, df in counted.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def status(rows: DataFrame, key: str, needed: Column, resolved: Column) -> DataFrame:
    """OK where all needed rows are resolved, PARTIAL where some are, else UNRESOLVED."""
    found = rows.groupBy(key).agg(F.count_if(needed).alias("needed"), F.count_if(needed & resolved).alias("resolved"))
    return found.withColumn(
        "status", F.when(F.col("resolved") == 0, "UNRESOLVED").when(F.col("resolved") == F.col("needed"), "OK").otherwise("PARTIAL")
    )
