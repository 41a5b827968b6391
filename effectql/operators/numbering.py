"""Consecutive numbers in a given order, without drawing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def numbered(rows: DataFrame, order: list[Column], name: str, top: int = 0) -> DataFrame:
    """``rows`` with ``name``: top + 1, top + 2 and so on, in order.

    Rows are dealt by ranges of ``order`` and sorted within; a range begins behind the count of those
    before it. The driver reads one count for each range. The dealt rows are checkpointed, as ranges are drawn
    anew each time they are computed, which the loss of an executor would bring about.
    """
    graph.shared_checkpoints(rows.sparkSession)
    dealt = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__range", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .checkpoint()
    )
    return _from_starts(dealt, F.col("__range"), F.col("__place"), name, top).drop("__range", "__place")


def _from_starts(rows: DataFrame, where: Column, place: Column, name: str, top: int) -> DataFrame:
    counts = {r["k"]: r["count"] for r in rows.groupBy(where.alias("k")).count().collect()}
    starts, at = {}, top + 1
    for k in sorted(counts):
        starts[k] = at
        at += counts[k]
    if not starts:
        return rows.withColumn(name, F.lit(top).cast("long"))
    first = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    return rows.withColumn(name, (first[where] + place).cast("long"))


def renumbered(rows: DataFrame, place: str, name: str, top: int = 0) -> DataFrame:
    """``rows`` with ``name``: top + 1, top + 2 and so on, in the order of ``place``, which all rows of a table were
    once given by monotonically_increasing_id. None is left out, so a partition begins behind the count of those before, and no row moves."""
    return _from_starts(rows, F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1), name, top)
