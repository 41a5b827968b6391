"""Pages far behind the first, without keeping all that stands before them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be kept to cut a page; pages that begin later are looked for first.
KEPT = 100_000
#: Sampled rows that part what is left into ranges, in each pass.
CUTS = 63


def _range(cuts: list[Column], low: int, high: int) -> Column:
    """How many of the sorted ``cuts`` lie before a row's ``__order``, found by halving those from ``low`` to ``high``."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(cuts[middle] < F.col("__order"), _range(cuts, middle + 1, high)).otherwise(_range(cuts, low, middle))


def page_at(rows: DataFrame, order: list[Column], offset: int, limit: int, kept: int | None = None) -> DataFrame:
    """``limit`` rows behind the first ``offset``, ordered by ``order`` (ascending, nulls first).

    Ranges between sampled rows are counted, and the one in which the page begins is parted again, until no more than
    ``kept`` rows (KEPT) stand between its beginning and the page's. The driver sees the samples and counts; then as
    many rows are kept as the last range asks for. The order must tell all rows apart; rows that it doesn't are never parted.
    ``rows`` is read once a pass: as often as the logarithm of the offset, to the base of some ranges.
    """
    columns, kept = rows.columns, KEPT if kept is None else kept
    left = rows.withColumn("__order", F.struct(*(c.alias(f"c{k}") for k, c in enumerate(order))))
    fields = left.schema["__order"].dataType.fields
    while offset > kept:
        drawn = left.select("__order").orderBy(F.xxhash64("__order")).limit(CUTS).distinct().orderBy("__order").collect()
        cuts = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["__order"], fields, strict=True))) for r in drawn]
        counts = sorted((r["__range"], r["count"]) for r in left.groupBy(_range(cuts, 0, len(cuts)).alias("__range")).count().collect())
        ends = list(itertools.accumulate(n for _, n in counts))
        first = next((k for k, end in enumerate(ends) if end > offset), None)
        if first is None:
            return rows.limit(0)
        last = next((k for k, end in enumerate(ends) if end >= offset + limit), len(ends) - 1)
        if (first, last) == (0, len(ends) - 1):
            break  # what is left can't be parted
        low, high = counts[first][0], counts[last][0]
        if low > 0:
            left = left.where(F.col("__order") > cuts[low - 1])
        if high < len(cuts):
            left = left.where(F.col("__order") <= cuts[high])
        offset -= ends[first] - counts[first][1]
    return left.orderBy("__order").offset(offset).limit(limit).select(*columns)
