"""Changes to tables as DataFrames: each function returns the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """For each key the row that comes last."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def merge_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """``incoming`` rows (unique by ``keys``) put over ``existing`` ones.

    A match takes the new values; of ``keep_if_null`` the old value where the new one is null, of
    ``keep`` always the old one. Both have the same columns.
    """
    a, b = existing.alias("a"), incoming.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, same, "full_outer")
    new = F.col(f"b.{keys[0]}").isNotNull()
    old = F.col(f"a.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys or c in keep_if_null:
            return F.coalesce(y, x)
        if c in keep:
            return F.when(old, x).otherwise(y)
        return F.when(new, y).otherwise(x)

    return joined.select(*(value(c).alias(c) for c in existing.columns))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is new; of several with a key the first by ``order``."""
    fresh = incoming
    if order is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        fresh = incoming.withColumn("__place", place).where("__place = 1").drop("__place")
    else:
        fresh = incoming.dropDuplicates(keys)
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def upsert_last(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert, or replace what has the key; the last of the incoming rows wins."""
    latest = last_wins(incoming, keys, order).select(*existing.columns)
    return existing.join(latest.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(latest)


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str, keys: list[str], parents: DataFrame | None = None) -> DataFrame:
    """Children of the parents that ``incoming`` (or ``parents``) names are replaced, those of others stay."""
    touched = (parents if parents is not None else incoming).select(parent).distinct()
    return existing.join(touched, parent, "left_anti").select(*existing.columns).unionByName(incoming.dropDuplicates(keys).select(*existing.columns))


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """``existing`` and new rows for keys it lacks (nulls are equal to nulls), numbered on from its largest id."""
    same = [existing[k].eqNullSafe(incoming[k]) for k in keys]
    fresh = incoming.dropDuplicates(keys).join(existing, same, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    new = numbered(fresh.drop(id_column), [F.col(k).asc_nulls_first() for k in keys], id_column, top)
    return existing.unionByName(new.withColumn(id_column, F.col(id_column).cast(existing.schema[id_column].dataType)).select(*existing.columns))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents, children[child_key] == parents[parent_key], "left_semi")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.where(F.col(child_key).isNotNull()).join(parents, children[child_key] == parents[parent_key], "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
