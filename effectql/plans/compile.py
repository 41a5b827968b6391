"""Compile query trees to DataFrames: semi, anti and mark joins, and columns for all the rest."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import paging
from .ast import RANGES, Bool, Exists, Field, Node, Query
from .model import Model, Spec, check, expanded, like_pattern, translated

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(column: Column) -> Column:
    """ASCII letters in lower case; no other letter changes."""
    return F.translate(column, UPPER, LOWER)


def _fold_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def bound(op: str, value: float, stored_op: Column, stored: Column) -> Column:
    """Whether some number fulfils both the stored bound and the asked one (``op`` ``value``), over integers."""
    limit = int(value) + {"lt": -1, "gt": 1}.get(op, 0)
    exact = stored_op.isin("=", "==")
    if op in ("lt", "lte"):
        free, same, strict, inside = ("<=", "<"), ">=", ">", operator.le
        beyond = operator.lt
    else:
        free, same, strict, inside = (">=", ">"), "<=", "<", operator.ge
        beyond = operator.gt
    return (
        stored_op.isin(*free)
        | ((exact | (stored_op == same)) & inside(stored, F.lit(limit)))
        | ((stored_op == strict) & beyond(stored, F.lit(limit)))
    )


def condition(node: Field, spec: Spec) -> Column:
    """A field condition on a plain column, with the null rules of each op."""
    if spec.pair:
        return bound(node.op, node.value, F.col(spec.pair[0]), F.col(spec.pair[1]))
    column = F.col(spec.column)
    if node.op == "contains":
        return fold(column).like(_fold_text(f"%{like_pattern(node.value)}%"))
    if node.op in ("in", "nin"):
        found = column.isin(*expanded(spec, list(node.value)))
        return found if node.op == "in" else column.isNull() | ~found
    if node.op in RANGES:
        ops = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
        return ops[node.op](column, F.lit(translated(spec, node.value)))
    values = expanded(spec, [node.value])
    if node.op == "eq":
        return column == F.lit(values[0]) if len(values) == 1 else column.isin(*values)
    if spec.expand is not None:
        return column.isNotNull() & ~column.isin(*values)
    return ~column.eqNullSafe(F.lit(values[0]))


class Compiler:
    """Compiles for one model over its tables (parent, sides and the flat hierarchy, by name).

    With ``spread`` the keys that a block or side condition finds, of which there may be as many as entities, are
    never broadcast, whatever Spark takes their number for.
    """

    def __init__(self, model: Model, tables: dict[str, DataFrame], spread: bool = False):
        self.model, self.tables, self.spread = model, tables, spread

    # -- keys of entities that fulfil a leaf

    def side_keys(self, node: Field, spec: Spec) -> DataFrame:
        """Keys with a row in the side table; for ne, those that will be left out."""
        value = F.col(spec.column)
        if node.op == "contains":
            hit = fold(value).like(_fold_text(f"%{like_pattern(node.value)}%"))
        elif spec.like:
            hit = fold(value).like(_fold_text(like_pattern(node.value)))
        else:
            hit = value == F.lit(translated(spec, node.value))
        return self.tables[spec.side].where(hit).select(self.model.key)

    def block_rows(self, node: Exists) -> DataFrame:
        """Rows of the flat hierarchy that fulfil a block; blocks inside it are asked of the entity first."""
        flat = self.tables[self.model.flat]
        return flat if node.where is None else self._filter(flat, node.where)

    def keys(self, node: Node) -> DataFrame:
        return self.block_rows(node).select(self.model.key) if isinstance(node, Exists) else self.side_keys(node, self.model.spec(node.field))

    def _spread(self, keys: DataFrame) -> DataFrame:
        return keys.hint("merge") if self.spread else keys

    def _is_join(self, node: Node) -> bool:
        return isinstance(node, Exists) or isinstance(node, Field) and self.model.spec(node.field).side is not None

    def _filter(self, rows: DataFrame, node: Node) -> DataFrame:
        """``rows`` (which have the model's key) that fulfil ``node``."""
        key = self.model.key
        if isinstance(node, Bool) and node.kind == "and":
            return functools.reduce(self._filter, node.children, rows)
        inner, kept = node, True
        while isinstance(inner, Bool) and inner.kind == "not":
            inner, kept = inner.children[0], not kept
        if self._is_join(inner):
            if isinstance(inner, Field) and inner.op == "ne":
                kept = not kept
            return rows.join(self._spread(self.keys(inner)), key, "left_semi" if kept else "left_anti")
        marks: dict[str, DataFrame] = {}
        column = self._column(node, marks)
        for name, keys in marks.items():
            rows = rows.join(self._spread(keys.distinct().withColumn(name, F.lit(True))), key, "left")
        return rows.where(column).drop(*marks)

    def _column(self, node: Node, marks: dict[str, DataFrame]) -> Column:
        if isinstance(node, Bool):
            below = [self._column(c, marks) for c in node.children]
            if node.kind == "not":
                return ~below[0]
            return functools.reduce(operator.and_ if node.kind == "and" else operator.or_, below)
        if self._is_join(node):
            name = f"__mark{len(marks)}"
            marks[name] = self.keys(node)
            found = F.coalesce(F.col(name), F.lit(False))
            return ~found if isinstance(node, Field) and node.op == "ne" else found
        return condition(node, self.model.spec(node.field))

    # -- results

    def matched(self, query: Query) -> DataFrame:
        """All parent rows that fulfil the query."""
        check(query, self.model)
        parent = self.tables[self.model.parent]
        return parent if query.where is None else self._filter(parent, query.where)

    def page(self, query: Query) -> DataFrame:
        """The query's page, ordered by the name without case, and by the key where names are equal."""
        rows = self.matched(query).select(*self.model.projection)
        offset = max(0, query.offset)
        if offset > paging.KEPT:
            return paging.page_at(rows, [fold(F.col(self.model.order)), F.col(self.model.key)], offset, query.limit)
        ordered = rows.orderBy(fold(F.col(self.model.order)).asc_nulls_first(), self.model.key)
        return ordered.offset(offset).limit(query.limit)

    def count(self, query: Query) -> DataFrame:
        return self.matched(query).agg(F.count(F.lit(1)).alias("total"))

    def evidence(self, query: Query, keys: DataFrame, mode: str = "all") -> DataFrame:
        """Rows of the hierarchy that show why ``keys`` match.

        ``all``: rows that fulfil every block of the query at once. ``any``: rows that fulfil one block
        or more. Without blocks all rows of the keys.
        """
        from .model import blocks

        rows = self.tables[self.model.flat].join(keys.select(self.model.key), self.model.key, "left_semi")
        asked = [b.where for b in blocks(query.where) if b.where is not None]
        if not asked:
            return rows
        return self._filter(rows, asked[0] if len(asked) == 1 else Bool("and" if mode == "all" else "or", tuple(asked)))


Loader = Callable[..., dict[str, DataFrame]]
