"""Print query trees as SQL text, for spark.sql and as an oracle for other engines."""

from __future__ import annotations

from typing import Any

from .ast import RANGES, Bool, Exists, Field, Node, Query
from .compile import LOWER, UPPER, _fold_text
from .model import Model, Spec, check, expanded, translated


def literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def fold(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def _list(values: list[Any]) -> str:
    return ", ".join(map(literal, values))


def _condition(node: Field, spec: Spec, alias: str) -> str:
    if spec.pair:
        op, v = (f"{alias}.{c}" for c in spec.pair)
        limit = int(node.value) + {"lt": -1, "gt": 1}.get(node.op, 0)
        if node.op in ("lt", "lte"):
            return f"({op} IN ('<=', '<') OR ({op} IN ('=', '==') AND {v} <= {limit}) OR ({op} = '>=' AND {v} <= {limit}) OR ({op} = '>' AND {v} < {limit}))"
        return f"({op} IN ('>=', '>') OR ({op} IN ('=', '==') AND {v} >= {limit}) OR ({op} = '<=' AND {v} >= {limit}) OR ({op} = '<' AND {v} > {limit}))"
    c = f"{alias}.{spec.column}"
    if node.op == "contains":
        return f"{fold(c)} LIKE {literal('%' + _fold_text(node.value) + '%')}"
    if node.op in ("in", "nin"):
        found = f"{c} IN ({_list(expanded(spec, list(node.value)))})"
        return found if node.op == "in" else f"({c} IS NULL OR NOT {found})"
    if node.op in RANGES:
        sign = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}[node.op]
        return f"{c} {sign} {literal(translated(spec, node.value))}"
    values = expanded(spec, [node.value])
    if node.op == "eq":
        return f"{c} = {literal(values[0])}" if len(values) == 1 else f"{c} IN ({_list(values)})"
    if spec.expand is not None:
        return f"({c} IS NOT NULL AND {c} NOT IN ({_list(values)}))"
    return f"{c} IS DISTINCT FROM {literal(values[0])}"


class Printer:
    def __init__(self, model: Model):
        self.model = model

    def _from(self, table: str) -> str:
        return f"({self.model.sql[table]})" if table in self.model.sql else table

    def where(self, node: Node, alias: str, depth: int = 0) -> str:
        if isinstance(node, Bool):
            below = [self.where(c, alias, depth) for c in node.children]
            return f"(NOT {below[0]})" if node.kind == "not" else "(" + f" {node.kind.upper()} ".join(below) + ")"
        key = self.model.key
        if isinstance(node, Exists):
            inner = f"p{depth}"
            asked = f" AND {self.where(node.where, inner, depth + 1)}" if node.where is not None else ""
            return f"EXISTS (SELECT 1 FROM {self._from(self.model.flat)} {inner} WHERE {inner}.{key} = {alias}.{key}{asked})"
        spec = self.model.spec(node.field)
        if spec.side is None:
            return _condition(node, spec, alias)
        inner = f"s{depth}"
        column = f"{inner}.{spec.column}"
        if node.op == "contains":
            hit = f"{fold(column)} LIKE {literal('%' + _fold_text(node.value) + '%')}"
        elif spec.like:
            hit = f"{fold(column)} LIKE {literal(_fold_text(node.value))}"
        else:
            hit = f"{column} = {literal(translated(spec, node.value))}"
        found = f"EXISTS (SELECT 1 FROM {self._from(spec.side)} {inner} WHERE {inner}.{key} = {alias}.{key} AND {hit})"
        return f"(NOT {found})" if node.op == "ne" else found

    def _matched(self, query: Query) -> str:
        check(query, self.model)
        asked = f" WHERE {self.where(query.where, 'c')}" if query.where is not None else ""
        return f"FROM {self._from(self.model.parent)} c{asked}"

    def page(self, query: Query) -> str:
        columns = ", ".join(f"c.{x}" for x in self.model.projection)
        order = f"{fold('c.' + self.model.order)} NULLS FIRST, c.{self.model.key}"
        return f"SELECT {columns} {self._matched(query)} ORDER BY {order} LIMIT {query.limit} OFFSET {max(0, query.offset)}"

    def keys(self, query: Query) -> str:
        return f"SELECT c.{self.model.key} {self._matched(query)}"

    def count(self, query: Query) -> str:
        return f"SELECT CAST(count(*) AS BIGINT) AS total {self._matched(query)}"
