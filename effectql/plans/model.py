"""Entity models: what a query can ask, as data.

A model has a parent table, side tables (one to many, asked for existence) and a hierarchy of units,
clauses and predicates below the parent, joined into one flat table. The compilers know nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .ast import RANGES, Bool, Exists, Field, Node, Query, QueryError, walk


@dataclass(frozen=True)
class Spec:
    """A field: where it lies (parent, side, clause, predicate), its column and what values it takes."""

    name: str
    store: str
    column: str | None = None
    kind: str = "text"  # text, enum, int, number
    allowed: tuple[str, ...] = ()
    pair: tuple[str, str] | None = None  # op and value columns of a stored bound
    side: str | None = None  # side table
    like: bool = False  # side tables: compare by pattern without case
    expand: dict[str, tuple[str, ...]] | None = None  # values that stand for several


@dataclass(frozen=True)
class Model:
    name: str
    parent: str
    key: str
    order: str
    projection: tuple[str, ...]
    fields: dict[str, Spec]
    flat: str = "flat"
    unit: str = "unit_id"
    aliases: dict[str, str] = field(default_factory=dict)
    #: SQL of tables that are joins of others, for the printed form.
    sql: dict[str, str] = field(default_factory=dict)
    load: Callable[..., dict[str, DataFrame]] | None = None

    def spec(self, name: str) -> Spec:
        found = self.fields.get(self.aliases.get(name, name))
        if found is None:
            raise QueryError(f"no such field: {name}")
        return found


def check(query: Query, model: Model) -> Query:
    """The query, once scope, ops and values are known to be right."""
    _check(query.where, model, False)
    return query


def _check(node: Node | None, model: Model, inside: bool) -> None:
    if isinstance(node, Exists):
        _check(node.where, model, True)
    elif isinstance(node, Bool):
        for child in node.children:
            _check(child, model, inside)
    elif isinstance(node, Field):
        spec = model.spec(node.field)
        low = spec.store in ("clause", "predicate")
        if low and not inside:
            raise QueryError(f"{node.field} must stand inside an exists block")
        if not low and inside:
            raise QueryError(f"{node.field} must stand outside of exists blocks")
        _check_value(node, spec)


def _check_value(node: Field, spec: Spec) -> None:
    op, value = node.op, node.value
    if spec.pair and op not in RANGES:
        raise QueryError(f"{node.field} is a bound: it takes {', '.join(RANGES)}, not {op}")
    if spec.side and op not in ("eq", "ne", "contains"):
        raise QueryError(f"{node.field} takes eq, ne and contains, not {op}")
    if op == "contains":
        if spec.kind not in ("text", "enum") or not isinstance(value, str) or not value:
            raise QueryError(f"{node.field}: contains needs text")
        return
    for v in value if op in ("in", "nin") else [value]:
        if spec.kind in ("int", "number"):
            if isinstance(v, bool) or not isinstance(v, int | float) or spec.kind == "int" and not spec.pair and isinstance(v, float) and v != int(v):
                raise QueryError(f"{node.field}: {v!r} is not a number")
        elif not isinstance(v, str):
            raise QueryError(f"{node.field}: {v!r} is not text")
        elif spec.allowed and op not in RANGES and v.upper() not in spec.allowed and v not in spec.allowed:
            raise QueryError(f"{node.field}: {v!r} is not one of {', '.join(spec.allowed)}")


def translated(spec: Spec, value: Any) -> Any:
    """A value in the case its field stores."""
    if spec.kind == "enum" and isinstance(value, str) and value not in spec.allowed and value.upper() in spec.allowed:
        return value.upper()
    return value


def expanded(spec: Spec, values: list[Any]) -> list[Any]:
    out: list[Any] = []
    for v in (translated(spec, v) for v in values):
        out += [x for x in (spec.expand or {}).get(v, (v,)) if x not in out]
    return out


def like_pattern(text: str) -> str:
    """A pattern for LIKE without escape: % and _ stay wildcards, a backslash is itself."""
    return text.replace("\\", "\\\\")


def blocks(node: Node | None) -> list[Exists]:
    return [n for n in walk(node) if isinstance(n, Exists)]
