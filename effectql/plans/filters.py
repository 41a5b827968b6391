"""Compact filters: field=value and the like, to a query."""

from __future__ import annotations

import re

from .ast import Exists, Field, Query, QueryError, all_of
from .cards import MODEL
from .model import Model

_FILTER = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*)\s*(<=|>=|!=|=~|=|<|>)\s*(.+)", re.DOTALL)
_OPS = {"=": "eq", "!=": "ne", "=~": "contains", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def _number(name: str, text: str) -> int | float:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    raise QueryError(f"{name}: {text!r} is not a number")


def parse_filter(expression: str, model: Model = MODEL) -> Field:
    """A condition; a bare name is a field of the card, and the field says how the value is read."""
    m = _FILTER.fullmatch(expression.strip())
    if m is None:
        raise QueryError(f"can't read filter {expression!r}: it takes the form field=value")
    name = m[1] if "." in m[1] else f"card.{m[1]}"
    name = model.aliases.get(name, name)
    spec = model.spec(name)
    op, text = _OPS[m[2]], m[3].strip().strip("'\"")
    if op == "contains":
        return Field(name, op, text)
    if spec.kind in ("int", "number") or op in ("lt", "lte", "gt", "gte") and spec.kind != "enum":
        return Field(name, op, _number(name, text))
    if spec.kind == "enum":
        text = next((a for a in spec.allowed if a == text or a == text.upper()), text.upper())
    return Field(name, op, text)


def parse_filters(expressions: list[str], model: Model = MODEL, limit: int = 50) -> Query:
    """All filters at once; those of effects and clauses form one block."""
    found = [parse_filter(e, model) for e in expressions]
    low = [f for f in found if model.spec(f.field).store in ("clause", "predicate")]
    nodes = [f for f in found if f not in low]
    if low:
        nodes.append(Exists(all_of(*low)))
    return Query(all_of(*nodes) if nodes else None, limit=limit)
