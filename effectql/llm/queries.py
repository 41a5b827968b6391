"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "bpe", "chat", "media_tiff", "html_layout", "packing", "sharding", "quality", "ngram_join", "suffix_dedup", "vector_codes", "source_divergence", "embedding_dedup")


def _modules():
    return [import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
