"""Search: a page of hits with total, archetypes and evidence, as one nested table or as a document."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_checkpoints
from .ast import Exists, Query, QueryError, walk
from .cards import MODEL
from .compile import Compiler, fold

_PREDICATE = [
    "subject", "action", "action_known", "source_zone", "destination_zone", "object_count", "object_count_op", "object_card_type", "object_race", "object_attribute",
    "object_archetype", "object_name", "object_level_op", "object_level_value", "object_rank_op", "object_rank_value", "object_link_op", "object_link_value",
    "object_atk_op", "object_atk_value", "object_def_op", "object_def_value", "object_tags", "result_ref", "object_ref", "modifiers_json", "confidence",
    "extracted_by", "source_text",
]

#: Rows of a page at most that the driver holds and broadcasts.
LOOKED_AT = 10_000


class Searcher:
    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.compiler = Compiler(MODEL, tables, spread=True)

    def count(self, query: Query) -> int:
        return self.compiler.count(query).first()[0]

    def hits(self, query: Query, evidence: bool = True, mode: str = "all") -> DataFrame:
        """The page: a row for each hit with archetypes and, for queries with blocks, matched_effects.

        The page is cut first, so that everything else is joined to its few cards only. Nothing is broadcast but the page.
        """
        found = self.compiler.page(query)
        # its rows are asked for once; all that follows is joined to them. A page that no one looks at stays off the driver
        if query.limit <= LOOKED_AT:
            page = found.sparkSession.createDataFrame(found.collect(), found.schema)
        else:
            shared_checkpoints(found.sparkSession)
            page = found.checkpoint()
        cards = page.select("card_id").hint("broadcast" if query.limit <= LOOKED_AT else "merge")
        side = self.tables["card_archetype"].join(cards, "card_id", "left_semi")
        lists = side.groupBy("card_id").agg(F.sort_array(F.collect_list("archetype")).alias("archetypes"))
        rows = page.join(lists.hint("merge"), "card_id", "left")
        if evidence and any(isinstance(n, Exists) for n in walk(query.where)):
            shown = self.compiler.evidence(query, cards, mode)
            units = shown.select("unit_id").distinct()
            flat = self.tables["effect_flat"].join(cards, "card_id", "left_semi").join(units.hint("merge"), "unit_id", "left_semi")
            predicates = flat.groupBy("unit_id").agg(
                F.sort_array(F.collect_list(F.struct("clause_index", "pred_index", "role", "clause_text", "once_per_turn", *_PREDICATE))).alias("predicates")
            )
            unit = self.tables["effect_unit"].join(cards, "card_id", "left_semi").join(predicates.hint("merge"), "unit_id")
            effects = unit.groupBy("card_id").agg(
                F.sort_array(F.collect_list(F.struct("unit_index", "scope", "kind", "marker", "sub_index", "unit_text", "parse_status", "predicates"))).alias("matched_effects")
            )
            rows = rows.join(effects.hint("merge"), "card_id", "left")
        return rows.orderBy(fold(F.col("canonical_name")).asc_nulls_first(), "card_id")

    def search(self, query: Query, limit: int | None = None, evidence: bool = True, mode: str = "all") -> dict[str, Any]:
        """{total, returned, hits}; the total is independent of limit and offset."""
        if limit is not None:
            query = replace(query, limit=limit)
        hits = [r.asDict(recursive=True) for r in self.hits(query, evidence, mode).collect()]
        for hit in hits:
            hit["archetypes"] = hit["archetypes"] or []
            if not hit.get("matched_effects"):
                hit.pop("matched_effects", None)
        return {"total": self.count(query), "returned": len(hits), "hits": hits}

    def effects(self, query: Query) -> DataFrame:
        """Matched units of the query's page, one row each."""
        hits = self.hits(query)
        if "matched_effects" not in hits.columns:
            raise QueryError("the query asks for no effect")
        return hits.select("card_id", "canonical_name", F.explode("matched_effects").alias("effect")).select("card_id", "canonical_name", "effect.*")
