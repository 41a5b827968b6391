"""The card model: cards with side tables, and their effects as units, clauses and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import vocab as V
from .model import Model, Spec

_EXPAND = {"SPELL": ("SPELL", "SPELL_TRAP"), "TRAP": ("TRAP", "SPELL_TRAP")}
_RACES, _ATTRIBUTES = tuple(V.RACES), tuple(V.ATTRIBUTES)


def _specs() -> list[Spec]:
    card = lambda n, kind="text", allowed=(): Spec(f"card.{n}", "parent", n, kind, tuple(allowed))
    effect = lambda n, kind="text", allowed=(), **m: Spec(f"effect.{n}", "predicate", n, kind, tuple(allowed), **m)
    bound = lambda n, c: Spec(f"effect.object_{n}", "predicate", kind="int", pair=(f"object_{c}_op", f"object_{c}_value"))
    return [
        card("card_id", "int"), card("canonical_name"), card("card_category", "enum", V.CATEGORIES), card("sub_category", "enum", V.SUB_CATEGORIES),
        card("race", "enum", _RACES), card("attribute", "enum", _ATTRIBUTES), card("level_rank", "int"), card("link_rating", "int"),
        card("pendulum_scale", "int"), card("atk", "int"), card("def", "int"),
        Spec("card.archetype", "side", "archetype", side="card_archetype"), Spec("card.flag", "side", "flag", "enum", side="card_flag"),
        Spec("card.name", "side", "name", side="card_name", like=True),
        Spec("clause.role", "clause", "role", "enum", tuple(V.ROLES)), Spec("clause.once_per_turn", "clause", "once_per_turn", "enum", V.TRI),
        Spec("clause.confidence", "clause", "clause_confidence", "number"),
        effect("subject", "enum", V.SUBJECTS), effect("action", "enum", V.ACTIONS), effect("source_zone", "enum", V.ZONES),
        effect("destination_zone", "enum", V.ZONES), effect("object_race", "enum", _RACES), effect("object_attribute", "enum", _ATTRIBUTES),
        effect("object_card_type", "enum", V.OBJECT_TYPES, expand=_EXPAND), effect("object_archetype"), effect("object_name"), effect("result_ref"),
        effect("object_ref"), effect("extracted_by", "enum", V.EXTRACTED_BY), effect("action_known", "int"), effect("object_count", "int"),
        effect("confidence", "number"), bound("level", "level"), bound("rank", "rank"), bound("link_rating", "link"), bound("atk", "atk"), bound("defense", "def"),
    ]


MODEL = Model(
    name="cards", parent="card", key="card_id", order="canonical_name",
    projection=("card_id", "canonical_name", "card_category", "sub_category", "race", "attribute", "level_rank", "link_rating", "pendulum_scale", "atk", "def"),
    fields={s.name: s for s in _specs()}, flat="effect_flat",
    aliases={
        "card.level": "card.level_rank", "card.rank": "card.level_rank", "card.type": "card.card_category", "card.link": "card.link_rating",
        "card.scale": "card.pendulum_scale", "effect.race": "effect.object_race", "effect.attribute": "effect.object_attribute",
        "effect.level": "effect.object_level", "effect.rank": "effect.object_rank", "effect.atk": "effect.object_atk",
        "effect.archetype": "effect.object_archetype", "effect.card_type": "effect.object_card_type", "effect.part": "clause.role", "effect.target_race": "effect.object_race",
    },
)


def flat(unit: DataFrame, clause: DataFrame, predicate: DataFrame) -> DataFrame:
    """The hierarchy as one table, a row for each predicate with its clause and unit. None of the three is broadcast."""
    return (
        predicate.join(clause.drop("card_id").hint("merge"), ["unit_id", "clause_id"]).join(unit.drop("card_id").hint("merge"), "unit_id")
    )


def tables(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What the compiler reads, from the tables of a store. A flat table that is stored is not joined anew."""
    out = {n: stored[n] for n in ("card", "card_archetype", "card_flag", "card_name", "effect_unit")}
    out["effect_flat"] = stored["effect_flat"] if "effect_flat" in stored else flat(stored["effect_unit"], stored["effect_clause"], stored["effect_predicate"])
    return out
