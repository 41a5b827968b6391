"""Upstream rows to normalised records: one row for each card, children as arrays of structs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V

RECORD = (
    "canonical_name", "card_category", "sub_category", "race", "attribute", "level_rank", "link_rating", "pendulum_scale", "atk", "def",
    "type_mask", "race_mask", "attribute_mask", "category_mask", "setcode_mask", "alias_passcode", "text_lang", "raw_text",
    "external_ids", "archetypes", "flags", "names", "identity_key", "payload_json", "external_id",
)
_NAMES = "array<struct<lang: string, name: string, name_kind: string, is_primary: int>>"


def _payload(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def _external(*pairs: tuple[str, Column]) -> Column:
    made = [F.when(v.isNotNull(), F.struct(F.lit(s).alias("source"), v.cast("string").alias("external_id"))) for s, v in pairs]
    return F.array_compact(F.array(*made))


def from_cdb(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records, and the rows without a category (row as JSON, reason)."""
    c = F.col
    payload = _payload(rows)
    category = S.decode_category(c("type"))
    monster = category == "MONSTER"
    sub = S.decode_sub_category(c("type"), category)
    link = sub == "LINK"
    codes = S.decode_setcode(c("setcode"))
    wide = rows.withColumn("payload_json", payload).withColumn("card_category", category)
    good = wide.where("card_category is not null").select(
        F.trim(F.coalesce("name", F.lit(""))).alias("canonical_name"), "card_category", sub.alias("sub_category"),
        F.when(monster, S.decode_race(c("race"))).alias("race"), F.when(monster, S.decode_attribute(c("attribute"))).alias("attribute"),
        F.when(monster, S.decode_level(c("level"))).alias("level_rank"), S.decode_link_rating(c("level"), link).alias("link_rating"),
        F.when(monster, S.decode_scale(c("level"))).alias("pendulum_scale"), c("atk"), F.when(~link, c("def")).alias("def"),
        c("type").alias("type_mask"), c("race").alias("race_mask"), c("attribute").alias("attribute_mask"), c("category").alias("category_mask"),
        c("setcode").alias("setcode_mask"), S.zero_to_null(c("alias")).alias("alias_passcode"), F.lit("en").alias("text_lang"),
        F.trim(F.coalesce("desc", F.lit(""))).alias("raw_text"), _external(("passcode", c("id"))).alias("external_ids"),
        F.transform(codes, lambda x: F.struct(F.concat(F.lit("setcode-"), x).alias("archetype"), x.alias("archetype_raw"))).alias("archetypes"),
        S.decode_flags(c("type")).alias("flags"), F.lit(None).cast(_NAMES).alias("names"),
        S.identity_key(c("id").cast("string"), F.lit("en"), F.trim("name")).alias("identity_key"), "payload_json", c("id").cast("string").alias("external_id"),
    )
    return good, wide.where("card_category is null").select(F.col("payload_json").alias("record"), F.lit("no category bit").alias("reason"))


def _mapped(value: Column, table: dict[str, str | None]) -> Column:
    """What a table has for a value; null where it has none. A literal map, so that the value is made once."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def first_passcode(images: Column, own: Column) -> Column:
    return F.coalesce(F.get(F.filter(images, lambda x: F.coalesce(x["id"], F.lit(0)) != 0), F.lit(0))["id"], own)


def from_json_dump(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records, and the records whose category can't be told (record, reason)."""
    c = F.col
    text = lambda n: F.trim(F.coalesce(c(n), F.lit("")))
    # columns of their own, as nearly all that follows asks for them
    rows = rows.withColumns({"__frame": text("frameType"), "__kind": F.lower(F.coalesce("type", F.lit("")))})
    frame, kind = c("__frame"), c("__kind")
    by_type = F.when(kind.contains("monster"), "MONSTER").when(kind.contains("spell"), "SPELL").when(kind.contains("trap"), "TRAP").when(kind.contains("skill"), "SPELL")
    category = F.coalesce(_mapped(frame, {k: v[0] for k, v in V.FRAMES.items()}), by_type)
    framed = frame.isin(*V.FRAMES)
    token = functools.reduce(lambda w, t: w.when(kind.contains(t), t.upper()), V.TYPE_TOKENS[1:], F.when(kind.contains(V.TYPE_TOKENS[0]), V.TYPE_TOKENS[0].upper()))
    plain = F.when(kind.contains("effect"), "EFFECT").otherwise("NORMAL")
    monster = c("card_category") == "MONSTER"
    unframed = F.when(monster, F.coalesce(token, plain)).when(by_type.isin("SPELL", "TRAP") & ~kind.contains("skill"), "NORMAL").when(kind.contains("skill"), "SKILL")
    sub = F.when(framed, F.coalesce(_mapped(frame, {k: v[1] for k, v in V.FRAMES.items()}), F.coalesce(_mapped(text("race"), V.SUB_TYPES), F.lit("NORMAL")))).otherwise(unframed)
    flags = [F.when(monster & frame.contains("pendulum"), "PENDULUM"), *(F.when(monster & kind.contains(t), t.upper()) for t in V.FLAG_TOKENS)]
    code = first_passcode(c("card_images"), c("id"))
    wide = rows.withColumn("card_category", category)
    good = wide.where("card_category is not null").select(
        text("name").alias("canonical_name"), "card_category", sub.alias("sub_category"), F.when(monster, S.race_token(text("race"))).alias("race"),
        F.when(monster, F.nullif(F.upper(text("attribute")), F.lit(""))).alias("attribute"), S.zero_to_null(c("level")).alias("level_rank"),
        S.zero_to_null(c("linkval")).alias("link_rating"), S.zero_to_null(c("scale")).alias("pendulum_scale"), F.when(monster, c("atk")).alias("atk"),
        F.when(monster & S.zero_to_null(c("linkval")).isNull(), c("def")).alias("def"), *(F.lit(None).cast("long").alias(f"{m}_mask") for m in ("type", "race", "attribute", "category", "setcode")),
        F.lit(None).cast("long").alias("alias_passcode"), F.lit("en").alias("text_lang"), text("desc").alias("raw_text"),
        _external(("passcode", F.nullif(code, F.lit(0))), ("json_id", c("id"))).alias("external_ids"),
        F.when(text("archetype") != "", F.array(F.struct(S.slugify(text("archetype")).alias("archetype"), text("archetype").alias("archetype_raw")))).otherwise(F.array().cast("array<struct<archetype: string, archetype_raw: string>>")).alias("archetypes"),
        F.sort_array(F.array_distinct(F.array_compact(F.array(*flags)))).alias("flags"), F.lit(None).cast(_NAMES).alias("names"),
        S.identity_key(code.cast("string"), F.lit("en"), text("name")).alias("identity_key"), F.col("record").alias("payload_json"), c("id").cast("string").alias("external_id"),
    )
    return good, wide.where("card_category is null").select("record", F.lit("can't tell the category").alias("reason"))


def with_names(records: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds names (external_id, lang, name, name_kind) to records; none twice."""
    more = extra.where("name is not null and name <> ''").groupBy("external_id").agg(
        F.collect_list(F.struct("lang", "name", "name_kind", F.lit(0).alias("is_primary"))).alias("__more")
    )
    none = F.array().cast(_NAMES)
    return records.join(more, "external_id", "left").withColumn(
        "names", F.array_distinct(F.concat(F.coalesce("names", none), F.coalesce("__more", none)))
    ).drop("__more").select(*records.columns)


def chinese_names(record: Column) -> Column:
    """The names of a text record, the primary one first; each once."""
    given = lambda n: F.nullif(record[n], F.lit(""))
    sc, md, cn = given("sc_name"), given("md_name"), given("cn_name")
    name = lambda when, value, kind, primary: F.when(when, F.struct(F.lit("zh").alias("lang"), value.alias("name"), F.lit(kind).alias("name_kind"), F.lit(primary).alias("is_primary")))
    made = [
        name(sc.isNotNull(), sc, "official", 1),
        name(sc.isNull() & cn.isNotNull(), cn, "alias", 1),
        name(md.isNotNull() & ~md.eqNullSafe(sc), md, "localized", 0),
        name(cn.isNotNull() & sc.isNotNull() & (cn != sc), cn, "alias", 0),
    ]
    for key in ("nwbbs_n", "cnocg_n"):
        v = given(key)
        made.append(name(v.isNotNull() & ~v.eqNullSafe(sc) & ~v.eqNullSafe(md) & ~v.eqNullSafe(cn), v, "alias", 0))
    return F.array_distinct(F.array_compact(F.array(*made)))
