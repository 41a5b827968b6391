"""Ingest: identity resolution, upsert with provenance, enrichment by Chinese texts, and the effect build."""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import SCHEMAS, Delta, Store
from .functions.scalars import zero_to_null
from .operators import dml, extract, graph, numbering
from .operators.aggregates import collided, collisions, pivot_max
from .sources import normalize, readers

MASKS = ("type_mask", "race_mask", "attribute_mask", "category_mask", "setcode_mask", "alias_passcode", "primary_source_id")


@dataclass
class IngestResult:
    seen: int = 0
    created: int = 0
    updated: int = 0
    rejected: int = 0
    errors: list[str] = field(default_factory=list)
    collisions: int = 0


def resolve(records: DataFrame, external: DataFrame, top: int) -> DataFrame:
    """Records with the card_id they belong to and whether that card is new.

    Records count in their order. The first of a record's external ids that is held already, by a card of
    ``external`` or an earlier record, names its card; a record without such an id begins one. So a record
    points at the earliest holder of that id, and its card is the one at which the pointers end.
    Ids of new cards go on from ``top``, in the order of their first external ids.
    """
    graph.shared_checkpoints(records.sparkSession)
    numbered = records.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    asked = numbered.select("__row", F.posexplode("external_ids").alias("__at", "e")).select("__row", "__at", "e.source", "e.external_id")
    keys = ["source", "external_id"]
    holders = asked.groupBy(*keys).agg(F.min("__row").alias("first")).join(external.select(*keys, "card_id"), keys, "left")
    seen = asked.join(holders, keys).where((F.col("first") < F.col("__row")) | F.col("card_id").isNotNull())
    named = seen.groupBy("__row").agg(F.min_by(F.struct("card_id", "first"), "__at").alias("by")).select("__row", "by.*").checkpoint()
    ends = graph.follow(named.where("card_id is null"), "__row", "first").withColumnRenamed("root", "__root")
    rooted = numbered.select("__row").join(ends, "__row", "left").withColumn("__root", F.coalesce("__root", "__row"))
    # what begins a card, by its first external id
    first = F.get(F.col("external_ids"), F.lit(0))
    fresh = F.when(F.size("external_ids") > 0, F.concat_ws(":", first["source"], first["external_id"])).otherwise(F.concat(F.lit("row:"), F.col("__row").cast("string")))
    begun = numbered.join(named, "__row", "left_anti").select(F.col("__row").alias("__root"), fresh.alias("__key"))
    ids = numbering.numbered(begun, [F.col("__key"), F.col("__root")], "__id", top).select("__root", "__id")
    held = named.where("card_id is not null").select(F.col("__row").alias("__root"), "card_id")
    told = rooted.join(ids, "__root", "left").join(held, "__root", "left").select("__row", F.col("card_id").isNull().alias("is_new"), F.coalesce("card_id", "__id").cast("long").alias("card_id"))
    # records meet their cards once all is known of these, and are not sorted for it
    return numbered.join(told.hint("shuffle_hash"), "__row")


def register_source(store: Store, name: str, content_sha256: str | None, **more) -> int:
    """The id of the source with this name and content (null equals null); a new one if there is none."""
    spark = store.spark
    known = store.read("raw_source")
    same = (F.col("source_name") == name) & F.col("content_sha256").eqNullSafe(F.lit(content_sha256))
    held, top = known.agg(F.min(F.when(same, F.col("source_id"))), F.coalesce(F.max("source_id"), F.lit(0))).first()
    if held is not None:
        return held
    row = spark.createDataFrame([{"source_id": top + 1, "source_name": name, "content_sha256": content_sha256, **more}], SCHEMAS["raw_source"])
    store.write("raw_source", Delta(row.withColumn("fetched_at", F.coalesce("fetched_at", F.current_timestamp()))))
    return top + 1


def _of(table: DataFrame, cards: DataFrame) -> DataFrame:
    """The rows of some cards."""
    return table.join(cards.select("card_id"), "card_id", "left_semi").select(*table.columns)


def ingest_records(store: Store, records: DataFrame, rejects: DataFrame, source: str, content_sha256: str | None = None, version: str | None = None) -> IngestResult:
    """Put normalised records into the store. All tables change at once, or none.

    Running it again with the same records changes nothing but times, and adds their raw records once more, as each
    run is told by the records it saw. What is written grows with the records, not with the store.
    """
    with store.transaction():
        return _ingest_records(store, records, rejects, source, content_sha256, version)


def _ingest_records(store: Store, records: DataFrame, rejects: DataFrame, source: str, content_sha256: str | None, version: str | None) -> IngestResult:
    store.migrate()
    rejects = rejects.persist()  # they are read twice, and made anew else
    top = store.read("card").agg(F.coalesce(F.max("card_id"), F.lit(0))).first()[0]
    # all that follows is asked by card, where the records of a card now lie, and written from there
    found = resolve(records, store.read("external_id"), top).repartition(store.current().buckets, "card_id").persist()
    seen = found.count()
    source_id = register_source(store, source, content_sha256, source_version=version, record_count=seen)
    # of several records of a card the last one counts; each mask is that of the last one that has it
    masks = [m for m in MASKS if m in found.columns]
    last = found.groupBy("card_id").agg(F.max("__row").alias("__last"), *(F.max_by(m, F.when(F.col(m).isNotNull(), F.col("__row"))).alias(m) for m in masks))
    # an equality would be a second key of the join, which rows dealt by card alone would be dealt anew for
    latest = found.drop(*masks).join(last.hint("shuffle_hash"), "card_id").where("__row >= __last").drop("__last").persist()
    now = F.current_timestamp()
    cards = latest.select(*(c for c in normalize.RECORD if c in SCHEMAS["card"].replace(",", " ").split()), "card_id").select(
        "*", F.lit(source_id).cast("long").alias("primary_source_id"), now.alias("created_at"), now.alias("updated_at")
    )
    touched = latest.select("card_id")
    merged = dml.merge_upsert(_of(store.read("card"), touched), cards.select(*store.read("card").columns), ["card_id"], keep_if_null=MASKS, keep=("created_at",))
    exploded = lambda c, *cols: latest.select("card_id", F.explode(c).alias("x")).select("card_id", *(F.col(f"x.{k}") for k in cols))
    raw_top = store.read("raw_card_record").agg(F.coalesce(F.max("raw_id"), F.lit(0))).first()[0]
    raw = numbering.renumbered(found, "__row", "raw_id", raw_top).select(
        "raw_id", F.lit(source_id).cast("long").alias("source_id"),
        "card_id", "external_id", F.sha2("payload_json", 256).alias("payload_sha256"), "payload_json",
    )
    # every record's ids, of which the first to name one has it
    ids = found.select("card_id", "__row", F.explode("external_ids").alias("x")).select("card_id", "__row", "x.source", "x.external_id")
    known = store.read("external_id")
    ids = ids.groupBy("source", "external_id").agg(F.min_by("card_id", "__row").alias("card_id")).join(known.select("source", "external_id"), ["source", "external_id"], "left_anti")
    own = F.array(F.struct(F.lit("en").alias("lang"), F.col("canonical_name").alias("name"), F.lit("official").alias("name_kind"), F.lit(1).alias("is_primary")))
    every = F.concat(own, F.coalesce("names", F.array().cast(latest.schema["names"].dataType)))
    named = exploded(every, "lang", "name_kind", "name", "is_primary").dropDuplicates(["card_id", "lang", "name_kind", "name"])
    # a base source replaces the names of its own language; others stay
    old = _of(store.read("card_name"), touched).where("lang <> 'en'")
    changes = {
        "card": Delta(merged, touched, dealt=True),
        "external_id": Delta(ids.select(*known.columns)),
        "card_archetype": Delta(exploded("archetypes", "archetype", "archetype_raw").dropDuplicates(["card_id", "archetype"]), touched, dealt=True),
        "card_flag": Delta(latest.select("card_id", F.explode("flags").alias("flag")).dropDuplicates(), touched, dealt=True),
        "raw_card_record": Delta(raw),
        "card_name": Delta(old.unionByName(named.select(*old.columns)), touched, dealt=True),
    }
    for name, rows in changes.items():
        store.write(name, rows)
    created = latest.where("is_new").count()
    result = IngestResult(
        seen, created, seen - created, rejects.count(),
        [f"{r['reason']}: {r['record'][:80]}" for r in rejects.limit(20).collect()], collided(found, "identity_key", "canonical_name"),
    )
    for held in (latest, found, rejects):
        held.unpersist()
    return result


def ingest_cdb(store: Store, path: str, **more) -> IngestResult:
    return ingest_records(store, *normalize.from_cdb(readers.read_cdb(store.spark, path)), source="cdb", **more)


def ingest_json(store: Store, path: str | list[str], **more) -> IngestResult:
    """A dump, or several at once, with the texts they hold."""
    with store.transaction():
        return _ingest_json(store, path, **more)


def _ingest_json(store: Store, path: str | list[str], **more) -> IngestResult:
    good, bad = readers.read_json_dump(store.spark, path)
    records, untold = normalize.from_json_dump(good)
    result = ingest_records(store, records, bad.unionByName(untold), source="json", **more)
    texts = good.where("zh_desc is not null and zh_desc <> ''").select(normalize.first_passcode(F.col("card_images"), F.col("id")).alias("passcode"), F.col("zh_desc").alias("text"))
    if not texts.isEmpty():
        put_texts(store, texts.select("passcode", F.lit("effect").alias("kind"), "text"), "json")
    return result


def put_texts(store: Store, texts: DataFrame, source: str) -> None:
    """Chinese texts (passcode, kind, text) of known cards; a text replaces the one of its card, kind and source."""
    with store.transaction() as after:
        _put_texts(store, texts, source, after.buckets)


def _put_texts(store: Store, texts: DataFrame, source: str, buckets: int) -> None:
    ids = store.read("external_id").where("source = 'passcode'").select("card_id", F.col("external_id").alias("code"))
    # kept, so that it is known how large they are: texts made of a small file's columns would be taken as small, and broadcast
    texts = texts.persist()
    texts.count()
    # dealt by card once: the last text of a key is found where its card lies
    rows = texts.join(ids, F.col("passcode").cast("string") == F.col("code")).select("card_id", "kind", "text").repartition(buckets, "card_id").select(
        "card_id", F.lit("zh").alias("lang"), "kind", F.lit(source).alias("source"), "text", F.sha2("text", 256).alias("text_sha256"), F.current_timestamp().alias("updated_at")
    ).persist()
    touched = rows.select("card_id").distinct()
    held = store.read("card_text")
    keys = ["card_id", "lang", "kind", "source"]
    latest = dml.last_wins(rows, keys, [F.col("text")]).select(*held.columns)
    others = _of(held, touched).join(latest.select(*keys), keys, "left_anti").select(*held.columns)
    store.write("card_text", Delta(others.unionByName(latest), touched))
    for kept in (rows, texts):
        kept.unpersist()


@dataclass
class EnrichResult:
    records: int
    matched: int
    unmatched: int
    without_passcode: int


def apply_chinese(store: Store, path: str, source: str = "text_dump") -> EnrichResult:
    """Names and texts of a zipped dump for known cards; it never makes cards."""
    with store.transaction():
        return _apply_chinese(store, path, source)


def _apply_chinese(store: Store, path: str, source: str) -> EnrichResult:
    rows = readers.read_text_zip(store.spark, path).withColumn("passcode", zero_to_null(F.col("record.id")))
    ids = store.read("external_id").where("source = 'passcode'").select("card_id", F.col("external_id").alias("code"))
    joined = rows.join(ids, F.col("passcode").cast("string") == F.col("code"), "left").persist()
    counts = joined.agg(
        F.count(F.lit(1)), F.count_if(F.col("card_id").isNotNull()), F.count_if(F.col("passcode").isNotNull() & F.col("card_id").isNull()), F.count_if(F.col("passcode").isNull())
    ).first()
    known = joined.where("card_id is not null")
    names = known.select("card_id", F.explode(normalize.chinese_names(F.col("record"))).alias("x")).select("card_id", "x.lang", "x.name_kind", "x.name", "x.is_primary")
    best = names.groupBy("card_id", "lang", "name_kind", "name").agg(F.max("is_primary").alias("is_primary"))
    touched = best.select("card_id").distinct()
    store.write("card_name", Delta(dml.upsert_last(_of(store.read("card_name"), touched), best, ["card_id", "lang", "name_kind", "name"], [F.col("is_primary")]), touched))
    kinds = {"effect": "record.text.desc", "pendulum": "record.text.pdesc", "types": "record.text.types"}
    texts = known.select("passcode", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in kinds.items()))).alias("t")).select("passcode", "t.*")
    put_texts(store, texts.where("text is not null and text <> ''"), source)
    joined.unpersist()
    return EnrichResult(*counts)


def parser_texts(store: Store) -> DataFrame:
    """card_id, desc, pdesc, pendulum of cards with Chinese text; of several sources the largest text."""
    texts = pivot_max(store.read("card_text").where("lang = 'zh'"), "card_id", "kind", "text", ["effect", "pendulum"])
    flags = store.read("card_flag").where("flag = 'PENDULUM'").select("card_id", F.lit(True).alias("pendulum")).distinct()
    named = texts.select("card_id", F.col("effect").alias("desc"), F.col("pendulum").alias("pdesc"))
    return named.join(flags, "card_id", "left").select("card_id", "desc", "pdesc", F.coalesce("pendulum", F.lit(False)).alias("pendulum"))


def text_signatures(store: Store, exact_stats: bool = False, fallback: str = "rule") -> DataFrame:
    """card_id and a signature of all that its effects follow from. Of the texts only their hashes are read."""
    said = store.read("card_text").where("lang = 'zh' AND kind IN ('effect', 'pendulum')")
    texts = said.groupBy("card_id").agg(F.to_json(F.sort_array(F.collect_set(F.struct("kind", "source", "text_sha256")))).alias("texts"))
    flags = store.read("card_flag").where("flag = 'PENDULUM'").select("card_id", F.lit(True).alias("pendulum")).distinct()
    how = F.lit(f"{extract.PARSER_VERSION}:{exact_stats}:{fallback}")
    return texts.join(flags, "card_id", "left").select("card_id", F.sha2(F.concat_ws(":", how, F.coalesce("pendulum", F.lit(False)).cast("string"), "texts"), 256).alias("signature"))


_EFFECTS = ("effect_unit", "effect_clause", "effect_predicate")


def _counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each effect table, and units by status."""
    counted = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
    by_status = counted("effect_unit", tables["effect_unit"].groupBy("parse_status"))
    others = [counted(name, tables[name]).withColumn("parse_status", F.lit(None).cast("string")) for name in _EFFECTS if name != "effect_unit"]
    out = dict.fromkeys(_EFFECTS, 0)
    for r in functools.reduce(DataFrame.unionByName, others, by_status).collect():
        out[r["name"]] += r["n"]
        if r["name"] == "effect_unit":
            out[r["parse_status"]] = r["n"]
    return out


def build_effects(store: Store, fallback=None, exact_stats: bool = False, full: bool = False) -> dict[str, int]:
    """Parse texts that have changed and replace the effects of their cards; returns counts by table and status, and errors.

    What a card was parsed from is kept as a signature, so that only cards with another one, and those that
    lost their texts, take part; counts change by the difference. ``full``, or a fallback without a name, parses all
    cards. The tables and counts are the same either way. ``parsed`` tells how many cards were parsed now.
    """
    store.migrate()
    named = fallback is None or isinstance(fallback, str)
    tag = (fallback or "rule") if named else uuid.uuid4().hex
    done = store.read("effect_source")
    now = text_signatures(store, exact_stats, tag).persist()
    changed = now if full else now.join(done.select("card_id", "signature"), ["card_id", "signature"], "left_anti")
    with store.transaction() as after:
        # each table asks for its rows of these cards, and writes them down
        touched = changed.select("card_id").unionByName(done.join(now, "card_id", "left_anti").select("card_id")).repartition(after.buckets, "card_id").persist()
        after.totals = after.totals or _counts({name: store.read(name) for name in _EFFECTS})
        # parsed in tasks that hold whole buckets, so that the tables made of the rows are written where these lie
        parsed = extract.parsed(_of(parser_texts(store), changed), fallback, exact_stats, after.buckets).persist()
        rows = extract.spread(parsed)
        made = extract.effect_tables(rows)
        if not touched.isEmpty():
            before, fresh = _counts({name: _of(store.read(name), touched) for name in _EFFECTS}), _counts(made)
            made["effect_flat"] = extract.effect_flat(rows)
            wrong = extract.violations(rows).where("level = 'error'").groupBy("card_id").agg(F.count(F.lit(1)).cast("int").alias("errors"))
            made["effect_source"] = changed.select("card_id", "signature").join(wrong, "card_id", "left").select("card_id", "signature", F.coalesce("errors", F.lit(0)).alias("errors"))
            for name, new in made.items():
                store.write(name, Delta(new, touched, dealt=name != "effect_source"))
            for k in {*before, *fresh}:
                after.totals[k] = after.totals.get(k, 0) - before.get(k, 0) + fresh.get(k, 0)
        out = {k: n for k, n in after.totals.items() if n or k in _EFFECTS}
        out = dict.fromkeys(_EFFECTS, 0) | out
        out["errors"] = store.read("effect_source").agg(F.coalesce(F.sum("errors"), F.lit(0))).first()[0]
        out["parsed"] = changed.count()
    for held in (parsed, touched, now):
        held.unpersist()
    return out


def identity_report(records: DataFrame) -> DataFrame:
    """Keys of more than one name, and the names."""
    return collisions(records, "identity_key", "canonical_name")
