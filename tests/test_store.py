"""The store: identity over all ids of a batch, segments, co-located joins, incremental builds, exactly-once streams."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from effectql import ingest
from effectql.catalog import SCHEMAS, Delta, Manifest, Store
from effectql.operators import graph
from effectql.plans.ast import Exists, Field, Query, all_of
from effectql.plans.cards import tables
from effectql.plans.search import Searcher
from effectql.streaming import incremental

RECORDS = "n int, external_ids array<struct<source string, external_id string>>"
EXTERNAL = "card_id long, source string, external_id string"


def sequential(records, known):
    """Card of each record when records come one by one: the first of a record's ids that is known, else a new card."""
    owner, cards, out = dict(known), 0, {}
    for n, ids in records:
        card = next((owner[i] for i in ids if i in owner), None)
        if card is None:
            card = f"new{cards}"
            cards += 1
        for i in ids:
            owner.setdefault(i, card)
        out[n] = card
    return out


def test_identity_by_all_ids_of_a_batch(spark):
    rng = random.Random(3)
    records, known, n = [], {}, 0
    for batch in range(200):  # batches share no ids, so that one run resolves them all
        for k in range(rng.randrange(4)):
            known[f"{batch}:{rng.choice('ab')}", str(rng.randrange(12))] = batch * 10 + k + 1
        for _ in range(rng.randrange(1, 12)):
            ids = [(f"{batch}:{rng.choice('ab')}", str(rng.randrange(12))) for _ in range(rng.randrange(4))]
            records.append((n, ids))
            n += 1
    records += [(n, [("passcode", "1"), ("json", "7")]), (n + 1, [("json", "7")]), (n + 2, [("x", "9"), ("passcode", "1")])]
    frame = spark.createDataFrame(records, RECORDS).coalesce(1)
    external = spark.createDataFrame([(c, *k) for k, c in known.items()], EXTERNAL)
    got = {r["n"]: (r["card_id"], r["is_new"]) for r in ingest.resolve(frame, external, 10_000).collect()}
    expected = sequential(records, known)
    assert len(got) == len(records)
    assert all(got[k][0] == c for k, c in expected.items() if isinstance(c, int))
    new = {k: c for k, c in expected.items() if isinstance(c, str)}
    assert all(got[k][1] == (k in new) for k in got)
    pairs = {(got[k][0], c) for k, c in new.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert {a for a, _ in pairs} == set(range(10_001, 10_001 + len(pairs)))
    assert len({got[k][0] for k in (n, n + 1, n + 2)}) == 1


def test_pointers_are_followed_to_their_end(spark):
    n = 300
    pointers = spark.createDataFrame([(k, k - 1) for k in range(1, n)] + [(1000 + k, 7) for k in range(50)], "node long, up long")
    got = {r["node"]: r["root"] for r in graph.follow(pointers, "node", "up").collect()}
    assert got == {k: 0 for k in [*range(1, n), *range(1000, 1050)]}
    assert graph.follow(pointers.limit(0), "node", "up").count() == 0


def card(i, name="", zh=None, **more):
    return {"id": i, "name": name or f"Card {i}", "type": "Effect Monster", "desc": "d", "race": "Dragon", "attribute": "DARK", "level": i % 12 + 1, "card_images": [{"id": i}], **({"zh_desc": zh} if zh else {}), **more}


def dump(path, cards):
    path.write_text(json.dumps({"data": cards}), encoding="utf-8")
    return str(path)


def state(store, skip=("raw_id", "source_id", "primary_source_id", "updated_at", "created_at", "fetched_at", "applied_at")):
    out = {}
    for name in SCHEMAS:
        rows = store.read(name)
        rows = rows.select(*(c for c in rows.columns if c not in skip))
        out[name] = sorted(map(str, rows.collect()))
    return out


def test_records_of_one_card_in_a_batch(spark, tmp_path):
    """The last record wins, every record's ids are kept, and a mask that the last one lacks comes from an earlier one."""
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    from effectql.sources import normalize

    good = spark.createDataFrame([json.dumps(card(1, "One")), json.dumps(card(2, "Two"))], "string").select(F.from_json("value", ingest.readers.JSON_CARD).alias("r"), F.col("value").alias("record")).select("r.*", "record").drop("_corrupt_record")
    records, rejects = normalize.from_json_dump(good.coalesce(1))
    ids = F.when(F.col("canonical_name") == "Two", F.array(F.struct(F.lit("passcode").alias("source"), F.lit("1").alias("external_id")), F.struct(F.lit("other").alias("source"), F.lit("x").alias("external_id"))))
    records = records.withColumn("external_ids", F.coalesce(ids, "external_ids"))
    if "type_mask" in records.columns:
        records = records.withColumn("type_mask", F.when(F.col("canonical_name") == "One", F.lit(33).cast("long")))
    got = ingest.ingest_records(store, records, rejects, "test")
    assert (got.seen, got.created, got.updated) == (2, 1, 1)
    row = store.read("card").collect()
    assert [r["canonical_name"] for r in row] == ["Two"]
    if "type_mask" in records.columns:
        assert row[0]["type_mask"] == 33
    assert {(r["source"], r["external_id"]) for r in store.read("external_id").collect()} >= {("passcode", "1"), ("other", "x"), ("json_id", "1")}


def test_small_ingests_write_little(spark, tmp_path, monkeypatch):
    """Small dumps write in proportion to themselves, whatever the store holds, and merge among themselves."""
    monkeypatch.setattr(Store._merge, "__defaults__", (2,))
    store, zh = Store(spark, str(tmp_path / "s"), buckets=2), "从卡组抽2张卡。"
    ingest.ingest_json(store, dump(tmp_path / "d.json", [card(i, zh=zh) for i in range(1, 2001)]))
    names, first = {i: f"Card {i}" for i in range(1, 2001)}, {n: s[0] for n, s in store.current().tables.items() if s}
    for k in range(2):
        changed = {i: f"Changed {k} {i}" for i in (k * 20 + 1, k * 20 + 2, 25)} | {5000 + k: f"New {k}"}
        names |= changed
        ingest.ingest_json(store, dump(tmp_path / "d.json", [card(i, name, zh=f"①：{zh}") for i, name in changed.items()]))
        segments = store.current().tables
        # the first dump lies where it lay, and all that was written since is a few rows
        assert all(segments[n][0] == s for n, s in first.items() if s.n >= 2000)
        assert all(sum(s.n for s in found[1:]) <= 4 * 6 * (k + 1) and len(found) <= 2 for n, found in segments.items() if first[n].n >= 2000)
    card_id = store.read("external_id").where("source = 'passcode'").select("card_id", F.col("external_id").cast("int").alias("code"))
    got = {r["code"]: r["canonical_name"] for r in store.read("card").join(card_id, "card_id").collect()}
    assert got == names and store.read("card").count() == len(names)
    assert {r["name"] for r in store.read("card_name").where("lang = 'en'").collect()} == set(names.values())
    assert store.read("card_text").where("text like '①%'").count() == 2 * 2 + 1 + 2
    before = state(store)
    store.compact()
    assert all(len(s) == 1 for s in store.current().tables.values()) and state(store) == before
    assert store.audit().isEmpty()


def test_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch):
    """A store of which a step fails is as before; the next run ends as if nothing had failed."""
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    ingest.ingest_json(store, dump(tmp_path / "a.json", [card(1, zh="从卡组抽2张卡。"), card(2)]))
    next_ = dump(tmp_path / "b.json", [card(2, "Deux"), card(3, zh="从卡组抽1张卡。")])
    before, real_save, real_publish = state(store), Store._save, Store._publish

    def failing(real, number):
        calls = iter(range(1000))

        def step(self, *args):
            if next(calls) == number:
                raise OSError("lost")
            return real(self, *args)

        return step

    for save, publish in ((0, -1), (7, -1), (-1, 0)):
        monkeypatch.setattr(Store, "_save", failing(real_save, save))
        monkeypatch.setattr(Store, "_publish", failing(real_publish, publish))
        with pytest.raises(OSError):
            ingest.ingest_json(store, next_)
        monkeypatch.undo()
        assert state(Store(spark, store.root)) == before
    got = ingest.ingest_json(store, next_)
    assert (got.created, got.updated) == (1, 1)
    assert sorted(r["canonical_name"] for r in store.read("card").collect()) == ["Card 1", "Card 3", "Deux"]
    assert store.read("card_text").count() == 2 and store.audit().isEmpty()
    assert {p.name for p in (tmp_path / "store" / "card").iterdir()} <= store.current().folders("card") | {s.rows for s in Manifest.read((tmp_path / "store" / "_manifests" / store._manifests()[-2]).read_text()).tables["card"]}


def test_a_store_of_before_segments_is_read_and_changed(spark, tmp_path):
    root = tmp_path / "old"
    store = Store(spark, str(root), buckets=2)
    rows = spark.createDataFrame([(1, "FLAG"), (2, "FLAG")], "card_id long, flag string")
    rows.write.parquet(str(root / "card_flag" / "v1"))
    (root / "_manifests").mkdir()
    (root / "_manifests" / "00000001.json").write_text(json.dumps({"card_flag": "v1"}))
    assert store.read("card_flag").count() == 2
    store.write("card_flag", Delta(spark.createDataFrame([(2, "A"), (3, "B")], "card_id long, flag string"), spark.createDataFrame([(2,), (3,)], "card_id long")))
    assert sorted(map(tuple, store.read("card_flag").collect())) == [(1, "FLAG"), (2, "A"), (3, "B")]
    assert Manifest.read(store.current().written().decode()) == store.current()


def test_changes_of_cards(spark, tmp_path):
    """Random changes, read after each, equal a dictionary; deleted cards stay away."""
    rng, store, model = random.Random(1), Store(spark, str(tmp_path / "s"), buckets=2), {}
    for _ in range(12):
        touched = rng.sample(range(30), rng.choice([1, 2, 12]))
        rows = [(c, f"f{rng.randrange(9)}") for c in touched for _ in range(rng.randrange(3))]
        rows = sorted(set(rows))
        model = {c: v for c, v in model.items() if c not in touched}
        for c, f in rows:
            model.setdefault(c, []).append(f)
        store.write("card_flag", Delta(spark.createDataFrame(rows, "card_id long, flag string"), spark.createDataFrame([(c,) for c in touched], "card_id long")))
        assert sorted(map(tuple, store.read("card_flag").collect())) == sorted((c, f) for c, v in model.items() for f in v)
    assert len(store.current().tables["card_flag"]) <= 6


ZH = ["从卡组抽2张卡。", "把墓地的1只怪兽除外才能发动。从卡组把1只怪兽加入手卡。", "①：谜。", "以场上1张卡为对象才能发动。那张卡破坏。"]


def blocks_without_shuffle(spark, store):
    """Cards by two blocks, found without a shuffle."""
    query = Query(all_of(Field("card.race", "eq", "DRAGON"), Exists(Field("effect.action", "eq", "DRAW")), Exists(Field("clause.role", "eq", "RESOLUTION"))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Searcher(tables(store.tables())).compiler.matched(query)
        rows = found.count()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    drawn = store.read("effect_predicate").where("action = 'DRAW'").select("card_id").distinct()
    assert rows == drawn.join(store.read("effect_clause").where("role = 'RESOLUTION'").select("card_id"), "card_id", "left_semi").count() > 0


def test_effects_are_built_incrementally(spark, tmp_path):
    """Only changed texts are parsed; tables and counts are those of a full build. Blocks meet their cards where they lie."""
    store = Store(spark, str(tmp_path / "s"), buckets=3)
    ingest.ingest_json(store, dump(tmp_path / "d.json", [card(i, zh=ZH[i % 4]) for i in range(1, 101)]))
    first = ingest.build_effects(store)
    assert first["parsed"] == 100 and first["effect_unit"] == store.read("effect_unit").count()
    blocks_without_shuffle(spark, store)
    assert ingest.build_effects(store) == first | {"parsed": 0}
    ingest.ingest_json(store, dump(tmp_path / "d.json", [card(7, zh=ZH[1]), card(101, zh=ZH[0])]))
    got = ingest.build_effects(store)
    assert got["parsed"] == 2 and len(store.current().tables["effect_flat"]) == 2
    blocks_without_shuffle(spark, store)  # the cards that changed are left out of the first segment by such a join, too
    built = state(store)
    full = ingest.build_effects(store, full=True)
    assert full["parsed"] == 101 and full | {"parsed": 2} == got and state(store) == built
    assert {k: n for k, n in got.items() if k not in ("errors", "parsed")} == ingest._counts({n: store.read(n) for n in ingest._EFFECTS})
    assert store.audit().isEmpty()


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    """A stream that dies between publishing a batch and committing it leaves one copy of it."""
    folder = tmp_path / "dumps"
    folder.mkdir()
    dump(folder / "a.json", [card(1), card(2)])
    store, checkpoint = Store(spark, str(tmp_path / "s"), buckets=2), str(tmp_path / "checkpoint")
    real, died = incremental.ingest_batch, threading.Event()

    def dying(*args):
        real(*args)
        died.set()
        raise OSError("lost after publishing")

    monkeypatch.setattr(incremental, "ingest_batch", dying)
    with pytest.raises(Exception, match="lost after publishing"):
        incremental.follow_dumps(store, str(folder), checkpoint).awaitTermination()
    assert died.is_set() and store.read("raw_card_record").count() == 2
    monkeypatch.setattr(incremental, "ingest_batch", real)
    incremental.follow_dumps(store, str(folder), checkpoint).awaitTermination()
    assert store.read("raw_card_record").count() == 2
    dump(folder / "b.json", [card(3)])
    incremental.follow_dumps(store, str(folder), checkpoint).awaitTermination()
    assert store.read("raw_card_record").count() == 3 and store.read("card").count() == 3


def test_deep_pages(spark):
    """Pages by counted ranges are those of a full sort, with nulls and with rows that the order doesn't part."""
    from effectql.operators.paging import page_at

    rng = random.Random(4)
    rows = [(k, rng.choice([None, "a", "b", "ß", "zz"]), rng.randrange(50)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "id int, a string, b int").repartition(3)
    order = [F.col("a"), F.col("b"), F.col("id")]
    ordered = [r["id"] for r in frame.orderBy(F.col("a").asc_nulls_first(), "b", "id").collect()]
    for offset, limit in ((0, 5), (150, 10), (1234, 300), (2990, 50), (3000, 5), (9999, 5)):
        assert [r["id"] for r in page_at(frame, order, offset, limit, kept=100).collect()] == ordered[offset : offset + limit]
    assert page_at(frame, [F.lit(1)], 2000, 7, kept=100).count() == 7


def test_queries_of_cards_build_no_effects(spark, monkeypatch):
    """What reads neither texts nor effects does not wait for them; they are made once, when a query asks, and change no card."""
    from effectql import stored

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(stored, "_built", {})
    made = []
    monkeypatch.setattr(stored, "build_effects", lambda store, build=stored.build_effects: made.append(build(store)) or made[-1])
    before = {name: getattr(stored, name)(spark, folder) for name in ("store_counters", "store_get_card", "store_cards", "store_names", "store_raw_records", "store_stats")}
    rows = {name: sorted(map(tuple, frame.collect()), key=str) for name, frame in before.items()}
    assert not made
    assert {r["name"]: r["n"] for r in stored.store_build(spark, folder).collect()} == made[1]
    assert all(sorted(map(tuple, frame.collect()), key=str) == rows[name] for name, frame in before.items())
    assert sorted(map(tuple, stored.store_cards(spark, folder).collect()), key=str) == rows["store_cards"] and len(made) == 2
