"""Steps whose cost must not grow faster than the tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import functions as F

from effectql import ingest, stored
from effectql.catalog import Store
from effectql.operators import aggregates, extract, graph, paging


def test_ranges_are_found_by_halving(spark):
    """A row is placed among the cuts by a few comparisons, with nulls first; no list of cuts is sorted or walked for it."""
    keys = [(None, 1), (None, 7), ("a", 0), ("b", 3), ("b", 4)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate([*keys, ("", 9), ("b", 5)])], "k int, a string, b int")
    frame = frame.withColumn("__order", F.struct(F.col("a").alias("c0"), F.col("b").alias("c1")))
    cuts = [F.struct(F.lit(a).cast("string").alias("c0"), F.lit(b).cast("int").alias("c1")) for a, b in keys]
    placed = frame.select("k", paging._range(cuts, 0, len(cuts)).alias("n"))
    assert {r["k"]: r["n"] for r in placed.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 5}
    told = placed._jdf.queryExecution().toString()
    assert "lambda" not in told and "array_sort" not in told


def broadcasts(frame):
    """What the plan of a frame broadcasts."""
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastExchange" in line]


def test_tables_of_cards_are_not_broadcast(spark):
    """Units, clauses and keys of cards grow with the cards; only a page, cut to its limit, is broadcast."""
    from effectql import queries

    sf_dir = "/root/testdata/sf0.001"
    for name in ("card_predicates", "card_clauses", "search_total"):
        assert not broadcasts(queries.found[name](spark, sf_dir)), name
    found = queries._part_searcher(spark, sf_dir)
    assert not broadcasts(found.compiler.page(queries._banish))
    for name in ("search_hits", "search_effects"):
        plan = queries.found[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
        for k, line in enumerate(plan):
            if "BroadcastExchange" in line:
                page = [x for x in plan[k + 1 : k + 5] if "LocalTableScan" in x or "ExistingRDD" in x]
                assert page and "canonical_name" in page[0], (name, line)


def test_cards_of_one_file_are_parsed_by_many_tasks(spark):
    """However few partitions texts come in, cards are dealt over the cores before they are parsed."""
    texts = spark.range(0, 64, 1, 1).select(F.col("id").alias("card_id"), F.lit("①：抽1张卡。").alias("desc"), F.lit(None).cast("string").alias("pdesc"), F.lit(False).alias("pendulum"))
    rows = extract.extract(texts)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_equal_units_are_parsed_once(monkeypatch):
    """A batch gives the rows of its cards in order; of units that say the same one is parsed, or each where a fallback is asked."""
    texts = ["①：从卡组抽1张卡。②：谜。", None, "①：从卡组抽1张卡。", "谜", "②：从卡组抽1张卡。", "①：从卡组抽1张卡。②：谜。"]
    cards = [(k, text, None, False) for k, text in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([c[0] for c in cards], pa.int64()), pa.array(texts, pa.string()), pa.nulls(6, pa.string()), pa.array([False] * 6)], ["card_id", "desc", "pdesc", "pendulum"])
    asked = []
    real = extract.parse_unit
    monkeypatch.setattr(extract, "parse_unit", lambda unit, *more: asked.append(unit.text) or real(unit, *more))
    made = extract._batch_rows(batch, None, False).to_pylist()
    assert len(asked) == 4
    names = [n for n, _ in extract._COLUMNS]
    assert made == [{n: r.get(n) for n in names} for c in cards for r in extract.card_rows(*c)]
    asked.clear()
    extract._batch_rows(batch, lambda unit: None, False)
    assert len(asked) == 7
    assert extract._batch_rows(batch.slice(1, 1), None, False).num_rows == 0


def test_records_of_one_file_are_parsed_by_many_tasks(spark):
    """Parts of one file are dealt over the cores before their records are parsed, in order of their keys, and lie in more buckets if they are many."""
    from effectql import stored
    from effectql.operators import graph

    graph.shared_checkpoints(spark)
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1)
    good, bad = stored._records(parts, F.col("p_name"))
    assert good.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    seen = [r["k"] for r in good.select(F.col("external_id").cast("long").alias("k")).collect()]
    assert seen == sorted(seen) and len(seen) == parts.count() and bad.isEmpty()
    assert "Exchange" not in good._jdf.queryExecution().executedPlan().toString()


def test_conditions_on_records_do_not_parse_them_anew(spark):
    """What records and rejects are selected by reads parsed fields; a table of words is looked up once for a value."""
    from effectql import stored
    from effectql.operators import graph

    graph.shared_checkpoints(spark)
    for frame in stored._records(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), F.col("p_name")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan
        assert plan.count("trim(coalesce(frameType") <= 2


def test_rows_of_cards_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    """An ingest and a build deal their rows by card once: each task of a write has rows of one bucket, and they are dealt for no table anew."""
    from effectql import stored
    from effectql.catalog import BY_CARD, Store
    from effectql.ingest import build_effects, ingest_records, put_texts
    from effectql.operators import graph
    from effectql.queries import part_cards

    graph.shared_checkpoints(spark)
    sf_dir = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    store, where = Store(spark, f"file://{tmp_path}/store", buckets=3), {}
    real = Store._save

    def save(self, name, rows, folder, bucketed, dealt=False):
        if dealt:
            lies = rows.select(F.spark_partition_id().alias("task"), F.pmod(F.hash("card_id"), F.lit(3)).alias("bucket")).distinct().collect()
            where.setdefault(name, []).append(len(lies) == len({r["task"] for r in lies}))
        return real(self, name, rows, folder, bucketed, dealt)

    monkeypatch.setattr(Store, "_save", save)
    for run, some in (("one", parts), ("two", parts.where("p_partkey % 3 = 0"))):
        ingest_records(store, *stored._records(some, F.col("p_name")), "parts", run)
    put_texts(store, part_cards(spark, sf_dir).select(F.col("card_id").alias("passcode"), F.lit("effect").alias("kind"), F.col("desc").alias("text")).where("text <> ''"), "parts")
    build_effects(store)
    assert all(all(told) for told in where.values()), where
    assert set(where) == BY_CARD - {"external_id", "card_text", "effect_source"}
    assert {r["n"] for r in store.read("raw_card_record").groupBy("raw_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1}
    for name in ("card", "effect_flat"):  # and a read by buckets finds them
        n = store.read(name).groupBy("card_id").count().count()
        assert n == store.read(name).select("card_id").distinct().repartition(5).count() and n >= parts.count() - 1


def test_numbers_go_on_from_places(spark):
    """Rows that were numbered by their places once are numbered without gaps in that order, however they lie now."""
    from effectql.operators import graph, numbering

    graph.shared_checkpoints(spark)
    rows = spark.range(0, 100, 1, 7).withColumn("place", F.monotonically_increasing_id()).checkpoint()
    found = numbering.renumbered(rows.repartition(3, "id"), "place", "n", 40).orderBy("place").collect()
    assert [(r["id"], r["n"]) for r in found] == [(k, 41 + k) for k in range(100)]
    assert numbering.renumbered(rows.where("false"), "place", "n").columns == ["id", "place", "n"]


def test_texts_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """Texts are as large as they are, not as the file that they are made from: they are not taken for a small table."""
    from effectql.catalog import Store
    from effectql.ingest import put_texts

    n = 20_000
    spark.range(n).write.parquet(f"{tmp_path}/few")
    texts = spark.read.parquet(f"{tmp_path}/few").select(F.col("id").alias("passcode"), F.lit("effect").alias("kind"), F.concat(*(F.sha2((F.col("id") + k).cast("string"), 512) for k in range(4))).alias("text"))
    store, seen = Store(spark, f"file://{tmp_path}/store", buckets=2), []
    store.migrate()
    store.write("external_id", spark.range(n).select(F.col("id").alias("card_id"), F.lit("passcode").alias("source"), F.col("id").cast("string").alias("external_id")))
    real, before = store.write, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store.write = lambda name, delta: (seen.extend(broadcasts(delta.rows) + broadcasts(delta.touched)), real(name, delta))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 << 20))
    try:
        put_texts(store, texts, "parts")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not seen, seen
    assert store.read("card_text").count() == n


def test_what_cards_have_in_common_is_kept_once(spark):
    """Wide rows of equal units went through Python and the cache once for each card."""
    text = "①：自己从卡组抽1张卡。②：自己从卡组抽2张卡。"
    texts = spark.createDataFrame([(k, text if k % 3 else "②：自己从卡组抽2张卡。", None, False) for k in range(60)], "card_id long, desc string, pdesc string, pendulum boolean")
    kept = extract.parsed(texts.coalesce(1), buckets=2)
    flat = extract.extract(texts)
    assert sorted(map(str, extract.spread(kept).collect())) == sorted(map(str, flat.collect())) and flat.count() == 100
    assert kept.count() < 60


def test_texts_are_dealt_by_card_once(spark, tmp_path):
    """They were dealt by key, then by card; the last text of a key still wins, texts of other sources and kinds stay."""
    graph.shared_checkpoints(spark)
    store = Store(spark, f"{tmp_path}/store", buckets=2)
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey BETWEEN 1 AND 8")
    ingest.ingest_records(store, *stored._records(parts, F.col("p_name")), "parts", "one")
    put = lambda rows, source: ingest.put_texts(store, spark.createDataFrame(rows, "passcode long, kind string, text string"), source)
    put([(k, "effect", f"a{k}") for k in range(1, 9)], "x")
    put([(1, "effect", "b"), (1, "effect", "c"), (2, "pendulum", "p"), (99, "effect", "none")], "x")
    put([(3, "effect", "y")], "y")
    got = {(r["kind"], r["source"], r["text"]) for r in store.read("card_text").collect()}
    assert got == {("effect", "x", "c"), ("pendulum", "x", "p"), ("effect", "y", "y"), *(("effect", "x", f"a{k}") for k in range(2, 9))}
    files = [f for s in store.current().tables["card_text"][:1] for f in os.listdir(f"{tmp_path}/store/card_text/{s.rows}") if f.endswith(".parquet")]
    assert len(files) == 2


def test_colliding_keys_are_counted_as_listed(spark):
    rows = spark.createDataFrame([("a", "X"), ("a", "x"), ("b", "X"), ("b", "Y"), ("c", None), ("c", "Z"), (None, "P"), (None, "Q")], "k string, name string")
    assert aggregates.collided(rows, "k", "name") == aggregates.collisions(rows, "k", "name").count() == 2
