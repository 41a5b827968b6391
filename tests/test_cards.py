"""End to end on a small pool of cards: ingest, effect build, search, tools, command line."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from effectql import cli, ingest
from effectql.catalog import SCHEMAS, MigrationError, Store
from effectql.config import Config
from effectql.functions import scalars
from effectql.operators import dml, extract, numbering
from effectql.plans.ast import Exists, Field, Query, QueryError, all_of, any_of, effect, negate
from effectql.plans.cards import tables
from effectql.plans.filters import parse_filters
from effectql.plans.search import Searcher
from effectql.sources import normalize, readers
from effectql.streaming.incremental import follow_dumps
from effectql.tools import SCHEMAS as SCHEMAS_OF_TOOLS
from effectql.tools import ToolError, Tools

POOL = [
    # name, type, frame, race, attribute, level, atk, def, archetype, Chinese text
    ("A Dragon Alpha", "Effect Monster", "effect", "Dragon", "DARK", 4, 1800, 1200, None, "把墓地的1只光属性怪兽除外才能发动。从额外卡组特殊召唤1只龙族怪兽。"),
    ("B Fiend Beta", "Effect Monster", "effect", "Fiend", "DARK", 3, 1000, 1000, "Test Case", "这张卡召唤成功时才能发动。从卡组把1只暗属性怪兽加入手卡。"),
    ("C Mystic Spell", "Spell Card", "spell", "Quick-Play", None, None, None, None, None, "以场上1张魔法·陷阱卡为对象才能发动。那张卡破坏。"),
    ("D Tuner Gamma", "Tuner Monster", "effect", "Warrior", "LIGHT", 4, 1300, 500, None, "把1张手卡丢弃才能发动。自己从卡组抽2张卡。"),
    ("E Big Dragon", "Effect Monster", "effect", "Dragon", "LIGHT", 8, 2600, -1, None, "从手卡特殊召唤1只4星以下的怪兽。"),
    ("F Counter Trap", "Trap Card", "trap", "Counter", None, None, None, None, None, "怪兽召唤成功时才能发动。那个召唤无效，那只怪兽破坏。"),
    ("G Grave Tender", "Effect Monster", "effect", "Spellcaster", "EARTH", 2, 900, 900, None, "把墓地的1只怪兽除外才能发动。从卡组把1只怪兽加入手卡。"),
]


def pool_file(folder, name="pool.json"):
    keys = ("name", "type", "frameType", "race", "attribute", "level", "atk", "def", "archetype", "zh_desc")
    cards = [dict(zip(keys, c, strict=True)) | {"id": 1001 + i, "desc": f"text of {c[0]}", "card_images": [{"id": 1001 + i}]} for i, c in enumerate(POOL)]
    path = folder / name
    path.write_text(json.dumps({"data": [*cards, {"id": 5, "name": "H Nothing", "type": "?"}, "no record"]}), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    s = Store(spark, str(folder / "tables"))
    result = ingest.ingest_json(s, pool_file(folder))
    assert (result.seen, result.created, result.updated, result.rejected) == (7, 7, 0, 2)
    counts = ingest.build_effects(s)
    assert counts["errors"] == 0 and counts["effect_unit"] == 7
    return s


@pytest.fixture(scope="module")
def searcher(store):
    cached = {k: v.cache() for k, v in tables(store.tables()).items()}
    return Searcher(cached)


def letters(searcher, where):
    return "".join(sorted(r["canonical_name"][0] for r in searcher.compiler.matched(Query(where)).select("canonical_name").collect()))


f = Field
CASES = [
    (f("card.race", "eq", "DRAGON"), "AE"),
    (all_of(f("card.attribute", "eq", "DARK"), f("card.level_rank", "lte", 4)), "AB"),
    (f("card.level_rank", "gte", 8), "E"),
    (f("card.card_category", "eq", "SPELL"), "C"),
    (f("card.archetype", "eq", "test-case"), "B"),
    (f("card.archetype", "contains", "CASE"), "B"),
    (f("card.flag", "eq", "TUNER"), "D"),
    (f("card.name", "contains", "big"), "E"),
    (f("card.name", "eq", "e big dragon"), "E"),
    (f("card.def", "eq", -1), "E"),
    (effect(action="SPECIAL_SUMMON"), "AE"),
    (effect(action="special_summon", source_zone="EXTRA_DECK", object_race="DRAGON"), "A"),
    (effect("COST", action="BANISH", source_zone="GRAVEYARD"), "AG"),
    (effect("RESOLUTION", action="BANISH"), ""),
    (Exists(f("effect.object_level", "lte", 4)), "E"),
    (effect(object_card_type="SPELL_TRAP"), "C"),
    (effect(object_card_type="SPELL"), "C"),
    (effect(action="SEARCH", destination_zone="HAND"), "BG"),
    (Exists(f("clause.once_per_turn", "eq", "TRUE")), ""),
    (any_of(f("card.race", "eq", "FIEND"), f("card.race", "eq", "SPELLCASTER")), "BG"),
    (negate(f("card.card_category", "eq", "MONSTER")), "CF"),
    (f("card.race", "ne", "DRAGON"), "BCDFG"),
    (f("card.race", "nin", ("DRAGON", "FIEND")), "CDFG"),
    (negate(f("card.race", "in", ("DRAGON", "FIEND"))), "DG"),
    (any_of(f("card.level_rank", "gte", 8), effect("COST", action="BANISH")), "AEG"),
    (Exists(all_of(f("effect.action", "eq", "SEARCH"), effect("COST", action="BANISH"))), "G"),
]


@pytest.mark.parametrize("where, expected", CASES, ids=range(len(CASES)))
def test_queries(searcher, where, expected):
    assert letters(searcher, where) == expected


def test_search_document(searcher):
    got = searcher.search(Query(f("card.card_category", "eq", "MONSTER"), limit=2))
    assert (got["total"], got["returned"], [h["canonical_name"][0] for h in got["hits"]]) == (5, 2, ["A", "B"])
    assert "matched_effects" not in got["hits"][0]
    assert got["hits"][1]["archetypes"] == ["test-case"]
    got = searcher.search(Query(effect("COST", action="BANISH")))
    shown = got["hits"][0]["matched_effects"]
    assert len(shown) == 1 and [p["action"] for p in shown[0]["predicates"]] == ["BANISH", "SPECIAL_SUMMON"]
    both = Query(all_of(effect("COST", action="BANISH"), effect(action="SEARCH")))
    assert "matched_effects" not in searcher.search(both)["hits"][0]
    assert len(searcher.search(both, mode="any")["hits"][0]["matched_effects"]) == 1


def test_scope_and_values_are_checked(searcher):
    for where in (
        f("effect.action", "eq", "DRAW"), Exists(f("card.race", "eq", "DRAGON")), f("card.nothing", "eq", 1), f("card.race", "eq", "CAT"),
        f("card.level_rank", "eq", "4"), f("card.level_rank", "eq", True), Exists(f("effect.object_level", "eq", 4)), f("card.flag", "in", ("A",)),
    ):
        with pytest.raises(QueryError):
            searcher.compiler.matched(Query(where))


def test_filters(searcher):
    assert letters(searcher, parse_filters(["level<=3"]).where) == "BG"
    assert letters(searcher, parse_filters(["level=4", "effect.archetype=Foo"]).where) == ""
    assert letters(searcher, parse_filters(["effect.extracted_by=rule", "effect.action=draw", "clause.role=resolution"]).where) == "D"
    assert parse_filters([]).where is None
    with pytest.raises(QueryError):
        parse_filters(["level<x"])


def test_ingest_again_updates_in_place(store, tmp_path):
    before = {n: store.read(n).count() for n in ("card", "card_name", "external_id", "card_archetype", "card_flag", "card_text")}
    created = {r["card_id"]: r["created_at"] for r in store.read("card").collect()}
    result = ingest.ingest_json(store, pool_file(tmp_path))
    assert (result.seen, result.created, result.updated) == (7, 0, 7)
    assert before == {n: store.read(n).count() for n in before}
    assert created == {r["card_id"]: r["created_at"] for r in store.read("card").collect()}
    assert store.read("raw_card_record").count() == 14
    assert store.audit().count() == 0
    payload = readers.replay(store.read("raw_card_record"), 1, "id long, name string").first()["record"]
    assert payload["name"] == POOL[payload["id"] - 1001][0]


def test_statistics(store):
    assert "effectql_card" in store.analyze()
    assert store.spark.table("effectql_card").count() == 7


def test_migrations(store):
    assert store.migrate() == []
    with pytest.raises(MigrationError):
        store.migrate(((1, "other", ()),))
    with pytest.raises(MigrationError):
        store.migrate(((9, "a", ()), (9, "b", ())))


def test_tools_and_command_line(store, tmp_path):
    tools = Tools(store)
    card = tools.get_card(name="fiend")
    assert card["archetypes"] == ["test-case"] and {"source": "passcode", "external_id": "1002"} in card["external_ids"]
    assert tools.get_card(card_id=card["card_id"])["canonical_name"] == "B Fiend Beta"
    for bad in (lambda: tools.get_card(), lambda: tools.get_card("nobody"), lambda: tools.search_cards({"where": {"field": "x"}}), lambda: tools.search_cards({"where": {"field": "card.no", "op": "eq", "value": 1}})):
        with pytest.raises(ToolError):
            bad()
    with pytest.raises(NotImplementedError):
        tools.semantic_search("x")
    found = tools.search_effects({"where": {"exists": "effect", "where": {"field": "effect.action", "op": "eq", "value": "DRAW"}}})
    assert [e["canonical_name"][0] for e in found] == ["D"]
    config = Config(store.root, str(tmp_path))
    assert cli.run(["search", "--nl", "Level 8 or higher dragon", "--limit", "3"], store.spark, config)["total"] == 1
    assert cli.run(["stats"], store.spark, config)["monsters"] == 5
    assert cli.run(["check"], store.spark, config) == []
    assert cli.run(["card", "a dragon alpha"], store.spark, config)["race"] == "DRAGON"
    assert len(cli.run(["effects-show", "Gamma"], store.spark, config)["units"]) == 1


def test_chinese_dump(store, tmp_path):
    records = {
        "1": {"id": 1002, "sc_name": "乙", "md_name": "乙乙", "cn_name": "丙", "nwbbs_n": "丙", "text": {"desc": "①：自己从卡组抽1张卡。", "types": "x"}},
        "2": {"id": 1004, "cn_name": "丁", "text": {"desc": "", "pdesc": "", "types": ""}},
        "3": {"id": 77, "cn_name": "无"},
        "4": {"id": 0, "cn_name": "空"},
    }
    path = tmp_path / "dump.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("cards.json", json.dumps(records))
    got = ingest.apply_chinese(store, str(path))
    assert (got.records, got.matched, got.unmatched, got.without_passcode) == (4, 2, 1, 1)
    zh = store.read("card_name").where("lang = 'zh'").orderBy("card_id", "name_kind", "name").select("name_kind", "name", "is_primary").collect()
    assert [tuple(r) for r in zh] == [("alias", "丙", 0), ("localized", "乙乙", 0), ("official", "乙", 1), ("alias", "丁", 1)]
    ingest.ingest_json(store, pool_file(tmp_path))
    assert store.read("card_name").where("lang = 'zh'").count() == 4


def test_card_database(spark, tmp_path):
    path = tmp_path / "cards.cdb"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE texts (id INTEGER, name TEXT, desc TEXT)")
    db.execute("CREATE TABLE datas (id INTEGER, ot INT, alias INT, setcode INT, type INT, atk INT, def INT, level INT, race INT, attribute INT, category INT)")
    db.execute("INSERT INTO texts VALUES (7, 'Pendulum', 'p'), (8, 'Link', 'l'), (9, 'Trap', 't')")
    db.execute(f"INSERT INTO datas VALUES (7, 0, 0, {0x12_0000_00A1}, {0x1 | 0x20 | 0x400000 | 0x1000}, -1, 10, {4 | 8 << 16 | 8 << 24}, 8192, 32, 0)")
    db.execute(f"INSERT INTO datas VALUES (8, 0, 7, 0, {0x1 | 0x20 | 0x1000000}, 5, 3, 2, 1, 1, 0), (9, 0, 0, 0, 4, 0, 0, 0, 1, 1, 0), (10, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)")
    db.commit()
    db.close()
    good, bad = normalize.from_cdb(readers.read_cdb(spark, str(path)))
    rows = {r["external_id"]: r for r in good.collect()}
    a, b, c = rows["7"], rows["8"], rows["9"]
    assert (a["sub_category"], a["race"], a["attribute"], a["level_rank"], a["pendulum_scale"], a["atk"], a["flags"]) == ("PENDULUM", "DRAGON", "DARK", 4, 8, -1, ["PENDULUM", "TUNER"])
    assert [x["archetype"] for x in a["archetypes"]] == ["setcode-00a1", "setcode-0012"]
    assert (b["sub_category"], b["link_rating"], b["def"], b["alias_passcode"]) == ("LINK", 2, None, 7)
    assert (c["card_category"], c["sub_category"], c["race"], c["canonical_name"]) == ("TRAP", "NORMAL", None, "Trap")
    assert bad.count() == 1
    (tmp_path / "bad.cdb").write_bytes(b"no database")
    with pytest.raises(Exception, match="not a card database"):
        readers.read_cdb(spark, str(tmp_path / "bad.cdb")).collect()


def test_incremental(spark, tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "tables"))
    pool_file(folder)
    follow_dumps(store, str(folder), str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read("card").count() == 7
    follow_dumps(store, str(folder), str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read("raw_card_record").count() == 7


def test_snapshot_and_config(tmp_path):
    path = readers.snapshot(b"x", str(tmp_path), "dump", "json")
    assert open(path, "rb").read() == b"x"
    (tmp_path / ".env").write_text("# c\nEFFECTQL_STORE='s'\nEFFECTQL_RAW=r\n")
    got = Config.load(str(tmp_path), {"EFFECTQL_RAW": "q"})
    assert got == Config(str(tmp_path / "s"), str(tmp_path / "q"))


def test_names_are_added_once(spark):
    rows = spark.createDataFrame([("1", None), ("2", None)], f"external_id string, names {normalize._NAMES}")
    extra = spark.createDataFrame([("1", "fr", "un", "official"), ("1", "fr", "un", "official"), ("2", "fr", "", "official")], "external_id string, lang string, name string, name_kind string")
    got = {r["external_id"]: len(r["names"]) for r in normalize.with_names(rows, extra).select("external_id", "names").collect()}
    assert got == {"1": 1, "2": 0}


def test_a_change_that_fails_leaves_every_table_as_it_was(spark, tmp_path, monkeypatch):
    """A write that fails in the middle of an ingest: readers see the state before it, of all tables."""
    dump = tmp_path / "cards.json"
    store = Store(spark, str(tmp_path / "store"))
    card = lambda i, name: {"id": i, "name": name, "type": "Effect Monster", "desc": "d", "race": "Dragon", "card_images": [{"id": i}]}
    dump.write_text(json.dumps({"data": [card(1, "One")]}))
    ingest.ingest_json(store, str(dump))
    before = {name: sorted(map(str, store.read(name).collect())) for name in SCHEMAS}
    dump.write_text(json.dumps({"data": [card(1, "Uno"), card(2, "Two")]}))
    real, calls = Store.write, []

    def failing(self, name, rows):
        calls.append(name)
        if len(calls) == 4:
            raise OSError("no space left")
        real(self, name, rows)

    monkeypatch.setattr(Store, "write", failing)
    with pytest.raises(OSError):
        ingest.ingest_json(store, str(dump))
    monkeypatch.setattr(Store, "write", real)
    for reader in (store, Store(spark, store.root)):
        assert {name: sorted(map(str, reader.read(name).collect())) for name in SCHEMAS} == before
    ingest.ingest_json(store, str(dump))
    assert {r["canonical_name"] for r in store.read("card").collect()} == {"Uno", "Two"}
    assert store.audit().isEmpty()


def test_numbers_without_a_single_task(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000, None if k % 50 == 0 else f"k{k}") for k in range(1000)], "a long, b string")
    made = numbering.numbered(rows, [F.col("b").asc_nulls_first(), F.col("a")], "n", 10)
    got = [(r["b"] or "", r["a"], r["n"]) for r in made.collect()]
    assert [n for _, _, n in sorted(got, key=lambda x: x[2])] == list(range(11, 1011))
    assert [x[:2] for x in sorted(got, key=lambda x: x[2])] == sorted(x[:2] for x in got)
    assert numbering.numbered(rows.limit(0), [F.col("a")], "n").count() == 0
    known = spark.createDataFrame([(1, "x")], "id long, b string")
    after = dml.get_or_create(known, rows.select(F.lit(0).cast("long").alias("id"), "b"), ["b"], "id")
    assert "SinglePartition" not in after._jdf.queryExecution().executedPlan().toString()


def test_tool_schemas_follow_the_methods():
    assert set(SCHEMAS_OF_TOOLS) == {"get_card", "search_cards", "search_effects", "plan_query", "fulltext_search", "semantic_search"}
    assert SCHEMAS_OF_TOOLS["search_effects"]["input"]["query"] == {"type": "Any", "required": True}
    assert all(s["description"] and s["output"] for s in SCHEMAS_OF_TOOLS.values())


def test_column_functions_agree_with_the_extraction(spark):
    """Text functions exist as columns and, in the extraction, as functions of a string: one meaning."""
    texts = ["", "  a\r\nb\rc \n", "「x」和「长名字 」", "「」「未完", "对方和自己", "自己的玩家", "双方", "玩家", "谜", "「" + "y" * 60 + "」「" + "z" * 61 + "」", "从「甲」到「乙丙」。"]
    made = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select(
        "i", scalars.normalize_text(F.col("x")).alias("normal"), scalars.mask_quoted(F.col("x")).alias("mask"), scalars.quoted_names(F.col("x")).alias("names"), scalars.subject(F.col("x")).alias("subject")
    )
    for r in made.collect():
        x = texts[r["i"]]
        assert (r["normal"], r["mask"], r["names"], r["subject"]) == (extract.normalize(x), extract.mask(x), extract.names(x), extract._subject(x)), x


def test_extractors_by_name(spark):
    texts = spark.createDataFrame([(1, "①：谜。", None, False)], "card_id long, desc string, pdesc string, pendulum boolean")
    extract.register_extractor("tests", lambda unit: [])
    assert extract.extract(texts, "rule").first()["parse_status"] == "UNRESOLVED"
    assert extract.extract(texts, "tests").collect() != extract.extract(texts).collect()
    with pytest.raises(ValueError):
        extract.extract(texts, "unknown")
    with pytest.raises(ValueError):
        extract.register_extractor("rule", lambda unit: None)


def test_published_checksum(tmp_path):
    told = tmp_path / "sum.txt"
    told.write_text('"0123456789ABCDEF0123456789abcdef"  cards.json\n')
    assert readers.published_md5(told.as_uri()) == "0123456789abcdef0123456789abcdef"
    assert readers.published_md5((tmp_path / "missing").as_uri()) is None
    told.write_text("<html>")
    assert readers.published_md5(told.as_uri()) is None
