"""JSON lists read in blocks of any size equal those read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from effectql.sources import readers
from effectql.sources.dumps import list_elements


def whole(spark, path):
    """The elements as one task reads them."""
    raw = spark.read.option("wholetext", True).text(path)
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.data"))
    return [r["record"] for r in raw.select(F.explode(F.from_json(listed, "array<string>")).alias("record")).collect()]


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 5)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", ":", "data", "é", "日", "\n", "\t", " ", "a", "😀"]) for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, False, 0, -1.5, 123456789, ""])
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["data", "id", "a}b", 'q"', "x"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def forms():
    rng = random.Random(6)
    elements = [value(rng) for _ in range(60)] + [{"id": k, "name": f"n{k}", "data": [{"data": [1]}]} for k in range(20)]
    shown = json.dumps(elements, ensure_ascii=False)
    yield "bare", shown
    yield "indented", json.dumps({"data": elements}, indent=2).replace("\n", "\r\n")
    yield "members", json.dumps({"meta": [{"a": 1}, "data"], "data_kind": "data", "count": {"data": [5]}, "data": elements, "after": ["data", [{"x": 2}]]}, ensure_ascii=False)
    yield "empty", '{"data": []}'
    yield "blank", " [ ] \n"
    yield "none", '{"rows": [1, 2], "x": {"data": [3]}}'
    yield "end", '{"data": [{"a": "}"}, {"b": "\\\\"}, {"c": "\\"}"}]}  \n\n'


@pytest.fixture
def blocks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [97, 1000])
def test_dumps_in_blocks(spark, tmp_path, blocks, size):
    expected = []
    for name, text in forms():
        path = tmp_path / f"{name}.json"
        path.write_bytes(text.encode())
        if name not in ("none", "indented"):
            expected += whole(spark, str(path)) * (2 if name == "bare" else 1)  # the indented one has the same elements
    blocks(size if size > 500 else 600)
    got = [r["record"] for r in list_elements(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    blocks(size)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "end.json").write_text(dict(forms())["end"])
    assert sorted(r["record"] for r in list_elements(spark, str(tmp_path / "one")).collect()) == sorted(whole(spark, str(tmp_path / "one")))


def test_dumps_that_break_off(spark, tmp_path, blocks):
    """Whole elements before the break are read, what is left of the last one is rejected."""
    path = tmp_path / "cut.json"
    path.write_text('{"data": [{"id": 1, "name": "A", "x": "}"}, {"id": 2, "name": "B"}, {"id": 3, "name": "C"')
    blocks(20)
    good, bad = readers.read_json_dump(spark, str(path))
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert [r["record"].strip() for r in bad.collect()] == ['{"id": 3, "name": "C"']
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
