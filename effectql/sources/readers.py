"""Readers. Each gives rows as they are upstream; normalising is another step."""

from __future__ import annotations

import hashlib
import io
import json
import os
import sqlite3
import tempfile
import time
import urllib.request
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .dumps import list_elements

CDB_ROW = (
    "id long, ot long, alias long, setcode long, type long, atk int, def int, level long, race long, attribute long, category long, "
    "name string, desc string"
)
JSON_CARD = (
    "id long, name string, type string, frameType string, `desc` string, atk int, `def` int, level int, scale int, linkval int, race string, "
    "attribute string, archetype string, card_images array<struct<id: long>>, zh_desc string, _corrupt_record string"
)
TEXT_RECORD = (
    "map<string, struct<id: long, sc_name: string, md_name: string, cn_name: string, nwbbs_n: string, cnocg_n: string, "
    "text: struct<`desc`: string, pdesc: string, types: string>>>"
)


class SourceError(ValueError):
    """A source that isn't what it should be."""


def _cdb_rows(content: bytes) -> Iterator[tuple]:
    """Rows of a card database: data with the texts that belong to them."""
    with tempfile.NamedTemporaryFile(suffix=".cdb") as f:
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            if missing := {"texts", "datas"} - tables:
                raise SourceError(f"not a card database: no table {', '.join(sorted(missing))}")
            yield from db.execute(
                "SELECT d.id, d.ot, d.alias, d.setcode, d.type, d.atk, d.def, d.level, d.race, d.attribute, d.category, "
                "coalesce(t.name, ''), coalesce(t.desc, '') FROM datas d LEFT JOIN texts t ON t.id = d.id"
            )
        except sqlite3.DatabaseError as e:
            raise SourceError(f"not a card database: {e}") from e
        finally:
            db.close()


def read_cdb(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all card databases at ``path`` (any store that Spark reads); a file is read by one task."""
    import pyarrow as pa

    ship(spark)
    names = [c.split()[0] for c in CDB_ROW.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(_cdb_rows(content))
                kinds = [pa.int32() if n in ("atk", "def") else pa.string() if n in ("name", "desc") else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CDB_ROW)


def read_json_dump(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of dumps ({"data": [...]} or a bare list), and those that can't be read (record, reason).

    A dump is split among tasks, however large; see ``dumps``.
    """
    items = list_elements(spark, path)
    parsed = items.withColumn("r", F.from_json("record", JSON_CARD, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.coalesce(F.trim("r.name"), F.lit("")).eqNullSafe("")
    good = parsed.where(~bad).select("r.*", "record").drop("_corrupt_record")
    return good, parsed.where(bad).select("record", F.lit("not a card record").alias("reason"))


def read_text_zip(spark: SparkSession, path: str) -> DataFrame:
    """cid and record of a zipped text dump; the archive must hold cards.json."""
    import pyarrow as pa

    ship(spark)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [zip_member(c).decode() for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.string())], ["value"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
    return raw.select(F.explode(F.from_json("value", TEXT_RECORD)).alias("cid", "record"))


def zip_member(content: bytes, name: str = "cards.json") -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(name)
    except (KeyError, zipfile.BadZipFile) as e:
        raise SourceError(f"no {name} in the archive") from e


def fetch(url: str, folder: str, name: str, suffix: str, timeout: float = 60, published_md5: str | None = None) -> str:
    """Download to an unchanging snapshot NAME-TIME-SHA; returns its path. The sum published, if any, must hold."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        content = answer.read()
    if published_md5 and hashlib.md5(zip_member(content) if suffix == "zip" else content).hexdigest() != published_md5.strip().strip('"'):
        raise SourceError(f"{url}: the checksum differs from the one published")
    return snapshot(content, folder, name, suffix)


def published_md5(url: str, timeout: float = 10) -> str | None:
    """The checksum that stands at ``url``; None if it can't be reached, so that nothing is checked then."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            told = [x.strip('"') for x in answer.read(1000).decode("ascii", "replace").split()]
    except OSError:
        return None
    return told[0].lower() if told and len(told[0]) == 32 else None


def snapshot(content: bytes, folder: str, name: str, suffix: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}-{time.strftime('%Y%m%dT%H%M%S')}-{hashlib.sha256(content).hexdigest()[:8]}.{suffix}")
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(content)
    return path


def replay(raw_records: DataFrame, source_id: int, schema: str) -> DataFrame:
    """Stored payloads of a source, in order."""
    return raw_records.where(F.col("source_id") == source_id).orderBy("raw_id").select("raw_id", F.from_json("payload_json", schema).alias("record"))


def query_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
