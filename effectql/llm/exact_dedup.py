"""Exact dedup over a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the normalised text. A new batch
is reduced to one row for each digest (partial aggregation before its only shuffle), compared with the
index by a sort-merge anti join that leaves the index where it lies, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, delete, join_hot, park, shared_dir, table


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


#: Files in a bucket of the index before they are merged into one.
MOST_FILES = 16


class DigestIndex:
    """A persistent table (digest, keep_id, batch), bucketed and sorted by digest.

    ``name`` is a catalog table; where it exists it is gone on with. ``buckets`` is the number of files
    that a batch adds, and so the partitions of each later merge; an existing table has its own.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.name):
            told = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(told["data_type"])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            empty = spark.createDataFrame([], "digest binary, keep_id bigint, batch string")
            self._write(empty, self.name, {"path": self._path()})

    def _path(self) -> str:
        return f"{shared_dir(self.spark)}/index/{self.name}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, name: str, options: dict[str, str]) -> None:
        (
            rows.write.mode("append").format("parquet").options(**options)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _location(self) -> str:
        return self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Location'").first()["data_type"]

    def compact(self) -> None:
        """Merge the files of each bucket into one, so that merges find it sorted.

        The table changes its folder in one step, so that whatever fails before or after leaves it whole; the old files go last.
        """
        old, fresh, path = self._location(), f"{self.name}_compact", self._path()
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        files = self.spark.read.schema(self.rows().schema).parquet(old)  # not by the table, whose buckets would stand for the shuffle
        self._write(files.repartition(self.buckets, "digest"), fresh, {"path": path})
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{path}'")
        self.spark.sql(f"REFRESH TABLE {self.name}")
        self.spark.sql(f"DROP TABLE {fresh}")  # its files are the table's now
        delete(self.spark, old)

    def drop(self) -> None:
        """Delete the table and its files."""
        path = self._location()
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, path)

    def merge(
        self, docs: DataFrame, batch: str | None = None, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Append what is new of ``docs`` to the index; returns their rows and digests, both parked.

        Rows: doc_id, digest, row_id. Digests: digest, group_size (rows of this batch), keep_id (the id in
        the index) and keep_row (the row that stays, null if an earlier batch has the text).
        """
        batch = batch or uuid.uuid4().hex
        row = F.col(row_column) if row_column else F.monotonically_increasing_id()
        rows = park(
            docs.select(F.col(id_column).cast("long").alias("doc_id"), text_digest(F.col(text_column)).alias("digest"), row.alias("row_id")),
            "digests",
        )
        groups = park(
            rows.groupBy("digest").agg(
                F.max(F.struct("doc_id", "row_id")).alias("top"), F.count(F.lit(1)).alias("group_size")
            ),
            "digest-groups",
        )
        batch_side = groups.repartition(self.buckets, "digest").hint("merge")
        earlier = self.rows().where(F.col("batch") != batch)
        fresh = batch_side.join(earlier, "digest", "left_anti").join(
            self.rows().where(F.col("batch") == batch).select("digest"), "digest", "left_anti"
        )
        self._write(fresh.select("digest", F.col("top.doc_id").alias("keep_id"), F.lit(batch).alias("batch")), self.name, {})
        if len(self.rows().inputFiles()) > MOST_FILES * self.buckets:
            self.compact()
        held = batch_side.join(self.rows(), "digest", "left").select(
            "digest", "group_size", "keep_id",
            F.when(F.col("batch") == batch, F.col("top.row_id")).alias("keep_row"),
        )
        return rows, park(held, "digest-held")

    def dedup(
        self, docs: DataFrame, batch: str | None = None, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None
    ) -> DataFrame:
        """Mark what stays of ``docs`` and append it to the index.

        Returns, for each row of ``docs``: doc_id, row_id (``row_column`` if named, else a number that tells
        repeated rows apart), keep_id (the id that stays: the one in the index for a text seen in an
        earlier batch, else the largest of this batch), group_size (rows of this batch with the text),
        kept, text_sha256.

        Null text counts as empty. A null id never wins over another id; rows that repeat id and text
        count separately and one of them is kept. Texts of any length are hashed whole. Only the id and
        the text are read, so further columns of any name do no harm. An empty batch gives no rows. A
        batch that runs again under its name after a failure gives the same rows: its own earlier entries
        don't count. Without a name each call is a batch of its own.
        """
        return _marked(*self.merge(docs, batch, id_column, text_column, row_column))


def _marked(rows: DataFrame, held: DataFrame) -> DataFrame:
    return join_hot(rows, held, "digest", "group_size", rows.count()).select(
        "doc_id", "row_id", "keep_id", "group_size",
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def mark_copies(docs: DataFrame, index: DigestIndex, row_column: str | None = None) -> DataFrame:
    """``dedup`` of ``docs`` in two batches through one index, largest ids first, so that the largest id stays.

    The upper half by doc_id fills the index, the lower half, with null ids, is compared with it; group_size
    counts both. Without a ``row_column`` rows are numbered, the same in both batches.
    """
    middle = F.percentile_approx("doc_id", 0.5).alias("middle")
    middle = docs.agg(middle).first()["middle"]
    numbered = docs.withColumn("__row", F.col(row_column) if row_column else F.monotonically_increasing_id())
    upper = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    merged = [index.merge(numbered.where(part), name, row_column="__row") for name, part in (("upper", upper), ("lower", ~upper))]
    rows = merged[0][0].unionByName(merged[1][0])
    held = merged[0][1].unionByName(merged[1][1]).groupBy("digest").agg(
        F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row")
    )
    return _marked(rows, park(held, "digest-all"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    try:
        found = park(mark_copies(table(spark, sf_dir, "documents"), index), "marked")
    finally:
        index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


NAME = "op8_exact_dedup"
SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
