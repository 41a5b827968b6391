"""The corpus pipeline: classify, drop exact copies, drop near copies, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return rows of documents with all their columns.
Stages read every row and whole texts; null texts count as empty; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectql.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from effectql.llm.common import exists, expire, park, scope, shared_dir, table, without_rows

#: The classifier has no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the others go. A table ``labels`` is used where there is one."""
    return quality.accepted(docs, quality.fit(docs, labels=table(spark, sf_dir, "labels") if exists(spark, sf_dir, "labels") else None))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, parked so that it stays; ids may repeat or be missing."""
    return park(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lower-cased: the largest doc_id. The index of the run takes two batches and is dropped."""
    rows = _numbered(docs)
    index = exact_dedup.DigestIndex(spark, f"pipeline_{uuid.uuid4().hex}")
    try:
        marked = exact_dedup.mark_copies(rows, index, row_column="__row")
        gone = park(marked.where("not kept").select(F.col("row_id").alias("__row")), "copies")
    finally:
        index.drop()
    return without_rows(rows, gone, ["__row"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: the smallest doc_id, a null one last."""
    rows = _numbered(docs)
    found = ngram_join.linked_rows(rows.withColumnRenamed("__row", "row"), ngram_join.Similarity(80, 5))
    gone = park(found.where("row <> first_row").select(F.col("row").alias("__row")), "near-copies")
    return without_rows(rows, gone, ["__row"]).select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that occur earlier; those left without words go."""
    return suffix_dedup.without_repeats(docs, unnamed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences."""
    return packing.pack(park(packing.token_pieces(docs), "pieces"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_passages),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage parked, and its input, is deleted once its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
            if last:
                expire(spark, last)
        docs, last = spark.read.parquet(path), path
    expire(spark, root)
    return docs
