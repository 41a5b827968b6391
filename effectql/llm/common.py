"""Shared folders, parked tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one vectorised step holds at a time; its arrays take some 100 times as many.
SLICE_BYTES = 1 << 18

#: The paths that each open scope has parked; the innermost takes them.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is taken and set as the checkpoint folder if master
    and executors are one machine; else RuntimeError is raised, as executors would each write to a disk
    of their own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='effectql-')}")
    return sc.getCheckpointDir().rstrip("/")


#: Bytes (about) and rows of an Arrow batch at most: long texts come a few at a time, numbers by the thousand.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 8192


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, which executors and their workers hold outside the heap, and ship the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _folder(spark: SparkSession, path: str):
    """A path of the shared file system and that file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def expire(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the innermost scope ends, or else with the application."""
    where, system = _folder(spark, path)
    system.deleteOnExit(where)
    if scopes := _scopes.get():
        scopes[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    where, system = _folder(spark, path)
    system.delete(where, True)


def park(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors. The table lives as long as the innermost
    ``scope``, or, outside of any, as long as the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parked/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tidy(spark)
    expire(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between collections of the driver's garbage that ``park`` asks for; None: never.
TIDY_SECONDS: float | None = 5
_tidied = 0.0


def _tidy(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage, now and then.

    Executors keep the broadcasts and shuffles of a finished plan until its last reference on the driver
    is collected. An operator runs many short jobs that leave hardly any garbage on the driver, so that
    this would come about too late for executors of a few GB.
    """
    global _tidied
    if TIDY_SECONDS is not None and time.monotonic() - _tidied > TIDY_SECONDS:
        spark._jvm.System.gc()
        _tidied = time.monotonic()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables parked inside are deleted at the end; results that need them must be written before."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, sf_dir: str, name: str) -> bool:
    where, system = _folder(spark, f"{sf_dir}/{name}.parquet")
    return system.exists(where)


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``, a single row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(batch.schema.get_field_index(column)).nbytes
        if sizes <= limit:
            yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


#: Bits (as powers of two) of the bitmaps that keep rows out of a shuffle, and bits for each key.
LEAST_BITS, MOST_BITS, BITS_PER_KEY = 12, 24, 32


def marked_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``__hit``: true for all rows whose keys are in ``wanted`` and, by chance, for some others.

    A bitmap of the hashed keys is broadcast; it has BITS_PER_KEY bits for each key, 2^MOST_BITS at most
    (2 MB of bits, in 2^18 words). Where it fills up, more rows are hit by chance, which costs time and
    changes no result.
    """
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * wanted.count()).bit_length()))
    bit = F.xxhash64(*keys).bitwiseAND((1 << size) - 1)
    word, place = F.shiftright(bit, 6).cast("int"), bit.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    bits = wanted.groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))
    dealt = rows.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return dealt.withColumn("__hit", F.coalesce(F.getbit("__bits", place) == 1, F.lit(False))).drop("__word", "__bits")


def with_rows(rows: DataFrame, wanted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``wanted`` (parked) with ``columns`` of the rows that its keys name; no key is null.

    Of the other rows only those that the bitmap hits by chance take part in the join.
    """
    hit = marked_rows(rows, wanted, keys).where("__hit").select(*keys, *columns)
    return hit.hint("merge").join(wanted, keys).select(*wanted.columns, *columns)


def without_rows(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` but those whose keys are in ``gone``. Both are read twice and should be parked.

    Rows that the bitmap misses stay where they lie, the others are anti-joined; no key is null.
    """
    marked = marked_rows(rows, gone, keys)
    hit = marked.where("__hit").drop("__hit")
    kept = hit.hint("merge").join(gone.select(*keys), keys, "left_anti").select(*rows.columns)
    return marked.where("not __hit").select(*rows.columns).unionByName(kept)


#: A key that holds this share of all rows, or so many rows, is joined apart. Of ``total`` rows, at most
#: 1 / HOT_SHARE + total / HOT_ROWS keys do: 250,000 of 10^12 rows.
HOT_SHARE, HOT_ROWS = 1 / 200, 1 << 22


def join_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each key, with the number of rows in ``count``).

    Keys with many rows are joined by broadcast, which deals none of their rows anew; see HOT_SHARE for
    how many there can be. All others meet in a shuffled join. Both inputs are read twice and should be parked.
    """
    hot = groups.where(F.col(count) >= max(2, min(total * HOT_SHARE, HOT_ROWS))).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    columns = [*rows.columns, *(c for c in groups.columns if c != key)]
    cold = marked.where(F.col("__hot").isNull()).select(*rows.columns).join(groups.hint("merge"), key)
    return cold.select(columns).unionByName(marked.where("__hot").select(columns))


def numbered(
    rows: DataFrame, group: list[str], order: list[str], name: str, buckets: int | DataFrame = 64, spread: list[str] | None = None
) -> DataFrame:
    """Number the rows of each group gapless from 0, in no task more than a bucket of a group.

    Buckets come from a hash of ``spread`` (else ``order``); a bucket's first number is the sum of the
    counts before it. ``buckets`` is their number in every group, or a table of it (the group, buckets).
    There must be a bounded number of groups: the counts (groups x buckets) are broadcast.
    ``rows`` is read twice and should be parked.
    """
    from pyspark.sql import Window

    if isinstance(buckets, DataFrame):
        many = buckets.withColumnRenamed("buckets", "__buckets")
        dealt = rows.join(F.broadcast(many), group).withColumn("__bucket", F.pmod(F.xxhash64(*(spread or order)), F.col("__buckets"))).select(*rows.columns, "__bucket")
    else:
        dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*(spread or order)), F.lit(buckets)))
    keys = [*group, "__bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        dealt.withColumn("__place", place).join(F.broadcast(starts), keys)
        .withColumn(name, F.col("__from") + F.col("__place") - 1).drop("__bucket", "__place", "__from")
    )
