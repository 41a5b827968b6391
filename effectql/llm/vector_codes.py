"""Vector code compression: integer product codebooks, exact at every step.

Vectors become integers and are cut into parts, each with a codebook of its own. The codebooks (a bounded table,
``parts`` x ``entries``) are broadcast; Arrow batches find the nearest entry of each part from the expansion
|x - c|^2 = |x|^2 - 2 x c + |c|^2 with int64 matrix products, the first of equal ones. Each task adds up
the parts of each entry over all its batches, so that a round shuffles sums and counts of entries, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, park, prepare, table

#: Rows whose distances to a codebook are held at a time.
ROWS = 4096
#: Greatest size of an integer component: larger ones count as this, so that no sum of squares leaves 64 bits.
LARGEST = 1 << 24

PARTIAL = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
CODED = pa.schema([("vec_id", pa.int64()), ("group", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def usable(vector: str) -> F.Column:
    """Vectors that are not null and hold neither nulls nor NaN or infinite components."""
    x = F.col(vector)
    return F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def whole(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """``vectors`` with their components as integers, floor(scale x), in the array ``whole``."""
    near = F.transform(F.col(vector), lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    return vectors.withColumn("whole", near)


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The integer vectors of a batch: rows x parts x places. A last part that is too short is filled with zeros."""
    rows = batch.column("whole")
    flat = rows.flatten().to_numpy().reshape(batch.num_rows, -1)
    if short := -flat.shape[1] % parts:
        flat = np.pad(flat, ((0, 0), (0, short)))
    return flat.reshape(batch.num_rows, parts, -1)


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries, and its squared distance, for each row of ``x``; all in int64."""
    out, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    sizes = (codebook * codebook).sum(1)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        distances = (part * part).sum(1)[:, None] - 2 * (part @ codebook.T) + sizes
        out[at : at + ROWS] = found = distances.argmin(1)
        far[at : at + ROWS] = distances[np.arange(len(part)), found]
    return out, far


def _sums(books: Callable[[], np.ndarray], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of the parts by their nearest entry, once for a task."""
    codebooks = books()
    parts, entries, places = codebooks.shape
    total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, parts)
            for j in range(parts):
                found, _ = nearest(x[:, j], codebooks[j])
                order = np.argsort(found, kind="stable")
                used, start = np.unique(found[order], return_index=True)
                total[j, used] += np.add.reduceat(x[order, j], start)
                count[j, used] += np.diff(np.append(start, len(order)))
    part, entry = (v.astype(np.int32) for v in np.nonzero(count))
    for at in range(0, len(part), 256):
        p, e = part[at : at + 256], entry[at : at + 256]
        yield pa.record_batch(
            [np.repeat(p, places), np.repeat(e, places), np.tile(np.arange(places, dtype=np.int32), len(p)), total[p, e].reshape(-1), np.repeat(count[p, e], places)],
            schema=PARTIAL,
        )


def _codes(books: Callable[[], np.ndarray], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, group, code and error of each vector."""
    codebooks = books()
    digits = max(2, len(f"{codebooks.shape[1] - 1:x}"))
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, len(codebooks))
            found, far = zip(*(nearest(x[:, j], book) for j, book in enumerate(codebooks)), strict=True)
            codes = ["".join(f"{k:0{digits}x}" for k in row) for row in np.stack(found, 1).tolist()]
            yield pa.record_batch([batch.column("vec_id"), batch.column("group"), pa.array(codes, pa.string()), pa.array(np.sum(far, 0))], schema=CODED)


class VectorCodes:
    """Codebooks fitted to a table of vectors, and the code of each.

    Vectors are dropped if they are null or empty or hold null or non-finite components, or if their length is not
    that of the first vector kept (by id, then by components). Components beyond +-2^24 / scale count as that much.
    A length that is no multiple of ``parts`` is filled up with zeros. Codebooks start as the ``entries`` vectors of
    least id, a null id last, equal ids in the order of their components; with fewer vectors, of all. An empty entry stays.
    Repeated rows count each. A table without usable vectors has no rows. Only the named columns are read.
    """

    def __init__(self, vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
                 id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"):
        self.spark = spark = vectors.sparkSession
        prepare(spark)
        self.parts = parts
        named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("vector"))
        kept = park(whole(named.where(usable("vector")), "vector", scale).drop("vector"), "vectors")
        order = [F.col("vec_id").asc_nulls_last(), "whole"]
        first = kept.orderBy(*order).select("whole").first()
        size = len(first["whole"]) if first else 0
        self.kept = kept.where(F.size("whole") == size)
        start = self.kept.orderBy(*order).limit(entries).select("whole").collect()
        flat = np.array([r["whole"] for r in start], np.int64).reshape(len(start), size)
        self.codebooks = np.ascontiguousarray(np.pad(flat, ((0, 0), (0, -size % parts))).reshape(len(start), parts, -(-size // parts)).transpose(1, 0, 2))
        for _ in range(rounds if start else 0):
            self._round()

    def _told(self) -> Callable[[], np.ndarray]:
        books = self.spark.sparkContext.broadcast(self.codebooks)  # parts x entries x places, whatever the number of vectors
        return lambda: books.value

    def _round(self) -> None:
        sums = self.kept.select("whole").mapInArrow(partial(_sums, self._told()), "part int, entry int, place int, total long, n long")
        merged = sums.groupBy("part", "entry", "place").agg(F.call_function("div", F.sum("total") - F.pmod(F.sum("total"), F.sum("n")), F.sum("n")).alias("mean"))
        moved = self.codebooks.copy()
        for r in merged.collect():  # of the codebooks' own size
            moved[r["part"], r["entry"], r["place"]] = r["mean"]
        self.codebooks = moved

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimal numbers between commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """vec_id, code, error, label_error: a row for each vector kept."""
        rows = self.kept.select("vec_id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("group"), "whole")
        rows = park(rows.mapInArrow(partial(_codes, self._told()), "vec_id long, group string, code string, error long"), "codes")
        groups = park(rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
        return join_hot(rows, groups, "group", "n", rows.count()).select("vec_id", "code", "error", "label_error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = VectorCodes(table(spark, sf_dir, "embeddings"))
    return fitted.codes().withColumn("codebooks_sha256", F.lit(fitted.digest()))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    def assigned(k: int) -> str:
        """For each part the distance x entries + entry of its nearest entry, the first of equal ones."""
        distance = "list_inner_product(p.w, p.w) - 2 * list_inner_product(p.w, c.w) + list_inner_product(c.w, c.w)"
        return f"SELECT p.vec_id, p.part, min(CAST({distance} AS BIGINT) * {entries} + c.entry) AS best FROM p JOIN c{k} c USING (part) GROUP BY ALL"

    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({assigned(k)})")
        steps.append(f"""s{k} AS (
  SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT part, best % {entries} AS entry, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM a{k} JOIN p USING (vec_id, part)) GROUP BY ALL
), m{k} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS w FROM s{k} GROUP BY ALL
), c{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN m{k} m USING (part, entry)
)""")
    return f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w, len(embedding) // {parts} AS n FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT vec_id, label, part, w[part * n + 1 : part * n + n] AS w FROM q, range({parts}) t(part)
), c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, w FROM p QUALIFY entry < {entries}
), {", ".join(steps)}, last AS MATERIALIZED ({assigned(rounds)}), coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM last GROUP BY vec_id
), told AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM c{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN q USING (vec_id), told
"""


NAME = "op11_vector_codes"
SQL = _sql()
