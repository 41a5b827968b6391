"""Best-fit packing of token sequences by exact complements.

How many pieces there are of each length is all a plan needs: at most ``capacity`` counts. The plan
goes from the longest length down, fills the gap exactly with one, two or three pieces where their sums
are in the index and pieces are left, and best-fits what has no complement. Each of its patterns is a
list of lengths and how often it is used. Pieces then find their place by their number among the pieces
of their length, so no task sees more than its own rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, read_source, tokenizer
from .common import numbered, park, prepare, table, text_slices

CAPACITY = 4096
#: The id that ends a document.
END = 1
#: Pieces of a length that one task numbers, at most (about).
BUCKET = 100_000


@dataclass
class Complements:
    """Availability counts by length, and which sums of one, two and three lengths exist, as bits."""

    left: np.ndarray
    single: int = 0
    pair: int = 0
    triple: int = 0
    stale: int = 0
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.index()

    def index(self) -> None:
        self.lengths = np.flatnonzero(self.left)
        mask = (1 << len(self.left)) - 1
        self.single = sum(1 << int(n) for n in self.lengths)
        self.pair = self.triple = 0
        for n in self.lengths.tolist():
            self.pair |= self.single << n & mask
        for n in self.lengths.tolist():
            self.triple |= self.pair << n & mask
        self.stale = 0

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if self.left[n] == 0:
                self.single &= ~(1 << n)
                self.stale += 1
        if self.stale > 64:
            self.index()

    def fits(self, lengths: list[int]) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in set(lengths))

    def _pair(self, gap: int, used: list[int]) -> list[int] | None:
        half = np.arange(gap // 2, 0, -1)
        found = half[(self.left[half] > 0) & (self.left[gap - half] > 0)]
        for a in found[::-1].tolist():
            if self.fits([*used, gap - a, a]):
                return [gap - a, a]
        return None

    def exact(self, gap: int, used: list[int]) -> list[int] | None:
        """One, two or three available lengths that sum to ``gap``, besides those ``used``; longest first."""
        if self.single >> gap & 1 and self.fits([*used, gap]):
            return [gap]
        if self.pair >> gap & 1 and (found := self._pair(gap, used)):
            return found
        if self.triple >> gap & 1:
            for a in self.lengths[self.lengths <= gap - 2][::-1].tolist():
                if a * 3 < gap:
                    break
                if self.left[a] and self.pair >> (gap - a) & 1 and (rest := self._pair(gap - a, [*used, a])):
                    return [a, *rest]
        return None

    def longest(self, gap: int, used: list[int]) -> int | None:
        for n in self.lengths[self.lengths <= gap][::-1].tolist():
            if self.left[n] > used.count(n):
                return n
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, times used) that pack ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    c = Complements(left)
    out: list[tuple[list[int], int]] = []
    for n in range(capacity, 0, -1):
        while left[n]:
            pattern, gap = [n], capacity - n
            while gap:
                found = c.exact(gap, pattern)
                if found:
                    pattern += found
                    break
                best = c.longest(gap, pattern)
                if best is None:
                    break
                pattern.append(best)
                gap -= best
            times = min(int(left[k]) // pattern.count(k) for k in set(pattern))
            needed = {k: pattern.count(k) for k in set(pattern)}
            for k, m in needed.items():
                c.take([k], times * m)
            out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, pieces in a sequence, first sequence and offsets of each use in a pattern."""
    found: dict[int, list[tuple]] = {}
    numbers: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in pattern:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, o in offsets.items():
            start = numbers.get(n, 0)
            found.setdefault(n, []).append((start, len(o), first, o))
            numbers[n] = start + len(o) * times
        first += times
    out = {}
    for n, uses in found.items():
        ends = np.cumsum([len(u[3]) for u in uses])
        out[n] = (
            np.array([u[0] for u in uses], np.int64), np.array([u[1] for u in uses], np.int64),
            np.array([u[2] for u in uses], np.int64), ends - [len(u[3]) for u in uses],
            np.array([x for u in uses for x in u[3]], np.int64),
        )
    return out


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut every ``capacity`` ids.

    Null and empty texts have the end id alone. Repeated rows each give their pieces; only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = spark.sparkContext.broadcast(read_source(path or default_path()))
    end, step = END.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(source.value)
        for batch in text_slices(batches):
            ids = t.encode_batch([x or "" for x in batch.column(1).to_pylist()])
            rows, out = [], []
            for i, x in enumerate(ids):
                x += end
                for k in range(0, len(x), step):
                    part = x[k : k + step]
                    rows.append(i)
                    out.append((k // step, k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 5 if with_ids else 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECES + (", ids binary" if with_ids else "")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start, length and ids_crc32.

    ``pieces`` is read three times and should be parked. Lengths run from 1 to ``capacity``; another one
    raises ValueError. Ties between pieces of a length go by doc_id, piece and ids_crc32. The histogram
    that the driver reads has at most ``capacity`` rows, the plan as many patterns in proportion.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    where = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    # as many buckets as a length's pieces ask for: some hundred rows in each at first, then at most BUCKET
    dealt = [(n, max(min(64, c // 256), c // BUCKET, 1)) for n, c in counts.items()]
    buckets = pieces.sparkSession.createDataFrame(dealt, "length int, buckets long")
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "number", buckets)
    columns = [*pieces.columns, "number"]
    at = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(at["length"]))
            numbers = np.asarray(batch.column(at["number"]))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1)).tolist() + [len(order)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows = order[a:b]
                first, each, base, begin, offsets = where.value[int(lengths[rows[0]])]
                use = np.searchsorted(first, numbers[rows], "right") - 1
                copy, slot = np.divmod(numbers[rows] - first[use], each[use])
                sequence[rows] = base[use] + copy
                offset[rows] = offsets[begin[use] + slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns[:-1], "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*columns).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = park(token_pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(pieces).withColumn("length", F.col("length").cast("long"))


NAME = "op2_packing"
SQL = None
