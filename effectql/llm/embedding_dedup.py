"""Embedding near-dedup: a subspace pigeonhole join of vectors under one label.

Unit vectors whose cosine is t or more are no further apart than sqrt(2 - 2t). They are rotated, rounded to integers
and split into blocks of a few dimensions; of a pair in reach at least one block must keep to its share of the squared
distance. So each block is range-joined for itself: a tree of thresholds, drawn from a bounded sample, cuts its space into
cells; a vector lies at home in one cell and visits all those that its ball reaches into. What meets in a cell within
the block's share is verified by the cosine of the whole vectors in double precision. A pair that several blocks
find counts in the first of them alone, which integer distances tell without doubt.

Equal vectors are one class, verified once. Dense groups of near copies, which no cell can part, are taken apart
first: vectors within half the reach of a center are all linked with each other and so have no pairs to look at; only those
between half and one and a half times the reach are compared with them. Large cells are compared in tiles of
bounded size. No step emits pairs: a tile gives link counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, park, prepare, table
from .components import connected_components

#: Dimensions of a block; the last block may have fewer.
DIMENSIONS = 8
#: Rotated coordinates of unit vectors are rounded to this many steps; int16 holds them.
STEPS = 1 << 14
#: Vectors that the tree and the centers are drawn from.
SAMPLE = 4096
#: Vectors of a label that a cell should hold at home, levels of the tree at most, and levels of small labels.
CELL, LEVELS, LEAST_LEVELS = 512, 12, 2
#: A center stands for this share of the sample at least; there are at most 1 / SHARE of them for each sampled vector in reach.
SHARE = 1 / 128
#: Rows of a tile on either side, and rows of a tile that are compared at a time.
TILE, ROWS = 4096, 256
#: Cosines this near to the threshold are added up exactly.
NEAR = 1e-12

VECTOR = "node long, label string, size int, weight long, vector binary, turned binary, core int, near array<int>"
CELLS = pa.schema([("node", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("block", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


@cache
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of ``size`` dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by a power of two, so that no square over- or underflows."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def turned(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in integer steps."""
    return np.rint(units(vectors) @ rotation(vectors.shape[1]) * STEPS).astype(np.int16)


def blocks(size: int) -> list[slice]:
    return [slice(at, min(at + DIMENSIONS, size)) for at in range(0, size, DIMENSIONS)]


def reaches(size: int, threshold: float) -> list[int]:
    """Greatest integer squared distance of each block: its share, by dimensions, of the reach; rounding is allowed for."""
    whole = 2 - 2 * threshold + 1e-9
    return [math.ceil((math.sqrt(whole * (b.stop - b.start) / size) * STEPS + math.sqrt(b.stop - b.start) + 1) ** 2) for b in blocks(size)]


@dataclass
class Plan:
    """What every task knows: thresholds of each block's tree, levels by label, centers. All of it bounded by SAMPLE."""

    threshold: float
    size: int = 0  # vectors of this length have cells; others of a label meet in one
    trees: list[list[np.ndarray]] = field(default_factory=list)
    levels: dict[str, int] = field(default_factory=dict)
    centers: np.ndarray | None = None
    labels: list[str] = field(default_factory=list)

    @classmethod
    def drawn(cls, threshold: float, sample: list, total: int) -> Plan:
        """``sample``: label and vector of each sampled row, of ``total`` rows."""
        plan = cls(threshold)
        if not sample:
            return plan
        sizes = [len(v) for _, v in sample]
        plan.size = max(sorted(set(sizes)), key=sizes.count)
        kept = [(k, v) for k, v in sample if len(v) == plan.size]
        named = np.array([k for k, _ in kept])
        x = units(np.array([v for _, v in kept], np.float64))
        steps = np.rint(x @ rotation(plan.size) * STEPS).astype(np.int64)
        for label in set(named.tolist()):
            rows = max(1.0, total * float((named == label).mean()))
            plan.levels[label] = min(LEVELS, max(LEAST_LEVELS, math.ceil(math.log2(rows / CELL))))
        for b in blocks(plan.size):
            plan.trees.append(_tree(steps[:, b], max(plan.levels.values())))
        plan._center(x, named)
        return plan

    def _center(self, x: np.ndarray, named: np.ndarray) -> None:
        """Centers of dense groups of the sample, the densest first; each is the middle of what lies around a vector."""
        angle = math.acos(self.threshold)
        found, labels = [], []
        for label in sorted(set(named.tolist())):
            of = x[named == label]
            near = of @ of.T >= self.threshold
            left = np.ones(len(of), bool)
            while len(of):
                counts = (near & left).sum(1) * left
                top = int(counts.argmax())
                if counts[top] < max(4, SHARE * len(x)):
                    break
                group = near[top] & left
                left &= ~group
                middle = of[group].mean(0)
                middle /= np.linalg.norm(middle)
                if (of[group] @ middle >= math.cos(angle / 2 - 1e-9)).sum() * 2 >= counts[top]:
                    found.append(middle)
                    labels.append(label)
        if found:
            self.centers, self.labels = np.array(found), labels

    def cores(self, vectors: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the center whose core it is in, -1 without, and (vectors x centers) which centers it may have links to."""
        core = np.full(len(vectors), -1, np.int32)
        if self.centers is None or vectors.shape[1] != self.size:
            return core, np.zeros((len(vectors), 0), bool)
        angle = math.acos(self.threshold)
        cosine = np.where(labels[:, None] == np.array(self.labels)[None], units(vectors) @ self.centers.T, -2.0)
        best = cosine.argmax(1)
        inside = cosine[np.arange(len(best)), best] >= math.cos(angle / 2 - 1e-9)
        core[inside] = best[inside]
        return core, cosine >= math.cos(min(math.pi, 1.5 * angle + 1e-9))


def _tree(points: np.ndarray, levels: int) -> list[np.ndarray]:
    """Medians level by level; level k halves along dimension k (mod its number)."""
    node, tree = np.zeros(len(points), np.int64), []
    for k in range(levels):
        x = points[:, k % points.shape[1]]
        cut = np.zeros(1 << k, np.int64)
        order = np.lexsort((x, node))
        starts = np.searchsorted(node[order], np.arange((1 << k) + 1))
        for n in range(1 << k):
            if starts[n + 1] > starts[n]:
                cut[n] = x[order[(starts[n] + starts[n + 1] - 1) // 2]]
        tree.append(cut)
        node = 2 * node + (x > cut[node])
    return tree


def visited(points: np.ndarray, tree: list[np.ndarray], levels: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for all cells that the ball of each row reaches into, at the row's own level of the tree."""
    row = np.arange(len(points))
    node, home = np.zeros(len(points), np.int64), np.ones(len(points), bool)
    away = np.zeros(points.shape, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, cut in enumerate([*tree, None]):
        ends = levels[row] == k if cut is not None else np.ones(len(row), bool)
        if ends.any():
            done.append((row[ends], node[ends], home[ends]))
            row, node, home, away = row[~ends], node[~ends], home[~ends], away[~ends]
        if cut is None or not len(row):
            break
        d = k % points.shape[1]
        x, t = points[row, d].astype(np.int64), cut[node]
        right = x > t
        gap = np.where(right, x - t, t + 1 - x)  # to the nearest whole step on the other side
        further = away.copy()
        further[:, d] = np.maximum(further[:, d], gap)
        across = (further * further).sum(1) <= reach
        node = np.concatenate([2 * node + right, (2 * node + ~right)[across]])
        home = np.concatenate([home, np.zeros(int(across.sum()), bool)])
        away = np.concatenate([away, further[across]])
        row = np.concatenate([row, row[across]])
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _prepare(told, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of VECTOR from node, label, weight and vector (doubles)."""
    plan = told.value
    for batch in batches:
        vectors = batch.column("vector")
        sizes = np.diff(vectors.offsets.to_numpy())
        labels = np.array(batch.column("label").to_pylist(), object)
        flat = vectors.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out: list[list] = [[] for _ in range(8)]
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = flat[starts[rows][:, None] + np.arange(size)]
            core, near = plan.cores(x, labels[rows])
            steps = turned(x)
            for values, column in zip(out, (
                batch.column("node").take(pa.array(rows)).to_pylist(), labels[rows].tolist(), [int(size)] * len(rows), batch.column("weight").take(pa.array(rows)).to_pylist(),
                [v.tobytes() for v in x], [v.tobytes() for v in steps], core.tolist(), [np.flatnonzero(v).tolist() for v in near],
            ), strict=True):
                values += column
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()))
        names = ("node", "label", "size", "weight", "vector", "turned", "core", "near")
        yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=list(names))


def _stacked(column: pa.ChunkedArray | pa.Array, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def _cells(told, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All cells that each vector visits. Vectors of a core, and those near it, meet in a cell of block -1 instead."""
    plan = told.value
    for batch in batches:
        nodes, labels = batch.column("node").to_numpy(), np.array(batch.column("label").to_pylist(), object)
        sizes, core, near = batch.column("size").to_numpy(), batch.column("core").to_numpy(), batch.column("near").to_pylist()

        def made(rows, block, cell, home, labels=labels, nodes=nodes, sizes=sizes):
            return pa.record_batch(
                [pa.array(nodes[rows]), pa.array(labels[rows].tolist(), pa.string()), pa.array(sizes[rows]), pa.array(np.full(len(rows), block, np.int32)),
                 pa.array(cell.astype(np.int32)), pa.array(home)],
                schema=CELLS,
            )

        at = [(i, c, c == core[i]) for i, found in enumerate(near) for c in found if core[i] < 0 or c <= core[i]]
        if at:
            rows, cell, home = (np.array(x) for x in zip(*at, strict=True))
            yield made(rows, -1, cell, home)
        for size in np.unique(sizes[core < 0]):
            rows = np.flatnonzero((sizes == size) & (core < 0))
            steps = _stacked(batch.column("turned").take(pa.array(rows)), np.int16, size)
            known = size == plan.size
            levels = np.array([plan.levels.get(k, LEAST_LEVELS) if known else 0 for k in labels[rows]])
            for k, (b, reach) in enumerate(zip(blocks(size), reaches(size, plan.threshold), strict=True)):
                tree = plan.trees[k] if known else []
                row, cell, home = visited(steps[:, b], tree, np.minimum(levels, len(tree)), reach)
                yield made(rows[row], k, cell, home)


def _dots(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of the rows of ``x`` with those of ``y`` is at least ``threshold``."""
    found = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    linked = found >= threshold
    for k in np.flatnonzero(np.abs(found - threshold) < NEAR):
        a, b = x[k].tolist(), y[k].tolist()
        dot = math.fsum(p * q for p, q in zip(a, b, strict=True))
        linked[k] = dot / (math.sqrt(math.fsum(p * p for p in a)) * math.sqrt(math.fsum(q * q for q in b))) >= threshold
    return linked


def _tile(threshold: float):
    """Compares the vectors at home in a cell with all others there: link counts, and a spanning forest of the links."""

    def compared(rows: pa.Table) -> pa.Table:
        block, size = rows.column("block")[0].as_py(), rows.column("size")[0].as_py()
        role, nodes = rows.column("role").to_numpy(), rows.column("node").to_numpy()
        weight, core = rows.column("weight").to_numpy(), rows.column("core").to_numpy()
        steps = _stacked(rows.column("turned"), np.int16, size).astype(np.float64)
        vectors = _stacked(rows.column("vector"), np.float64, size)
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
        homes, others = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        parts, within = blocks(size), reaches(size, threshold)
        own = np.arange(size) if block < 0 else np.arange(size)[parts[block]]
        reach = float(math.ceil((math.sqrt(2 - 2 * threshold + 1e-9) * STEPS + math.sqrt(size) + 1) ** 2)) if block < 0 else float(within[block])
        left, right = steps[:, own], steps[others][:, own]  # whole numbers: products in doubles are exact
        sizes = (right * right).sum(1)

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for at in range(0, len(homes), ROWS):
            mine = homes[at : at + ROWS]
            apart = (left[mine] ** 2).sum(1)[:, None] - 2 * (left[mine] @ right.T) + sizes
            i, j = np.nonzero(apart <= reach)
            i, j = mine[i], others[j]
            # in a block's cell each pair has one home that counts; in a core's, members are linked among themselves already
            once = nodes[i] < nodes[j] if block >= 0 else core[i] != core[j]
            i, j = i[once], j[once]
            for lo in range(0, len(i), 1 << 14):
                x, y = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                for b, r in zip(parts[: max(0, block)], within, strict=False):
                    new = ((steps[x, b] - steps[y, b]) ** 2).sum(1) > r
                    x, y = x[new], y[new]
                linked = _dots(vectors[x], vectors[y], threshold)
                x, y = x[linked], y[linked]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = top(p), top(q)
                    parent[max(p, q)] = min(p, q)
        linked = np.flatnonzero(links)
        joined = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.table(
            [np.concatenate([nodes[linked], nodes[joined]]), pa.array([None] * len(linked) + nodes[[top(k) for k in joined]].tolist(), pa.int64()),
             np.concatenate([links[linked], np.zeros(len(joined), np.int64)])],
            schema=FOUND,
        )

    return compared


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells with the tiles (i, j) that each of their rows is in: role 1 at home, 0 as another, 2 as both.

    In a core's cell the members are never others: they are linked among themselves and compared with the rest only.
    """
    key = ["label", "size", "block", "cell"]
    counts = cells.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("rows"))
    others = F.when(F.col("block") < 0, F.col("rows") - F.col("homes")).otherwise(F.col("rows"))
    counts = counts.where("homes > 0 and rows > 1").select(*key, F.ceil(F.col("homes") / TILE).cast("int").alias("m"), F.ceil(others / TILE).cast("int").alias("n")).where("n > 0")
    i, j = F.pmod(F.xxhash64("node"), F.col("m")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")).cast("int")
    both = (F.col("block") >= 0) & F.col("home")
    across = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.when(both & (k == j), F.lit(2)).otherwise(F.lit(1)).alias("role")))
    down = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(0).alias("role")))
    tiles = F.when(both, F.concat(across, F.filter(down, lambda t: t["i"] != i))).when(F.col("home"), across).otherwise(down)
    return cells.join(counts.hint("merge"), key).select("node", *key, F.explode(tiles).alias("tile")).select("node", *key, "tile.*")


def linked_vectors(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their vectors equally long, and the cosine is at least
    ``threshold`` (above 0). Vectors that are null, empty or zero, or hold null, NaN or infinite components, and rows without
    label, are linked with nothing. Repeated rows count each. component_id is the least id reachable, null only
    if none there has one; kept tells whether it is the row's own (null and null count as equal).
    An empty table gives no rows. Only the named columns are read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col("vector")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0), F.lit(False))
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("vector"))
    # equal vectors get equal pairs of hashes; zeros lose their sign, as the hash tells -0.0 from 0.0
    plain = F.transform(x, lambda v: F.when(v == 0, F.lit(0).cast("double")).otherwise(v.cast("double")))
    named = named.withColumn("row", F.monotonically_increasing_id()).withColumn("vector", plain)
    usable = sound & F.col("label").isNotNull()
    read = park(named.withColumn("class", F.when(usable, F.struct("label", F.xxhash64("vector").alias("one"), F.xxhash64(F.lit(1), "vector").alias("two")))), "read")
    classes = read.where("class is not null").groupBy("class").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")
    )
    classes = park(classes.select("class", "class.label", "node", "weight", "least", "vector"), "classes")
    sample = classes.select("label", "vector", F.xxhash64("class").alias("at")).orderBy("at").limit(SAMPLE).select("label", "vector").collect()
    plan = Plan.drawn(threshold, [tuple(r) for r in sample], classes.count())
    told = spark.sparkContext.broadcast(plan)  # bounded by SAMPLE
    turned_ = park(classes.select("node", "label", "weight", "vector").mapInArrow(lambda b: _prepare(told, b), VECTOR), "turned")
    cells = turned_.select("node", "label", "size", "turned", "core", "near").mapInArrow(
        lambda b: _cells(told, b), "node long, label string, size int, block int, cell int, home boolean"
    )
    dealt = _dealt(park(cells, "cells"))
    tiles = dealt.hint("merge").join(turned_.select("node", "weight", "vector", "turned", "core"), "node")
    key = ["label", "size", "block", "cell", "i", "j"]
    found = park(tiles.groupBy(*key).applyInArrow(_tile(threshold), "a long, b long, links long"), "found")

    # the members of a core stand as one node, its least
    cores = turned_.where("core >= 0").groupBy("core").agg(F.min("node").alias("of_core"), F.sum("weight").alias("held"))
    cores = F.broadcast(park(cores, "cores"))  # at most 1 / SHARE rows
    members = turned_.select("node", "core", "weight").join(cores, "core", "left").select(
        "node", "weight", F.coalesce("of_core", "node").alias("top"), F.coalesce("held", "weight").alias("held"), F.col("of_core").isNotNull().alias("inside")
    )
    members = park(members, "members")
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    edges = found.where("b is not null").select("a", "b")
    tops = members.where("node <> top").select(F.col("node"), "top")
    for c in ("a", "b"):
        edges = edges.join(tops.hint("merge"), edges[c] == tops["node"], "left").withColumn(c, F.coalesce("top", c)).select("a", "b")
    comps = connected_components(members.select(F.col("top").alias("node")).distinct(), edges.where("a <> b"))
    comps = comps.select(F.col("node").alias("top"), "comp")
    comps = park(comps, "comps")
    of_cores = F.broadcast(comps.join(cores.select(F.col("of_core").alias("top")), "top", "left_semi"))  # all members of a core have one top
    comped = members.where("not inside").join(comps.hint("merge"), "top").unionByName(members.where("inside").join(of_cores, "top"))
    placed = comped.join(counted, "node", "left").select("node", "comp", (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"))
    placed = park(placed.join(classes.select("node", "class", "least", "weight"), "node"), "placed")
    total = placed.count()
    named_comps = park(placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    told_class = park(join_hot(placed, named_comps, "comp", "n", total).select("class", "n_links", "component_id", "weight"), "told")
    joined = join_hot(read.where("class is not null").select("vec_id", "class"), told_class, "class", "weight", read.count())
    alone = read.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


NAME = "op13_embedding_dedup"
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98
), reached AS (
  SELECT DISTINCT a, a AS b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN least USING (vec_id)
"""
