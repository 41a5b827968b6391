"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles. Two of them link when their Jaccard similarity reaches a threshold.

1. Rows of the same set become one node.
2. Nodes that share a least hash are compared with a few centers of their group as they stream by; those
   close enough join a star. A large group streams by in many stretches at once, and the centers of these
   again, until no stars join; so it becomes a few stars, with no pairs in it and no long stretch.
3. Shingles that lie in the prefixes of many stars, or in many near copies of a group, are a frequent
   class. In the order "rare first, then by hash" each node takes the prefix that any partner must meet.
   Rare shingles are signatures of their own. Where they don't make up the prefix it is extended, and
   frequent ones are signatures in combinations of two. Prefixes of rare shingles are longer by a
   twentieth of the set and as many signatures more must be shared, so that sets with a passage in common
   drop out; sets met by a combination only differ in all their rare shingles, which excludes most.
4. Stars that share a signature and may be near enough in size are compared by their centers; the list of
   a signature that is long is cut into blocks, and each pair of blocks is a task of its own. There, pairs
   whose bitmaps tell that they are too far apart are not formed: many near copies that just don't link share
   many signatures. Distances of sets obey the triangle inequality, so what centers and radii cannot decide
   is little; those members are compared by their own signatures.
5. Linked stars grow into components.

No link between different sets is lost: steps 2 and 4 only skip pairs that already are in one component or
cannot link. The order and the frequent class are shared by all nodes, but for right results any would do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, park, prepare, table, text_slices, with_rows
from .components import connected_components
from .wordhash import mix, shingle_sets, words_of

#: Classes of frequent shingles (by hash); each asks for two of them together.
CLASSES = 4
#: A shingle is frequent if more stars than this have it in their prefix.
FREQUENT = 32
#: Frequent shingles that are broadcast at most; the least count is raised until they are no more.
MOST_FREQUENT = 1 << 20
#: Sets up to this size also have each of their shingles as a signature.
TINY = 12
#: Nodes in a streamed group, shingles of it that are held at a time, and centers of each such stretch.
GROUP, GROUP_SHINGLES, CENTERS = 256, 1_000_000, 16
#: Keys of a signature that are paired in one task; longer lists are dealt by pairs of their blocks.
LIST = 512
#: Bits of a set's bitmap, a multiple of 64; see ``_bitmaps``.
BITS = 1024
_STAR = ["sid", "center", "shared", "n", "center_n", "token"]
PREFIX, ALL_RARE = -1, -2
LONG_LIST = -1
_OTHER = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Similarity:
    """Sets link if 100 x shared >= percent x united; shingles have ``words`` words."""

    percent: int = 80
    words: int = 5

    def prefix(self, n: int) -> int:
        """Elements of which a linked set must share one, whatever their order."""
        return n + (-self.percent * n // 100) + 1

    def apart(self, n: int) -> int:
        """Elements that a linked set of any size may lack or have besides, at most."""
        return (100 - self.percent) * (n + n * 100 // self.percent) // (100 + self.percent)


def _more(n):
    """Signatures that linked sets must share besides one: the prefix is longer by as many."""
    return n // 20


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scan(docs: DataFrame, words: int, make, schema: str) -> DataFrame:
    """``make`` (row values, their bounds) for slices of (row, doc_id, text); it gives the columns behind doc_id."""
    names = ["row", "doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values, first = shingle_sets(words_of(batch.column(2)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *make(values, first)], names)

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id long, {schema}")


def _set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ _OTHER), dtype=np.uint64)))
    sizes = np.diff(first).astype(np.uint64)
    return mix((total[first[1:]] - total[first[:-1]]) ^ mix(sizes))


def _bitmaps(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set a bitmap: each element flips one bit, which its hash names.

    Two bitmaps differ in no more bits than one set has elements that the other one lacks, both ways.
    """
    out, step = [], 256
    bits = (mix(values ^ _OTHER) % np.uint64(BITS)).astype(np.int64)
    for start in range(0, len(first) - 1, step):
        bounds = first[start : start + step + 1]
        n = len(bounds) - 1
        at = np.repeat(np.arange(n), np.diff(bounds)) * BITS + bits[bounds[0] : bounds[-1]]
        odd = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8)
        out += [x.tobytes() for x in np.packbits(odd.reshape(n, BITS), axis=1)]
    return out


def describe(docs: DataFrame, by: Similarity) -> DataFrame:
    """row, doc_id, sid (identity of the set, null without words), n, two least hashes and the plain prefix of each row."""

    def make(values: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        n = np.diff(first)
        sid = pa.array(_set_ids(values, first).view(np.int64), mask=n == 0)
        least = []
        for x in (values, mix(values ^ _OTHER)):
            got = np.zeros(len(n), np.uint64)
            if len(x):
                got[n > 0] = np.minimum.reduceat(x, first[:-1][n > 0])
            least.append(_signed(got))
        windows = [values[a : a + by.prefix(k)].tobytes() for a, k in zip(first[:-1].tolist(), n.tolist(), strict=True)]
        return [sid, pa.array(n, pa.int64()), *least, pa.array(windows, pa.binary())]

    return _scan(docs, by.words, make, "sid long, n long, least1 long, least2 long, window binary")


def _similarity(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def stars(docs: DataFrame, nodes: DataFrame, least: str, by: Similarity) -> DataFrame:
    """Stars among nodes that share their least hash, and the shingles that are frequent there.

    Rows with sid: a node that links with a center (sid, center, shared, n, center_n). Rows without: a
    token that more than FREQUENT nodes of a group have. A group streams by in stretches of bounded size.
    In each the nodes with the fewest rare shingles become centers first; what they are near copies of
    has fewer than they.
    """
    groups = park(nodes.groupBy(least).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "least")
    wanted = park(
        join_hot(nodes, groups, least, "__n", nodes.count()).select(
            "row", "sid", F.col(least).alias("key"),
            F.pmod(F.xxhash64("sid"), F.ceil(F.col("__n") / GROUP).cast("int")).alias("salt"),
        ),
        "star-candidates",
    )
    rows = with_rows(docs, wanted, ["row"], ["text"]).select("key", "salt", "sid", "text").repartition("key", "salt").sortWithinPartitions("key", "salt", "sid")

    def links(held: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        sizes = np.array([len(s) for _, s in held])
        tokens, inverse, counts = np.unique(np.concatenate([s for _, s in held]), return_inverse=True, return_counts=True)
        for t in tokens[counts > FREQUENT].view(np.int64).tolist():
            yield None, None, None, None, None, t
        owner = np.repeat(np.arange(len(held)), sizes)
        rare = np.bincount(owner, counts[inverse] <= max(1, len(held) // 50), minlength=len(held))
        centers: list[tuple[int, np.ndarray]] = []
        for i in np.lexsort((sizes, rare)).tolist():
            sid, mine = held[i]
            for other, center in centers:
                if other == sid or 100 * min(len(mine), len(center)) < by.percent * max(len(mine), len(center)):
                    continue
                shared = _similarity(mine, center)
                if 100 * shared >= by.percent * (len(mine) + len(center) - shared):
                    yield sid, other, shared, len(mine), len(center), None
                    break
            else:
                if len(centers) < CENTERS and all(sid != c for c, _ in centers):
                    centers.append((sid, mine))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (out := list(links(held))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _STAR)

        for batch in text_slices(batches):
            values, first = shingle_sets(words_of(batch.column(3)), by.words)
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for i, (key, sid) in enumerate(zip(keys, batch.column(2).to_pylist(), strict=True)):
                if key != group or size > GROUP_SHINGLES:
                    yield from flush()
                    group, held, size = key, [], 0
                held.append((sid, values[first[i] : first[i + 1]].copy()))
                size += int(first[i + 1] - first[i])
        yield from flush()

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _STAR))


def settled(docs: DataFrame, nodes: DataFrame, least: str, by: Similarity) -> tuple[DataFrame, DataFrame]:
    """Stars (sid, center, far: no less than their distance), and the tokens that are frequent in their groups.

    Groups of several stretches go again with their centers alone, until no center joins another one.
    Each such link is one of the join, so what hangs together stays in one component.
    """
    levels, level = [], nodes
    while True:
        found = park(stars(docs, level, least, by), f"{least}-stars-{len(levels)}")
        levels.append(found)
        crowded = level.groupBy(least).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > GROUP).select(least)
        heads = found.where("sid is not null").select(F.col("center").alias("sid")).distinct()
        if crowded.isEmpty() or heads.isEmpty():
            break
        level = park(level.join(heads, "sid", "left_semi").join(crowded, least, "left_semi"), f"{least}-centers-{len(levels)}")
        if level.isEmpty():
            break
    far = 1 - F.col("shared") / (F.col("n") + F.col("center_n") - F.col("shared"))
    star, tokens = None, None
    for found in levels:
        joined = found.where("sid is not null").dropDuplicates(["sid"]).select("sid", "center", far.alias("far"))
        told = found.where("sid is null").select("token")
        if star is None:
            star, tokens = joined, told
            continue
        up = joined.select(F.col("sid").alias("center"), F.col("center").alias("up"), F.col("far").alias("more"))
        lifted = star.join(up, "center", "left").select("sid", F.coalesce("up", "center").alias("center"), (F.col("far") + F.coalesce("more", F.lit(0.0))).alias("far"))
        star, tokens = lifted.unionByName(joined), tokens.unionByName(told)
    return park(star, f"{least}-joined"), tokens


def frequent(described: DataFrame, centers: DataFrame, in_groups: DataFrame) -> np.ndarray:
    """Shingles in the plain prefixes of more than FREQUENT stars, or frequent in a group; sorted, at most MOST_FREQUENT.

    ``in_groups`` has a token for each group that it is frequent in; it counts as FREQUENT + 1 each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["token"])

    windows = described.join(centers.select("row"), "row").select("window")
    plain = windows.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    grouped = in_groups.groupBy("token").agg((F.count(F.lit(1)) * (FREQUENT + 1)).alias("n"))
    both = plain.where(F.col("n") > FREQUENT).unionByName(grouped).groupBy("token").agg(F.sum("n").alias("n"))
    counts = park(both, "frequent")
    least = FREQUENT
    while counts.where(F.col("n") > least).count() > MOST_FREQUENT:
        least *= 2
    rows = counts.where(F.col("n") > least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, by: Similarity, common: np.ndarray) -> DataFrame:
    """row, doc_id, sid, n, rare (shingles that aren't frequent), the signatures (binary, 64 bits each) and the bitmap of each row.

    A set with a prefix of rare shingles has those as signatures. Another has all its rare shingles and
    combinations of its first frequent ones; the combinations find partners that share no rare shingle,
    and those differ in all the rare shingles of both, which bounds how many there may be.
    """
    known = docs.sparkSession.sparkContext.broadcast(common)

    def of(s: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of single shingles and of combinations."""
        n = len(s)
        none = np.zeros(0, np.uint64)
        if n == 0:
            return none, none
        rare = s[~often]
        if len(rare) >= by.prefix(n) + _more(n):
            single = [mix(rare[: by.prefix(n) + _more(n)])]
            pairs = []
        else:
            single, pairs = [mix(rare)], []
            rest = s[often][: by.prefix(n) + CLASSES - len(rare)]
            if len(rare) <= by.apart(n):
                for k in range(CLASSES):
                    c = rest[(rest >> np.uint64(7)) % np.uint64(CLASSES) == k]
                    if len(c) > 1:
                        a, b = np.triu_indices(len(c), 1)
                        pairs.append(mix(mix(c[a]) + c[b] * _OTHER))
        if n <= TINY:
            single.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        return np.concatenate(single), np.concatenate([none, *pairs])

    def make(values: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        common = known.value
        often = np.zeros(len(values), bool)
        if len(common) and len(values):
            often = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
        n = np.diff(first)
        made = [of(values[a:b], often[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        rare = n - np.diff(np.concatenate(([0], np.cumsum(often)))[first])
        return [
            pa.array(_set_ids(values, first).view(np.int64), mask=n == 0), pa.array(n, pa.int64()), pa.array(rare, pa.int64()),
            pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary()),
            pa.array(_bitmaps(values, first), pa.binary()),
        ]

    return _scan(docs, by.words, make, "sid long, n long, rare long, signatures binary, combinations binary, bits binary")


def candidates(signed: DataFrame, by: Similarity, apart: bool = False, about: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a < b) of keys that share as many signatures as they must and may be near enough in size.

    ``signed``: key, part, n, rare, signatures, combinations. Rows of a signature stream by in order;
    those of one key are drawn together first. With ``apart``, pairs within a part are left out. With ``about``
    (key, size, reach, bits: a set of each key, and how far from it the others behind the key are at most), pairs
    of long lists are formed only where the bitmaps of these sets allow of a link.
    """
    # rare is negative for single shingles: PREFIX of sets that have a whole prefix of them, else ALL_RARE
    names = ["sig", "key", "part", "n", "rare"]

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "signatures"):
            for place, combined in ((4, False), (5, True)):
                raw = batch.column(place).to_pylist()
                rows = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                if len(rows):
                    kept = [batch.column(k).take(pa.array(rows)) for k in range(3)]
                    rare = np.asarray(batch.column(3), dtype=np.int64)
                    if not combined:
                        n = np.asarray(batch.column(2), dtype=np.int64)
                        rare = np.where(rare < by.prefix(n) + _more(n), ALL_RARE, PREFIX)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), *kept, pa.array(rare[rows])], names)

    def merged(sig, key, part, n, rare, most=None, count=None) -> tuple:
        """One row for each key of a signature: sig, key, part, least and most n, least rare, number of sets."""
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        count = np.ones(len(sig), np.int64) if count is None else count
        made = (f.reduceat(x, starts) for f, x in ((np.minimum, n), (np.maximum, n if most is None else most), (np.minimum, rare), (np.add, count)))
        return sig[starts], key[starts], part[starts], *made

    def paired(sig, key, part, least, most, low, count, size=None, reach=None, bits=None, block=None) -> Iterator[pa.RecordBatch]:
        """Pairs within each signature; with ``block``, only those between different blocks; with ``bits``, only those near enough by these."""
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        sig, key, part, least, most, low, count = (x[shared] for x in (sig, key, part, least, most, low, count))
        block, size, reach, bits = (None if x is None else x[shared] for x in (block, size, reach, bits))
        alone = count == 1  # a single set stands behind the key
        step = 1
        i = np.arange(len(sig))
        while len(i):
            i = i[i + step < len(sig)]
            i = i[sig[i] == sig[i + step]]
            j = i + step
            fits = (100 * most[i] >= by.percent * least[j]) & (100 * most[j] >= by.percent * least[i])
            if apart:
                fits &= part[i] != part[j]
            if block is not None:
                fits &= block[i] != block[j]
            # sets that share no rare shingle differ in all of them, and in what they have more of the others
            differ = low[i] + low[j] + np.abs((least[i] - low[i]) - (least[j] - low[j]))
            near = differ * (100 + by.percent) <= (100 - by.percent) * (least[i] + least[j])
            fits &= (low[i] < 0) | ~(alone[i] & alone[j]) | near
            a, b = i[fits], j[fits]
            if bits is not None and len(a):
                apart_by = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)  # elements, at least
                within = 2 * apart_by / (size[a] + size[b] + apart_by) <= 1 - by.percent / 100 + reach[a] + reach[b] + 1e-9
                a, b = a[within], b[within]
            if len(a):
                more = np.where((low[a] == PREFIX) | (low[b] == PREFIX), _more(np.minimum(least[a], least[b])), 0)
                zero = np.zeros(len(a), np.int64)
                yield listed(np.minimum(key[a], key[b]), np.maximum(key[a], key[b]), 1 + more, zero, zero, zero, zero, zero)
            step += 1

    pair = ["a", "b", "need", "part", "least", "most", "low", "count"]

    def listed(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], pair)

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of short lists (a, b, need); long lists go on as they are (key, sig, LONG_LIST, ...)."""
        held = [np.zeros(0, np.int64)] * 5
        long: int | None = None  # the signature whose list has gone on already

        def handed_on(rows) -> pa.RecordBatch:
            sig, key, part, least, most, low, count = merged(*rows)
            return listed(key, sig, np.full(len(sig), LONG_LIST, np.int64), part, least, most, low, count)

        def short(rows) -> Iterator[pa.RecordBatch]:
            if len(rows[0]) == 0:
                return
            made = merged(*rows)
            bounds = np.flatnonzero(np.concatenate(([True], made[0][1:] != made[0][:-1], [True])))
            many = np.repeat(np.diff(bounds) > LIST, np.diff(bounds))
            yield from paired(*(x[~many] for x in made))
            if many.any():
                sig, key, *rest = (x[many] for x in made)
                yield listed(key, sig, np.full(len(sig), LONG_LIST, np.int64), *rest)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [np.concatenate((h, np.asarray(batch.column(k), dtype=np.int64))) for k, h in enumerate(held)]
            if long is not None and rows[0][0] == long:
                end = int(np.searchsorted(rows[0], long, "right"))
                yield handed_on([x[:end] for x in rows])
                rows = [x[end:] for x in rows]
                if len(rows[0]) == 0:
                    held = rows
                    continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last signature may go on
            yield from short([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if len(held[0]) > 4 * LIST:
                long = int(held[0][0])
                yield handed_on(held)
                held = [x[:0] for x in held]
        yield from short(held)

    def block_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of two blocks of a list, (sig, one, other, block, key, part, least, most, low, count) in order; size, reach and bits may follow."""
        held: list[np.ndarray] = []

        def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
            plain = [np.asarray(batch.column(k)) for k in range(min(batch.num_columns, 12))]
            if batch.num_columns > 12:
                plain.append(np.frombuffer(b"".join(batch.column(12).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            return plain

        def within(rows) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                sig, one, other, block, *rest = rows
                task = np.cumsum(np.concatenate(([0], (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1]))))
                for within_block in (True, False):
                    mine = (one == other) == within_block
                    if mine.any():
                        yield from paired(task[mine], *(x[mine] for x in rest), block=None if within_block else block[mine])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [np.concatenate(x) for x in zip(held, columns(batch), strict=True)] if held else columns(batch)
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from within([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held:
            yield from within(held)

    exploded = signed.select("key", "part", "n", "rare", "signatures", "combinations").mapInArrow(unpack, ", ".join(f"{c} long" for c in names))
    ordered = exploded.repartition("sig").sortWithinPartitions("sig", "key")
    schema = ", ".join(f"{c} long" for c in pair)
    found = park(ordered.mapInArrow(pairs, schema), "listed")
    direct = found.where(F.col("need") != LONG_LIST)
    lists = found.where(F.col("need") == LONG_LIST)
    if not lists.isEmpty():
        lists = park(
            lists.groupBy(F.col("b").alias("sig"), F.col("a").alias("key")).agg(
                F.min("part").alias("part"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("low").alias("low"), F.sum("count").alias("count")
            ),
            "long-lists",
        )
        if about is not None:
            told = about.select("key", F.col("size").cast("long"), F.col("reach").cast("double"), "bits")
            lists = park(lists.join(told, "key").select(*lists.columns, "size", "reach", "bits"), "long-lists-told")
        blocks = park(lists.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("__blocks"), F.count(F.lit(1)).alias("__n")), "blocks")
        placed = join_hot(lists, blocks, "sig", "__n", lists.count()).withColumn("block", F.pmod(F.xxhash64("key", "sig"), F.col("__blocks")))
        dealt = placed.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).select(
            "sig", F.least("block", "x").alias("one"), F.greatest("block", "x").alias("other"), "block", *lists.columns[1:]
        )
        dealt = dealt.repartition("sig", "one", "other").sortWithinPartitions("sig", "one", "other", "key")
        direct = direct.unionByName(dealt.mapInArrow(block_pairs, schema))
    shared = direct.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"))
    return shared.where("shared >= need").select("a", "b")


def compare(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, by: Similarity) -> DataFrame:
    """a, b, shared, n_a, n_b for pairs of nodes, by their whole sets.

    The text of ``a`` goes ahead of those of its partners, once for every GROUP of them.
    """
    pairs = park(pairs, "pairs")
    each = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n"))
    sides = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    texts = park(with_rows(docs, park(nodes.select("row", "sid").join(sides, "sid").select("row", "sid"), "compared"), ["row"], ["text"]).select("sid", "text"), "compared-texts")
    parts = F.ceil(F.col("__n") / GROUP).cast("int")
    heads = (
        texts.join(each, texts["sid"] == each["a"]).select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("sid").alias("b"), "text")
    )
    salted = pairs.join(each, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt"))
    tails = texts.join(salted, texts["sid"] == salted["b"]).select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    rows = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, head = None, np.zeros(0, np.uint64)
        for batch in text_slices(batches):
            values, first = shingle_sets(words_of(batch.column(4)), by.words)
            out = []
            columns = (batch.column(k).to_pylist() for k in (0, 1, 2, 3))
            for i, (a, salt, kind, b) in enumerate(zip(*columns, strict=True)):
                mine = values[first[i] : first[i + 1]]
                if kind == 0:
                    whose, head = (a, salt), mine.copy()
                    continue
                if whose != (a, salt):
                    raise ValueError("a set is missing")
                out.append((a, b, _similarity(head, mine), len(head), len(mine)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "shared", "n_a", "n_b"])

    return rows.mapInArrow(run, "a long, b long, shared long, n_a long, n_b long").dropDuplicates(["a", "b"])


def jaccard_components(docs: DataFrame, by: Similarity | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and sid for each row of ``docs``.

    Words are what lies between white space (20, 09-0D), A-Z lower-cased. Null and empty texts have no
    shingles and link with nothing, their own id is their component. Texts of fewer words than a shingle
    have one. Rows that repeat a text, with whatever id, are in one component; among rows with a null id
    only, the component is null. Whole texts take part; only doc_id and text are read; an empty table
    gives no rows. Sets are told apart by 64-bit hashes, rows by a number of their own.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return linked_rows(park(rows, "rows"), by).select("doc_id", "n_shingles", "component_id", "sid")


def linked_rows(docs: DataFrame, by: Similarity | None = None) -> DataFrame:
    """What ``jaccard_components`` gives for parked ``docs`` (unique row, doc_id, text), with row and first_row.

    The latter is the row of the component with the smallest doc_id, null ids last, then the smallest row.
    """
    by = by or Similarity()
    prepare(docs.sparkSession)
    docs = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    described = park(describe(docs, by), "described")
    nodes = park(
        described.where("sid is not null").groupBy("sid").agg(
            first, F.max("n").alias("n"), F.max("least1").alias("least1"),
            F.max("least2").alias("least2"), F.count(F.lit(1)).alias("copies"),
        ).select("sid", "first.row", "first.doc_id", "n", "least1", "least2", "copies"),
        "sets",
    )
    first_stars, tokens = settled(docs, nodes, "least1", by)
    taken = first_stars.select("sid").union(first_stars.select("center")).distinct()
    second = park(nodes.join(taken, "sid", "left_anti"), "without-star")
    second_stars, more = settled(docs, second, "least2", by)
    star = park(first_stars.unionByName(second_stars), "stars")
    members = park(
        nodes.join(star, "sid", "left")
        .select("row", "doc_id", "sid", "copies", F.coalesce("center", "sid").alias("center"), F.coalesce("far", F.lit(0.0)).alias("far")),
        "members",
    )
    centers = members.where("sid = center")
    common = frequent(described, centers, tokens.unionByName(more))
    signed = park(
        signatures(docs, by, common).where("sid is not null").join(members.select("row", "center"), "row")
        .select("sid", F.col("center").alias("key"), F.lit(0).cast("long").alias("part"), "n", "rare", "signatures", "combinations", "bits"),
        "signed",
    )
    radius = park(members.groupBy("center").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")), "radius")
    about = signed.where("sid = key").select("key", F.col("n").alias("size"), "bits").join(radius.select(F.col("center").alias("key"), F.col("r").alias("reach")), "key")
    seen = park(compare(docs, nodes, candidates(signed, by, about=about), by), "center-pairs")
    distance = 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    links = F.lit(100) * F.col("shared") >= F.lit(by.percent) * (F.col("n_a") + F.col("n_b") - F.col("shared"))
    edges = seen.where(links).select("a", "b")
    every = centers.select(F.col("sid").alias("node"))
    comps = park(connected_components(every, edges), "components-1")
    unsure = (
        seen.where(~links).withColumn("d", distance)
        .join(radius.select(F.col("center").alias("a"), F.col("r").alias("ra")), "a")
        .join(radius.select(F.col("center").alias("b"), F.col("r").alias("rb")), "b")
        .where(F.col("d") <= 1 - by.percent / 100 + F.col("ra") + F.col("rb") + 1e-9).where("ra > 0 or rb > 0")
        .join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
        .join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        .where("ca <> cb").select("a", "b", "ca", "cb")
    )
    unsure = park(unsure, "unsure")
    if not unsure.isEmpty():
        edges = edges.unionByName(_between_members(docs, nodes, members, radius.select("center", "n"), signed, unsure, by))
        comps = park(connected_components(every, park(edges, "all-edges")), "components-2")
    # a star and a component may have a large share of all members
    total = members.count()
    of_star = park(comps.withColumnRenamed("node", "center").join(radius.select("center", "n"), "center"), "star-components")
    placed = park(join_hot(members, of_star, "center", "n", total).select("sid", "row", "doc_id", "copies", "comp"), "placed")
    named = park(placed.groupBy("comp").agg(first, F.count(F.lit(1)).alias("members")).select("comp", "members", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")), "named")
    found = park(join_hot(placed, named, "comp", "members", total).select("sid", "component_id", "first_row", "copies"), "found")
    rows = described.select("row", "doc_id", "sid", "n")
    return (
        join_hot(rows.where("sid is not null"), found, "sid", "copies", rows.count())
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", "sid", "row", "first_row")
        .unionByName(rows.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sid", "row", F.col("row").alias("first_row")))
    )


def _between_members(
    docs: DataFrame, nodes: DataFrame, members: DataFrame, sizes: DataFrame, signed: DataFrame, unsure: DataFrame, by: Similarity
) -> DataFrame:
    """Links, as pairs of centers, between members of stars that centers and radii left undecided."""
    involved = unsure.select(F.col("a").alias("center"), F.col("ca").alias("comp")).union(unsure.select("b", "cb")).distinct()
    counted = park(involved.join(sizes, "center"), "involved")
    mine = park(join_hot(members, counted, "center", "n", members.count()).select("sid", "center", "comp"), "undecided")
    part = signed.join(mine, "sid").select(F.col("sid").alias("key"), F.col("comp").alias("part"), "n", "rare", "signatures", "combinations", "bits")
    pairs = candidates(part, by, apart=True, about=part.select("key", F.col("n").alias("size"), F.lit(0.0).alias("reach"), "bits"))
    where = mine.select("sid", "center")
    asked = (
        pairs.join(where.select(F.col("sid").alias("a"), F.col("center").alias("p")), "a")
        .join(where.select(F.col("sid").alias("b"), F.col("center").alias("q")), "b")
        .withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q"))
        .join(unsure.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), ["x", "y"])
    )
    asked = park(asked.select("a", "b", "p", "q"), "asked")
    seen = compare(docs, nodes, asked.select("a", "b"), by)
    linked = seen.where(F.lit(100) * F.col("shared") >= F.lit(by.percent) * (F.col("n_a") + F.col("n_b") - F.col("shared")))
    return linked.join(asked, ["a", "b"]).select(F.col("p").alias("a"), F.col("q").alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Similarity(90, 3)).select("doc_id", "n_shingles", "component_id")


NAME = "op5_ngram_join"
SQL = None
