"""Divergence between the sources of a language, and the terms that set a source apart, in exact integers.

Each group (lang, source), and each language, gives every kept term a probability in billionths,
p = 1 + floor(10^9 (count + 1) / (N + V)). Two groups diverge by the sum of floor((p - q)^2 / q) over all V
kept terms. Most of these are absent from most groups, so the sum is taken in two ways that are added:

* Terms in more than ``RARE`` groups are dense: tiles of terms x groups, a pair of blocks of groups to a tile.
* The others are sparse. Were all of them absent everywhere, a pair would sum V_rare equal values; a group's own
  occurrences change that by a histogram of its counts, whatever the other group is; and the terms that
  both have are corrected pair by pair from their posting lists, which have ``RARE`` entries at most.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, park, prepare, table, text_slices

#: Terms in more groups of a language than this are dense.
RARE = 8
#: Groups in a block and terms in a tile (about).
BLOCK, TERMS = 64, 1024
#: Entries (group, term) that a task counts before it passes them on.
ENTRIES = 1 << 18
#: Bytes of a text that are split into terms at a time.
STRETCH = 1 << 20
#: Groups whose totals are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 1 << 16

#: Bytes of terms, A-Z lower-cased; all others become blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SUMMED = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())])
SUMMED_DDL = "lang string, g long, h long, value long"


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, as many at a time as some ``STRETCH`` bytes have."""
    shown, at = text.translate(_TERMS), 0
    while at < len(shown):
        end = shown.find(b" ", at + STRETCH) if len(shown) - at > STRETCH else -1
        end = len(shown) if end < 0 else end
        yield shown[at:end].split()
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, and a row without term for each group; each may come several times."""
    counts: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            inside = docs[lang, source]
            terms = [*found, None]
            for at in range(0, len(terms), 8192):
                part = terms[at : at + 8192]
                yield pa.record_batch(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([found[t] for t in part], pa.int64()), pa.array([inside[t] for t in part], pa.int64())],
                    schema=COUNTED,
                )
        counts.clear()
        docs.clear()

    for batch in text_slices(batches):
        texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            mine, seen = counts[lang, source], set()
            held -= len(mine)
            for terms in stretches(text):
                mine.update(terms)
                seen.update(terms)
            docs[lang, source].update(seen)
            held += len(mine)
            if held >= ENTRIES:
                yield from told()
                held = 0
    yield from told()


def probability(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total), divided three digits at a time so that nothing overflows."""
    left = n + 1
    whole = F.call_function("div", left, total)
    for _ in range(3):
        left = (left % total) * 1000
        whole = whole * 1000 + F.call_function("div", left, total)
    return whole + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _rare_sums(i: int, others: np.ndarray, absent: np.ndarray, p: np.ndarray, n: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the rare terms of group i add to its divergence from each of ``others``, and to theirs from it.

    ``p`` and ``n`` are the histogram of i; the others are taken to have none of its terms.
    """
    mine, back = _distances(absent[i], absent[others]), _distances(absent[others], absent[i])
    there, here = mine * terms[i], np.zeros(len(others), np.int64)
    for at in range(0, len(p), TERMS):
        of, many = p[at : at + TERMS, None], n[at : at + TERMS, None]
        there += ((_distances(of, absent[others]) - mine) * many).sum(0)
        here += ((_distances(absent[others], of) - back) * many).sum(0)
    return there, here


def _tile(block: int, key: tuple, rows: pa.Table) -> pa.Table:
    """Sums over a bucket of dense terms, or, for bucket -1, over the histograms of rare ones.

    Rows without a term tell what an absent term has in each group, and n then is the number of terms of the bucket:
    those that no group of the tile has take part, too.
    """
    lang, bucket, a, b = (k.as_py() for k in key)
    g, p, n = (rows.column(c).to_numpy() for c in ("g", "p", "n"))
    absence = rows.column("term").is_null().to_numpy()
    base, rest = np.flatnonzero(absence), np.flatnonzero(~absence)
    base = base[np.argsort(g[base])]
    groups, absent = g[base], p[base]
    place = np.searchsorted(groups, g[rest])
    left, right = np.flatnonzero(groups // block == a), np.flatnonzero(groups // block == b)
    sums = np.zeros((len(groups), len(groups)), np.int64)
    dense, missing = None, 0
    if bucket >= 0:
        column = rows.column("term").take(pa.array(rest)).combine_chunks().dictionary_encode()
        dense = np.repeat(absent[:, None], len(column.dictionary), 1)
        dense[place, column.indices.to_numpy()] = p[rest]
        missing = int(n[base[0]]) - len(column.dictionary)
    for x, y in ((left, right), (right, left))[: 1 if a == b else 2]:
        for i in x:
            if dense is not None:
                sums[i, y] += _distances(dense[i], dense[y]).sum(1) + missing * _distances(absent[i], absent[y])
            else:
                own = rest[place == i]
                there, here = _rare_sums(i, y, absent, p[own], n[own], n[base])
                sums[i, y] += there
                sums[y, i] += here
    across = np.zeros(sums.shape, bool)
    across[np.ix_(left, right)] = across[np.ix_(right, left)] = True
    np.fill_diagonal(across, False)
    i, j = np.nonzero(across)
    return pa.table([pa.array([lang] * len(i), pa.string()), pa.array(groups[i]), pa.array(groups[j]), pa.array(sums[i, j])], schema=SUMMED)


class Divergence:
    """The counts of ``docs`` (columns text, lang, source), parked, for ``pairs`` and ``terms``.

    Null text, lang and source count as ''. Each row is a document, so repeated rows count again; texts of any
    length are counted whole. A group without kept terms still has pairs; a language with one source has none.
    An empty table gives no rows. Only the three columns are read, so further columns do no harm.
    """

    def __init__(self, docs: DataFrame, least_docs: int = 3, rare: int = RARE, block: int = BLOCK, terms: int = TERMS):
        self.rare, self.block, self.tile_terms = rare, block, terms
        prepare(docs.sparkSession)
        read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
        told = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        # dealt by (lang, term) once: the sums by source and those over all sources both lie there
        counted = told.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        counted = counted.select(
            "lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.count(F.lit(1)).over(of_term).alias("groups"),
            F.sum("docs").over(of_term).alias("in_docs"), (F.min("source").over(of_term) == F.col("source")).alias("leads"),
        )
        counted = park(counted.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)), "counted")
        self.groups = park(self._groups(counted), "groups")
        few = self.groups.count() <= BROADCAST_GROUPS
        self._small = F.broadcast if few else (lambda df: df)
        with_totals = counted.where("term is not null").join(self._small(self.groups.select("lang", "source", "g", "total", "lang_total")), ["lang", "source"])
        self.postings = park(
            with_totals.select(
                "lang", "source", "g", "term", "groups", "leads", probability(F.col("n"), F.col("total")).alias("p"), probability(F.col("lang_n"), F.col("lang_total")).alias("q")
            ),
            "postings",
        )

    def _groups(self, counted: DataFrame) -> DataFrame:
        """Each group with its number g in the language, totals, and how many blocks and tiles its language has."""
        of_lang = Window.partitionBy("lang")
        rare = F.col("groups") <= self.rare
        there = F.col("term").isNotNull()
        sums = counted.groupBy("lang", "source").agg(
            F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n"), F.count_if(there & F.col("leads")).alias("leads"), F.count_if(there & F.col("leads") & rare).alias("rare")
        )
        v, rare_terms = F.sum("leads").over(of_lang), F.sum("rare").over(of_lang)
        totals = sums.select(
            "lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("g"),
            F.greatest(F.col("n") + v, F.lit(1)).alias("total"), F.greatest(F.sum("n").over(of_lang) + v, F.lit(1)).alias("lang_total"),
            rare_terms.alias("rare_terms"), F.ceil(F.count(F.lit(1)).over(of_lang) / self.block).cast("int").alias("blocks"),
            F.ceil((v - rare_terms) / self.tile_terms).cast("int").alias("buckets"),
        )
        return totals.withColumn("absent", probability(F.lit(0).cast("long"), F.col("total")))

    def _tiled(self) -> DataFrame:
        """Sums of the dense terms and of the histograms, tile by tile."""
        sizes = self._small(self.groups.select("lang", "source", "blocks", "buckets"))
        named = self.postings.join(sizes, ["lang", "source"])
        dense = named.where(F.col("groups") > self.rare).select(
            "lang", "g", "p", "term", F.lit(0).cast("long").alias("n"), "blocks", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "leads"
        )
        of_bucket = dense.where("leads").groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("terms"))
        dense = dense.drop("leads")
        rare = named.where(F.col("groups") <= self.rare).groupBy("lang", "g", "p", "blocks").agg(F.count(F.lit(1)).alias("n"))
        rare = rare.select("lang", "g", "p", F.lit("").alias("term"), "n", "blocks", F.lit(-1).alias("bucket"))
        base = self.groups.select(
            "lang", "g", F.col("absent").alias("p"), F.lit(None).cast("string").alias("term"), "rare_terms", "blocks",
            F.explode(F.sequence(F.lit(-1), F.col("buckets") - 1)).alias("bucket"),
        )
        many = F.when(F.col("bucket") < 0, F.col("rare_terms")).otherwise(F.coalesce("terms", F.lit(0)))
        base = base.join(of_bucket, ["lang", "bucket"], "left").select("lang", "g", "p", "term", many.cast("long").alias("n"), "blocks", "bucket")
        own = F.floor(F.col("g") / self.block).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("a"), F.greatest(k, own).alias("b")))
        dealt = dense.unionByName(rare).unionByName(base).withColumn("pair", F.explode(pairs))
        block = self.block

        def tile(key: tuple, rows: pa.Table) -> pa.Table:
            return _tile(block, key, rows)

        return dealt.select("lang", "bucket", "pair.a", "pair.b", "g", "p", "term", "n").groupBy("lang", "bucket", "a", "b").applyInArrow(tile, SUMMED_DDL)

    def _corrections(self) -> DataFrame:
        """For each rare term that two groups have: what it adds there, less what the histograms count for it."""
        absent = self._small(self.groups.select("lang", "source", "absent"))
        shared = self.postings.where((F.col("groups") > 1) & (F.col("groups") <= self.rare)).join(absent, ["lang", "source"])
        lists = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "absent")).alias("held"))  # RARE at most

        def corrected(x: Column, y: Column) -> Column:
            value = distance(x["p"], y["p"]) - distance(x["p"], y["absent"]) - distance(x["absent"], y["p"]) + distance(x["absent"], y["absent"])
            return F.struct(x["g"].alias("g"), y["g"].alias("h"), value.alias("value"))

        pairs = F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: y["g"] != x["g"]), lambda y: corrected(x, y))))
        return lists.select("lang", F.explode(pairs).alias("pair")).groupBy("lang", "pair.g", "pair.h").agg(F.sum("pair.value").alias("value"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value: the divergence of source from item."""
        sums = self._tiled().unionByName(self._corrections()).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
        names = self.groups.select("lang", "g", "source")
        others = names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
        return sums.join(self._small(names), ["lang", "g"]).join(self._small(others), ["lang", "h"]).select("lang", "source", "item", "value")

    def terms(self) -> DataFrame:
        """lang, source, item (a term that the source has more often than its language), value."""
        return self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    def report(self, most: int = 200) -> DataFrame:
        """lang, source, part, item, value, rank: all pairs, and the ``most`` first terms of each group."""
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        ranked = F.row_number().over(order).alias("rank")
        pairs = self.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked)
        terms = self.terms().select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked).where(F.col("rank") <= most)
        return pairs.unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Divergence(table(spark, sf_dir, "documents")).report()


NAME = "op12_source_divergence"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text
  FROM documents
), words AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term
), grid AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0)::HUGEINT AS n, t.n::HUGEINT AS lang_n
  FROM groups g JOIN kept t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS s, count(*)::HUGEINT AS v FROM grid GROUP BY lang, source
), lang_totals AS (
  SELECT lang, sum(n)::HUGEINT AS s, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (t.s + t.v) AS p, 1 + (1000000000 * (lang_n + 1)) // (l.s + l.v) AS q
  FROM grid JOIN totals t USING (lang, source) JOIN lang_totals l USING (lang)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), found AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""
