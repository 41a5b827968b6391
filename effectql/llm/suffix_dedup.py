"""Suffix-array dedup with sparse suffixes.

1. Any repeated passage of MIN_WORDS words holds the same minimiser (the least hash of its runs of ANCHOR
   words), whichever document it stands in. So suffixes are retained at minimiser positions only.
2. Retained suffixes are sorted by the words at their anchor and by their surroundings, as far left and
   right as any passage with this minimiser reaches. Neighbours in that order with equal surroundings
   repeat as a whole; of each kind of surroundings the first occurrence goes on to step 3.
3. Where an anchor has several surroundings, their words are fetched and sorted as suffixes. The common
   prefix of neighbours, and of all others as the least on the way to them, tells how far two suffixes
   match to the right; the words in front of the anchor are compared to extend the match to the left. What
   is matched in MIN_WORDS words or more repeats.
4. Neighbours alone would lose matches: of three occurrences the best partner on the left need not stand
   next on the right. So step 3 looks at all occurrences of an anchor, up to BLOCK. Beyond that (a license
   text in many documents) the passages with this anchor are hashed one by one, their first occurrences
   found by a pre-aggregated minimum, and joined to the others, so that no task holds the whole group.

The first occurrence of a passage (by doc_id and place) stays, later ones are found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_hot, marked_rows, park, prepare, table, text_slices, with_rows
from .wordhash import Words, _grown, mix, words_of

MIN_WORDS = 50
ANCHOR = 20
#: Different surroundings of an anchor that are compared as sorted suffixes; beyond, passages are hashed.
BLOCK = 48
#: An anchor with fewer occurrences is drawn together, whatever its share.
LEAST_HOT = 1000
#: Stands for a null doc_id, which comes last.
UNNAMED = (1 << 63) - 1
_PLACE = np.uint64((1 << 28) - 1)


def _prefix(words: Words) -> np.ndarray:
    power, _ = _grown(len(words.hashes) + 1)
    total = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * power[: len(words.hashes)], out=total[1:])
    return total


def _runs(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words from prefix sums."""
    _, inverse = _grown(len(total))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(words: Words, least: int) -> tuple[np.ndarray, ...]:
    """Row, hash at the anchor, hash of its surroundings, first and last start of its passages, and its place (words of the row)."""
    none = np.zeros(0, np.int64)
    n = len(words.hashes)
    size = min(ANCHOR, least)
    if n < least:
        return (none,) * 6
    total = _prefix(words)
    at = np.arange(n - size + 1)
    grams = _runs(total, at, at + size)
    where = sliding_least((grams & ~_PLACE) | at.astype(np.uint64), least - size + 1) & _PLACE
    row = np.repeat(np.arange(len(words.first) - 1), words.counts)
    start = np.arange(len(where))
    start = start[start + least <= words.first[row[: len(where)] + 1]]
    if len(start) == 0:
        return (none,) * 6
    place = where[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    r = row[low]
    span = _runs(total, low, high + least)
    base = words.first[r]
    return r, grams[place[first]].view(np.int64), span.view(np.int64), low - base, high - base, place[first] - base


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """Arrays as the columns of ``schema`` (long, int or boolean)."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


#: A document is told apart by doc and ident: doc_id (UNNAMED for null), and the hash of its text or the number of its row.
SUFFIX = "gram long, span long, doc long, ident long, low int, high int, at int, source long, repeats boolean"
#: ``wide``: the anchor has more surroundings than BLOCK.
FOUND = "gram long, doc long, ident long, low int, high int, at int, source long, repeats boolean, wide boolean"
INTERVAL = "doc long, ident long, low int, high int, source long"


def _thinned(same: np.ndarray, doc: np.ndarray, ident: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sorted rows: which ones lead their equals, which are later ones, and the place of each one's leader."""
    new = np.ones(len(doc), bool)
    new[1:] = ~same
    lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    again = (doc == doc[lead]) & (ident == ident[lead]) & (low == low[lead])
    return new, ~new & ~again, lead


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    """All retained suffixes (SUFFIX). Those that repeat another one in the same slice are marked at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            r, gram, span, low, high, at = anchors(words_of(batch.column(2)), least)
            if len(r) == 0:
                continue
            doc, ident = (np.asarray(batch.column(k), dtype=np.int64)[r] for k in (0, 1))
            order = np.lexsort((low, ident, doc, span, gram))
            gram, span, doc, ident, low, high, at = (x[order] for x in (gram, span, doc, ident, low, high, at))
            same = (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])
            new, late, lead = _thinned(same, doc, ident, low)
            out = new | late
            yield _batch(SUFFIX, *(x[out] for x in (gram, span, doc, ident, low, high, at, doc[lead], late)))

    return docs.select("doc", "ident", "text").mapInArrow(run, SUFFIX)


def _compare_neighbours(suffixes: DataFrame, least: int) -> DataFrame:
    """FOUND rows: repeats, and first occurrences whose anchor has other surroundings elsewhere.

    The pass keeps the last first occurrence and at most BLOCK of those before it, however many rows
    share an anchor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list[int] | None = None  # gram, span, doc, ident, low, high, at of the last first occurrence
        held = [np.zeros(0, np.int64)] * 7  # first occurrences of the last anchor that wait for its end
        gone = 0  # and how many have gone ahead, as there are more than BLOCK

        def told(rows: list[np.ndarray], wide: np.ndarray) -> pa.RecordBatch:
            gram, _, doc, ident, low, high, at = rows
            return _batch(FOUND, gram, doc, ident, low, high, at, doc, np.zeros(len(doc), bool), wide)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [np.asarray(batch.column(k), dtype=np.int64) for k in range(7)]
            ahead = lead is not None
            if ahead:
                columns = [np.concatenate(([v], x)) for v, x in zip(lead, columns, strict=True)]
            gram, span, doc, ident, low, high, at = columns
            same = (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])
            new, late, of = _thinned(same, doc, ident, low)
            if late.any():
                yes = np.ones(late.sum(), bool)
                yield _batch(FOUND, gram[late], doc[late], ident[late], low[late], high[late] + least, at[late], doc[of[late]], yes, ~yes)
            firsts = np.flatnonzero(new)
            was = lead[0] if ahead else None
            lead = [int(x[firsts[-1]]) for x in columns]
            rows = [np.concatenate((h, x[firsts[ahead:]])) for h, x in zip(held, columns, strict=True)]
            if len(rows[0]) == 0:
                continue
            edges = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1], [True])))
            sizes = np.diff(edges)
            if rows[0][0] == was:
                sizes[0] += gone
            # all anchors but the last are complete; the last one goes ahead once it has more than BLOCK
            cut = edges[-1] if sizes[-1] > BLOCK else edges[-2]
            size = np.repeat(sizes, np.diff(edges))
            out = np.arange(len(size)) < cut
            out &= size > 1
            if out.any():
                yield told([x[out] for x in rows], size[out] > BLOCK)
            held = [x[cut:] for x in rows]
            gone = int(sizes[-1]) if cut == edges[-1] else 0
        if len(held[0]) > 1:
            yield told(held, np.zeros(len(held[0]), bool))

    ordered = suffixes.select("gram", "span", "doc", "ident", "low", "high", "at").repartition("gram")
    return ordered.sortWithinPartitions("gram", "span", "doc", "ident", "low").mapInArrow(run, FOUND)


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def matches(group: list[tuple], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """INTERVAL rows of the occurrences of an anchor that match an earlier one in ``least`` words or more.

    ``group``: (words from the anchor on, words in front of it backwards, doc, ident, low, at), sorted by
    the first. A suffix array's property is used: two suffixes have in common the least that neighbours
    between them have in common.
    """
    lcp = [0, *(_common(a[0], b[0]) for a, b in zip(group, group[1:], strict=False))]
    for j, (_, behind, doc, ident, low, at) in enumerate(group):
        mine = (doc, ident, low)
        best: dict[int, tuple[int, tuple]] = {}  # words matched in front of the anchor: from it on, and the first such occurrence
        for steps in (range(j - 1, -1, -1), range(j + 1, len(group))):
            run = 1 << 30
            for i in steps:
                run = min(run, lcp[i + 1 if i < j else i])
                if run + len(behind) < least:
                    break
                other = group[i]
                if (other[2], other[3], other[4]) >= mine:
                    continue
                left = _common(behind, other[1])
                if left + run >= least and (run, -other[2], -other[3]) > best.get(left, (0, 0, 0)):
                    best[left] = (run, -other[2], -other[3])
        for left, (run, source, _) in best.items():
            yield doc, ident, at - left, at + run, -source


def _extend(docs: DataFrame, varied: DataFrame, least: int) -> DataFrame:
    """Repeats (INTERVAL) among passages of the occurrences in ``varied`` (gram, doc, ident, low, high, at, wide)."""
    wanted = park(
        varied.groupBy("doc", "ident").agg(F.collect_list(F.struct("gram", "low", "high", "at", "wide")).alias("places")), "varied"
    )
    texts = with_rows(docs, wanted, ["doc", "ident"], ["text"]).select(
        "doc", "ident", "text", "places.gram", "places.low", "places.high", "places.at", "places.wide"
    )
    content = "key long, doc long, ident long, low int, at int, ahead binary, behind binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words around narrow anchors, and hashes of the passages of wide ones (no words)."""
        for batch in text_slices(batches):
            words = words_of(batch.column(2))
            total, raw = _prefix(words), words.data.tobytes()
            near, starts, owners = [], [], []
            for i, (doc, ident, *lists) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7)), strict=True)):
                base = int(words.first[i])
                for gram, low, high, at, wide in zip(*lists, strict=True):
                    if wide:
                        starts.append(np.arange(base + low, base + high + 1))
                        owners.append(np.full(high - low + 1, i))
                        continue
                    begin, end = int(words.start[base + low]), int(words.end[base + high + least - 1])
                    here = raw[begin:end].lower().split()
                    near.append((gram, doc, ident, low, at, b" ".join(here[at - low :]), b" ".join(here[: at - low][::-1])))
            if near:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*near, strict=True), kinds, strict=True)], [c.split()[0] for c in content.split(", ")])
            if starts:
                s, row = np.concatenate(starts), np.concatenate(owners)
                place = pa.array((s - words.first[row]).astype(np.int32))
                doc, ident = (batch.column(k).take(pa.array(row)) for k in (0, 1))
                nothing = pa.nulls(len(s), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_runs(total, s, s + least).view(np.int64)), doc, ident, place, place, nothing, nothing], [c.split()[0] for c in content.split(", ")]
                )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out = []
            for k, doc, ident, low, at, ahead, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += matches(group, least)
                    key, group = k, []
                group.append((ahead.split(b" "), behind.split(b" ") if behind else [], doc, ident, low, at))
            if out:
                yield _batch(INTERVAL, *zip(*out, strict=True))
        if out := list(matches(group, least)):
            yield _batch(INTERVAL, *zip(*out, strict=True))

    found = park(texts.mapInArrow(run, content), "contents")
    near = found.where("ahead is not null").repartition("key").sortWithinPartitions("key", "ahead", "behind", "doc", "ident", "low").mapInArrow(compare, INTERVAL)
    passages = found.where("ahead is null").select("key", "doc", "ident", "low")
    first = F.min(F.struct("doc", "ident", "low")).alias("first")
    firsts = park(passages.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "first-passages")
    later = join_hot(passages, firsts, "key", "n", passages.count()).where(F.struct("doc", "ident", "low") > F.col("first"))
    return near.unionByName(later.select("doc", "ident", "low", (F.col("low") + least).cast("int").alias("high"), F.col("first.doc").alias("source")))


def _joined(intervals: DataFrame) -> DataFrame:
    """doc, ident, start_word, end_word, first_doc_id, first_doc_ids: overlapping intervals of a document together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def spans(doc, ident, low, high, source) -> Iterator[pa.RecordBatch]:
            if len(doc) == 0:
                return
            # ends rise within a document when each document is lifted above the one before it
            other = (doc[1:] != doc[:-1]) | (ident[1:] != ident[:-1])
            rank = np.cumsum(np.concatenate(([0], other.astype(np.int64)))) * (1 << 32)
            reach = np.maximum.accumulate(high + rank)
            new = np.ones(len(doc), bool)
            new[1:] = low[1:] + rank[1:] > reach[:-1]
            first = np.flatnonzero(new)
            until = np.append(first[1:], len(doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[first]), pa.array(ident[first]), pa.array(low[first]), pa.array(reach[until - 1] - rank[first]),
                    pa.array(np.minimum.reduceat(source, first)),
                    pa.array([np.unique(source[a:b]).tolist() for a, b in zip(first.tolist(), until.tolist(), strict=True)], pa.list_(pa.int64())),
                ],
                ["doc", "ident", "start_word", "end_word", "first_doc_id", "first_doc_ids"],
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [np.concatenate((h, np.asarray(c, dtype=np.int64))) for h, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from spans(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        yield from spans(*held)

    # rows that repeat id and text give the same intervals; these meet before the shuffle
    once = intervals.groupBy("doc", "ident", "low", "high").agg(F.min("source").alias("source"))
    rows = once.repartition("doc", "ident").sortWithinPartitions("doc", "ident", "low", "high")
    return rows.mapInArrow(run, "doc long, ident long, start_word long, end_word long, first_doc_id long, first_doc_ids array<long>")


def _stretches(docs: DataFrame, least: int) -> DataFrame:
    """``_joined`` for keyed documents (doc, ident, text)."""
    prepare(docs.sparkSession)
    suffixes = park(_suffixes(docs, least), "suffixes")
    leads = suffixes.where("not repeats")
    grams = park(leads.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    # anchors with a large share of all suffixes, of which there are few, go on without being drawn together
    share = max(LEAST_HOT, int(suffixes.count() * HOT_SHARE))
    hot = grams.where(F.col("n") > share).select("gram", F.lit(True).alias("hot"))
    marked = leads.join(F.broadcast(hot), "gram", "left")
    found = park(_compare_neighbours(marked.where("hot is null"), least), "neighbours")
    varied = found.where("not repeats")
    places = ("gram", "doc", "ident", "low", "high", "at")
    wide = varied.select(*places, "wide").unionByName(marked.where("hot").select(*places, F.lit(True).alias("wide")))
    at_once = suffixes.where("repeats").select("doc", "ident", "low", (F.col("high") + least).cast("int").alias("high"), "source")
    whole = found.where("repeats").select("doc", "ident", "low", "high", "source")
    return _joined(at_once.unionByName(whole).unionByName(_extend(docs, wide, least)))


def _keyed(docs: DataFrame, unnamed: bool) -> DataFrame:
    """``docs`` with doc and ident, in columns __doc and __ident; rows without doc_id are numbered, or left out."""
    named = F.col("doc_id").isNotNull()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    if not unnamed:
        return docs.where(named).withColumns({"__doc": F.col("doc_id").cast("long"), "__ident": text})
    keys = {"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(UNNAMED)), "__ident": F.when(named, text).otherwise(F.monotonically_increasing_id())}
    keyed = docs.withColumns(keys)
    return keyed if docs.where(~named).isEmpty() else park(keyed, "keyed")


def _documents(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__doc").alias("doc"), F.col("__ident").alias("ident"), F.col("text").cast("string").alias("text"))


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, unnamed: bool = False) -> DataFrame:
    """A row for each stretch of a document that repeats earlier passages of ``least`` words or more.

    doc_id, start_word, end_word (behind it), first_doc_id (the smallest document it was found in before)
    and first_doc_ids. Words lie between white space (20, 09-0D), A-Z lower-cased. A word belongs to a
    stretch if any passage of ``least`` words around it occurs earlier, by doc_id and place; the first
    occurrence itself has no row. Passages may repeat within a document.

    Null, empty and short texts have no passages. Rows that repeat id and text count once; different texts
    under one id are documents of their own, in an order of their hashes. Rows without doc_id take no
    part, or with ``unnamed`` come last, in the order of their partitions. Whole texts are compared; only
    doc_id and text are read; an empty table gives no rows.
    """
    found = _stretches(_documents(_keyed(docs, unnamed)), least)
    named = lambda c: F.when(c != UNNAMED, c)
    return found.select(
        named(F.col("doc")).alias("doc_id"), "start_word", "end_word", named(F.col("first_doc_id")).alias("first_doc_id"),
        F.transform("first_doc_ids", named).alias("first_doc_ids"),
    )


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, unnamed: bool = False) -> DataFrame:
    """``docs`` with the stretches of ``repeated_passages`` cut out of their texts and n_chars set anew.

    Documents of which no word is left go; all others stay, with all their columns. Texts without
    repeats stay where they lie.
    """
    keyed = _keyed(docs, True)
    taking = keyed if unnamed else keyed.where(F.col("__doc") != UNNAMED)
    spans = park(
        _stretches(_documents(taking), least).groupBy("doc", "ident")
        .agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
        .select(F.col("doc").alias("__doc"), F.col("ident").alias("__ident"), F.col("spans.start_word").alias("__low"), F.col("spans.end_word").alias("__high")),
        "spans",
    )
    columns = docs.columns
    place, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, out, kept = words_of(batch.column(place)), [], []
            for i, (text, low, high) in enumerate(zip(*(batch.column(k).to_pylist() for k in (place, len(columns), len(columns) + 1)), strict=True)):
                if low is None:  # came along by chance
                    out.append(text)
                    kept.append(True)
                    continue
                raw, parts, at = (text or "").encode(), [], 0
                base, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                origin, gone = int(words.rows[i]), 0
                for a, b in zip(low, high, strict=True):
                    begin = int(words.start[base + a]) - origin
                    end = int(words.start[base + b]) - origin if b < n else len(raw)
                    parts.append(raw[at:begin])
                    at, gone = end, gone + b - a
                parts.append(raw[at:])
                out.append(b"".join(parts).decode())
                kept.append(gone < n)
            made = list(batch.columns[:-2])
            made[place] = pa.array(out, batch.schema.field(place).type)
            if chars is not None:
                whole = batch.column(len(columns)).is_null().to_pylist()
                counts = [n if w else len(x) for x, n, w in zip(out, made[chars].to_pylist(), whole, strict=True)]
                made[chars] = pa.array(counts, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(made, columns).filter(pa.array(kept))

    marked = marked_rows(keyed, spans, ["__doc", "__ident"])
    hit = marked.where("__hit").hint("merge").join(spans, ["__doc", "__ident"], "left").select(*columns, "__low", "__high")
    return marked.where("not __hit").select(*columns).unionByName(hit.mapInArrow(cut, docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).withColumn("n_words", F.col("end_word") - F.col("start_word"))


NAME = "op10_suffix_dedup"
SQL = None
