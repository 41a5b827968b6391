"""Exact dedup, n-gram join and suffix dedup against plain references."""

import hashlib
import os
import random

import corpus_pipeline
import numpy as np
import pytest
from corpus import SCHEMA, components, lowered, repeats, rows, split, texts

from effectql.llm import exact_dedup, ngram_join, suffix_dedup
from effectql.llm.common import park, scope
from effectql.llm.components import connected_components


def test_exact(spark):
    docs = [*texts(), (None, "One"), (None, "only without id"), (4, "One")]
    got = exact_dedup.DigestIndex(spark, buckets=4).dedup(spark.createDataFrame(rows(docs), SCHEMA)).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(lowered(t), []).append(i)
    assert len(got) == len(docs)
    by_text = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_text[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame(rows([(1, "a"), (2, "A"), (3, "b")]), SCHEMA)
    assert sorted((r["doc_id"], r["kept"]) for r in index.dedup(first, "one").collect()) == [(1, False), (2, True), (3, True)]
    again = exact_dedup.DigestIndex(spark, index.name, buckets=4)
    second = spark.createDataFrame(rows([(9, "a"), (10, "c"), (11, "c")]), SCHEMA)
    expected = [(9, 2, False), (10, 11, False), (11, 11, True)]
    for _ in range(2):  # a batch that runs again gives the same
        assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.dedup(second, "two").collect()) == expected
    assert index.rows().count() == 3
    assert again.dedup(first.limit(0), "three").count() == 0


@pytest.mark.parametrize("percent, size", [(90, 3), (80, 5)])
def test_ngram_join(spark, percent, size):
    docs = texts()
    got = ngram_join.jaccard_components(spark.createDataFrame(rows(docs), SCHEMA), ngram_join.Similarity(percent, size)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs, percent, size)
    assert len(got) == len(docs)


def test_ngram_join_between_stars(spark, monkeypatch):
    """With a center for each group only, links between members of different stars decide."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "CENTERS", 1)
    docs = [d for d in texts(11) if d[0] is not None and 40 <= d[0] < 90] + [(None, "one two three"), (300, "one two three")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows(docs), SCHEMA), ngram_join.Similarity(90, 3)).collect()
    expected = components([d for d in docs if d[0] is not None], 90, 3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == expected
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [300]


def test_ngram_join_tells_rows_apart(spark):
    """Links by way of rows without id, and different texts under one id."""
    words = [f"w{k}" for k in range(100)]
    chain = [" ".join([f"x{k}" for k in range(n)] + words[n:]) for n in (0, 6, 12)]  # only neighbours link
    other = " ".join(f"o{k}" for k in range(60))
    docs = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (7, other), (7, "quite another text"), (8, other + " end"), (None, "alone a"), (None, "alone b")]
    frame = spark.createDataFrame(rows(docs), SCHEMA)
    got = ngram_join.jaccard_components(frame, ngram_join.Similarity(80, 3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 1, 0), (0, 1, 0), (0, 98, 1), (1, 98, 1), (3, 98, 1), (7, 1, 7), (7, 58, 7), (8, 59, 7),
    ]
    near = [(2, chain[0]), (9, "kept under this id"), (9, chain[0] + " end"), (None, other), (None, other + " end")]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows(near), SCHEMA), "").collect()
    assert [(r["doc_id"], r["text"]) for r in left if r["doc_id"]] == [(2, chain[0]), (9, "kept under this id")]
    assert len(left) == 3


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "node long")
    got = {r["node"]: r["comp"] for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_suffix_dedup(spark):
    docs = [*texts(), (None, "x " * 60), (200, "y z " * 40)]
    frame = spark.createDataFrame(rows(docs), SCHEMA)
    got = suffix_dedup.repeated_passages(frame).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == sorted(repeats(docs))
    assert all(r["first_doc_id"] in r["first_doc_ids"] and r["first_doc_id"] <= r["doc_id"] for r in got)
    left = {r["doc_id"]: r for r in suffix_dedup.without_repeats(frame).collect()}
    assert set(frame.columns) == set(left[4].asDict())
    gone = {}
    for i, a, b in repeats(docs):
        gone.setdefault(i, []).extend(range(a, b))
    for i, t in docs:
        rest = [w for k, w in enumerate(split(t)) if k not in set(gone.get(i, ()))]
        if i in gone and not rest:
            assert i not in left
        else:
            assert split(left[i]["text"]) == rest
            assert i in gone or left[i]["text"] == t
            assert left[i]["n_chars"] == (len(left[i]["text"]) if left[i]["text"] is not None else None)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_count_once(spark):
    text = " ".join(f"q{i}" for i in range(80))
    frame = spark.createDataFrame(rows([(1, text), (1, text), (2, text)]), SCHEMA)
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(frame).collect()] == [(2, 0, 80)]


def lines_of(rng, n):
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("block, share", [(48, 1 / 200), (1, 1 / 200), (3, 1e-9)])
def test_suffix_dedup_of_frequent_passages(spark, monkeypatch, block, share):
    """Passages in many documents, cut off at different words: compared as suffixes, or hashed beyond BLOCK."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 5 if share < 1e-3 else 1000)
    rng = random.Random(3)
    common, other = lines_of(rng, 90), lines_of(rng, 75)
    docs = []
    for i in range(60):
        a, b = sorted(rng.sample(range(90), 2))
        c, d = sorted(rng.sample(range(75), 2))
        docs.append((i, " ".join([*lines_of(rng, 10), *common[a:b], *lines_of(rng, 3), *other[c:d], *lines_of(rng, 5)])))
    docs += [(70, " ".join([*common[:60], *other[10:]])), (71, " ".join([*common[20:60], *other[10:30]])), (72, " ".join([*common, *common]))]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows(docs), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == sorted(repeats(docs))
    first = {tuple(split(t)[k : k + 50]) for _, t in docs for k in range(len(split(t)) - 49)}
    assert first and all(r["first_doc_id"] <= r["doc_id"] for r in got)


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    """Different texts under one id are documents of their own; rows without id come last, where asked for."""
    rng = random.Random(5)
    a, b, own = lines_of(rng, 60), lines_of(rng, 60), [" ".join(lines_of(rng, 8)) for _ in range(8)]
    docs = [(3, " ".join(a)), (5, f"{own[0]} {' '.join(a)} {own[1]}"), (5, f"{own[2]} {' '.join(b)}"), (5, f"{own[3]} {' '.join(b)}"), (5, own[4]), (None, f"{own[5]} {' '.join(a)}"), (None, f"{own[6]} {' '.join(a)}"), (None, None)]
    frame = spark.createDataFrame(rows(docs), SCHEMA)
    got = [(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(frame).collect()]
    assert sorted(got) == [(5, 8, 68), (5, 8, 68)]
    got = [(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in suffix_dedup.repeated_passages(frame, unnamed=True).collect()]
    assert sorted(x for x in got if x[0]) == [(5, 8, 68, 3), (5, 8, 68, 5)]
    assert [x for x in got if x[0] is None] == [(None, 8, 68, 3)] * 2
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_passages(spark, frame, "").collect()]
    assert len(left) == len(docs)
    short = sorted(" ".join(t.split()) for i, t in left if i == 5)
    assert [t for t in short if a[0] in t] == [] and sum(b[0] in t for t in short) == 1
    assert sorted(" ".join((t or "").split()) for i, t in left if i is None) == sorted(["", own[5], own[6]])
    assert {r["text"]: r["n_chars"] for r in corpus_pipeline.cut_passages(spark, frame, "").collect() if r["text"]} == {t: len(t) for _, t in left if t}


def test_near_copies_leave_other_texts_of_an_id(spark):
    near = " ".join(f"w{k}" for k in range(60))
    docs = [(3, near), (5, near + " end"), (5, "quite another text"), (None, near + " too"), (None, "no id here")]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows(docs), SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "no id here"), (3, near), (5, "quite another text")]
    copies = [(3, "One"), (3, "two"), (3, "one"), (None, "TWO"), (None, "three"), (None, "Three"), (9, None), (9, "")]
    left = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows(copies), SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in left) == [(0, "three"), (3, "one"), (3, "two"), (9, "")]


def test_suffix_dedup_of_a_whole_table(spark):
    """The table of 1,000 documents of the tests' data, held against brute force."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    frame = spark.read.parquet(path)
    docs = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    got = suffix_dedup.repeated_passages(frame).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == sorted(repeats(docs))


@pytest.mark.parametrize("length", [2, 7])
def test_ngram_join_with_long_lists(spark, monkeypatch, length):
    """Lists of signatures that are cut into blocks give the same links."""
    monkeypatch.setattr(ngram_join, "LIST", length)
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    monkeypatch.setattr(ngram_join, "CENTERS", 1)
    docs = [d for d in texts(13) if d[0] is not None]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows(docs), SCHEMA), ngram_join.Similarity(80, 5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs, 80, 5)


def test_near_misses_in_long_lists_are_not_paired(spark, monkeypatch):
    """Many near copies that share signatures and just don't link: bitmaps tell, and the links there are stay."""
    monkeypatch.setattr(ngram_join, "LIST", 2)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    docs = []
    for i in range(40):  # 18 of 198 shingles differ from the base: of two of them 36, and 20 may
        w = list(base)
        for k in rng.sample(range(5, 195, 4), 6):
            w[k] = f"x{i}x{k}"
        docs.append((i, " ".join(w)))
        if i % 10 == 0:
            docs.append((100 + i, " ".join([*w, "more"])))
    asked, compare = [], ngram_join.compare
    monkeypatch.setattr(ngram_join, "compare", lambda docs, nodes, pairs, by: compare(docs, nodes, asked.append(parked := park(pairs, "asked-test")) or parked, by))
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    monkeypatch.setattr(ngram_join, "settled", lambda docs, nodes, least, by: tuple(spark.createDataFrame([], x) for x in ("sid long, center long, far double", "token long")))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows(docs), SCHEMA), ngram_join.Similarity(90, 3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs, 90, 3)
    assert 4 <= sum(x.count() for x in asked) <= 60


def test_bitmaps_bound_what_sets_lack(spark):
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(1 << 40), n)), np.uint64) for n in (0, 1, 5, 700, 3000)]
    sets += [sets[-1][:2900], sets[-2][100:]]
    first = np.cumsum([0, *map(len, sets)])
    bits = [np.frombuffer(x, np.uint64) for x in ngram_join._bitmaps(np.concatenate(sets), first)]
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_candidates_of_one_signature_in_many_sets(spark):
    """One signature in 20,000 sets: only sizes that may link are paired, in blocks."""
    many = [(k, k, 100 + 2 * (k // 4), 0, k) for k in range(20_000)]
    signed = spark.createDataFrame([(k, p, n, r, (7).to_bytes(8, "little") + k.to_bytes(8, "little"), b"") for k, p, n, r, _ in many], "key long, part long, n long, rare long, signatures binary, combinations binary")
    by = ngram_join.Similarity(100, 5)
    pairs = ngram_join.candidates(signed, by)
    got = pairs.selectExpr("count(*) n", "sum(a) a", "sum(b) b").first()
    assert tuple(got) == (5_000 * 6, sum(a for k in range(0, 20_000, 4) for a in (k, k, k, k + 1, k + 1, k + 2)), sum(b for k in range(0, 20_000, 4) for b in (k + 1, k + 2, k + 3, k + 2, k + 3, k + 3)))


def test_index_takes_batches_as_its_own(spark):
    """Batches without a name, an index reopened with other settings, and merged files."""
    index = exact_dedup.DigestIndex(spark, buckets=3)
    assert [r["kept"] for r in index.dedup(spark.createDataFrame(rows([(1, "a")]), SCHEMA)).collect()] == [True]
    assert [(r["keep_id"], r["kept"]) for r in index.dedup(spark.createDataFrame(rows([(9, "A")]), SCHEMA)).collect()] == [(1, False)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, index.name, buckets=5)
        assert again.buckets == 3
        for k in range(3):
            assert again.dedup(spark.createDataFrame(rows([(20 + k, f"new {k}")]), SCHEMA)).collect()[0]["kept"]
        again.compact()
        assert len(again.rows().inputFiles()) <= 3 and again.rows().count() == 4
        assert not again.dedup(spark.createDataFrame(rows([(50, "NEW 1")]), SCHEMA)).collect()[0]["kept"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    again.drop()
    assert not spark.catalog.tableExists(index.name)


def test_copies_in_two_batches(spark):
    docs = [*texts(), (None, "One"), (None, "only without id"), (4, "One"), (10**6, "same")]
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = exact_dedup.mark_copies(spark.createDataFrame(rows(docs), SCHEMA), index).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(lowered(t), []).append(i)
    assert len(got) == len(docs) and sum(r["kept"] for r in got) == len(groups)
    by_text = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_text[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (len(ids), max((i for i in ids if i is not None), default=None))
    assert index.rows().select("batch").distinct().count() == 2
    nothing = exact_dedup.mark_copies(spark.createDataFrame([], SCHEMA), exact_dedup.DigestIndex(spark, buckets=2))
    assert nothing.count() == 0


def test_scopes_delete_what_they_park(spark):
    frame = spark.createDataFrame([(1,)], "a int")
    with scope(spark):
        outer = park(frame, "outer").inputFiles()[0].removeprefix("file://")
        with scope(spark):
            inner = park(frame, "inner").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(outer) and not os.path.exists(inner)
    assert not os.path.exists(outer)
