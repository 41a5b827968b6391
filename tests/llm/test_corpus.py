"""Packing, sharding, the classifier and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from corpus import SCHEMA, components, lowered, repeats, rows, split, texts

from effectql.llm import packing, quality, sharding
from effectql.llm.common import park


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice((16, 100, 4096))
    counts = Counter(rng.randint(1, capacity) if seed % 2 else min(capacity, int(rng.lognormvariate(4, 1)) + 1) for _ in range(5000))
    patterns = packing.plan(dict(counts), capacity)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts
    bins = sum(t for _, t in patterns)
    least = max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    assert bins <= 1.02 * least + 1


def test_plan_uses_exact_complements():
    assert sorted(map(sorted, (p for p, _ in packing.plan({60: 2, 40: 1, 25: 1, 15: 1}, 100)))) == [[15, 25, 60], [40, 60]]
    assert packing.plan({50: 10}, 100) == [([50, 50], 5)]
    assert packing.plan({97: 1, 1: 3}, 100) == [([97, 1, 1, 1], 1)]
    assert packing.plan({}, 100) == []


def test_pack(spark):
    from tokenizers import Tokenizer

    from effectql.llm.bpe import default_path

    library = Tokenizer.from_file(default_path())
    docs = [*texts(), (None, "no id"), (4, "One")]
    pieces = park(packing.token_pieces(spark.createDataFrame(rows(docs), SCHEMA)), "pieces")
    got = packing.pack(pieces).collect()
    expected = Counter()
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[(i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(park(packing.token_pieces(spark.createDataFrame([], SCHEMA)), "pieces")).count() == 0


def test_sharding(spark):
    docs = [*texts(), *((1000 + i, "copied text") for i in range(120)), (None, "no id"), (4, "One")]
    placed = sharding.shard_documents(spark.createDataFrame(rows(docs), SCHEMA), shards=5)
    got = placed.collect()
    assert len(got) == len(docs)
    shards = defaultdict(list)
    groups = defaultdict(set)
    for r in got:
        shards[r["shard"]].append(r["slot"])
        text = next(t or "" for i, t in docs if i == r["doc_id"])
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "rows")
        groups[text].add(r["shard"])
    sizes = [len(s) for s in shards.values()]
    assert set(shards) == set(range(5)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = Counter(t or "" for _, t in docs)
    small = [t for t, n in counts.items() if 1 < n < 10]
    assert sum(len(groups[t]) == 1 for t in small) >= 0.8 * len(small)


@pytest.mark.parametrize("last", [4, 4096])
def test_sharding_of_copies_only(spark, monkeypatch, last):
    """Where every text occurs twice, shards are full and exchange members."""
    monkeypatch.setattr(sharding, "LAST", last, raising=False)
    docs = [(i, f"text {i % 600}") for i in range(1200)]
    placed = sharding.shard_documents(spark.createDataFrame(rows(docs), SCHEMA), shards=6)
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [200] * 6
    assert sharding.cut_groups(placed, "text_crc32").collect() == [(600, 600)]


def test_sharding_of_large_groups(spark):
    """A group that fits a shard is whole, one that doesn't lies in as few as possible."""
    texts = ["a"] * 100 + ["b"] * 90 + ["c"] * 60 + ["d"] * 250 + [f"text {i}" for i in range(100)]
    placed = sharding.shard_documents(spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA), shards=6)
    assert [r["count"] for r in placed.groupBy("shard").count().collect()] == [100] * 6
    found = {zlib.crc32(t.encode()): t for t in "abcd"}
    shards = defaultdict(set)
    for r in placed.collect():
        shards[found.get(r["text_crc32"])].add(r["shard"])
    assert [len(shards[t]) for t in "abcd"] == [1, 1, 1, 3]


def test_sharding_of_few_rows(spark):
    got = sharding.shard_documents(spark.createDataFrame(rows([(1, "a"), (2, "a")]), SCHEMA), shards=4).collect()
    assert len(got) == 2 and len({r["shard"] for r in got}) == 2
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), shards=4).count() == 0


PROSE = "the people of that town and the river were known for it as they came to this place with all their friends and it was good"


def graded(n=600, seed=2):
    """(doc_id, text, bad): prose, and prose spoiled in several ways."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice(PROSE.split()) if rng.random() < 0.5 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(90)}" for _ in range(rng.randrange(40, 200))]
        kind = rng.randrange(12)
        text = {
            0: " ".join(f"{x}%%%" for x in w), 1: " ".join(f"{x.upper()}!!" for x in w), 2: " ".join([w[0]] * 80 + [w[1]] * 60),
            3: " ".join(f"{x} |" for x in w if x not in PROSE.split()), 4: " ".join([*w[:20], "you idiot", *w[20:], "worthless scum"]),
        }.get(kind, " ".join(w))
        out.append((i, text, kind < 5))
    return out


def test_classifier(spark):
    docs = graded()
    frame = spark.createDataFrame(rows([(i, t) for i, t, _ in docs]), SCHEMA)
    model = quality.fit(frame, sample=400)
    held = graded(300, 9)
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows([(i, t) for i, t, _ in held]), SCHEMA), model).collect()}
    assert sum(got[i]["kept"] != bad for i, _, bad in held) >= 0.97 * len(held)
    kept = quality.accepted(frame, model)
    assert kept.columns == frame.columns and 0 < kept.count() < len(docs)
    odd = spark.createDataFrame(rows([*texts(), (None, "no id")]), SCHEMA)
    assert quality.score(odd, model).count() == len(texts()) + 1
    assert quality.fit(frame, sample=400).scorers["junk"].bias == model.scorers["junk"].bias
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.fit(empty)).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.2
    rates = np.array([[0.001, 0.9], [0.002, 0.6], [0.01, 0.7]])
    votes = (rng.random((20_000, 3)) < np.where(bad[:, None], rates[:, 1], rates[:, 0])).astype(float)
    found, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(found, counts.astype(float), [[0, 1, 2]])
    assert np.abs(model.rates[1] - rates[:, 1]).max() < 0.05
    assert abs(model.shares[1] - bad.mean()) < 0.02


def test_label_model_finds_accuracies_of_labellers_that_err():
    """Labellers that speak against 5 to 10 % of good documents, and have two kinds of bad ones to tell apart."""
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 60_000, p=[0.8, 0.12, 0.08])
    rates = np.array([[0.05, 0.10, 0.08, 0.07, 0.06, 0.10], [0.9, 0.8, 0.7, 0.06, 0.05, 0.1], [0.05, 0.1, 0.08, 0.85, 0.9, 0.75]])
    votes = (rng.random((60_000, 6)) < rates[kind]).astype(float)
    found, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit_labels(found, counts.astype(float), [[0, 1, 2], [3, 4, 5]])
    assert np.abs(model.rates - rates).max() < 0.03
    assert np.abs(model.shares - [0.8, 0.12, 0.08]).max() < 0.01
    assert ((model.bad(found)[index] > 0.5) == (kind > 0)).mean() > 0.95


def test_words_of_labelled_abuse_are_mined(spark):
    """Abuse in words that no list has: learned from labelled rows, found in others, and without labels nothing is."""
    rng = random.Random(6)
    slurs = [f"zq{k}ro" for k in range(12)]

    def docs_of(first, n):
        out = []
        for i in range(n):
            w = [rng.choice(PROSE.split()) if rng.random() < 0.5 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(80)]
            if bad := rng.random() < 0.15:
                for s in rng.sample(slurs, 4):
                    w[rng.randrange(80)] = s
            out.append((first + i, " ".join(w), bad))
        return out

    docs, held = docs_of(0, 800), docs_of(5_000, 300)
    frame = spark.createDataFrame(rows([(i, t) for i, t, _ in [*docs, *held]]), SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in docs] + [(None, 1, 1), (3, 1, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    mined = quality.mine(frame, labels)
    assert set(np.sort(quality._hashes(slurs))) <= set(mined)
    kept = {r["doc_id"]: r["kept"] for r in quality.score(frame, quality.fit(frame, labels=labels)).collect()}
    assert sum(kept[i] != b for i, _, b in held) >= 0.98 * len(held)
    alone = quality.score(frame, quality.fit(frame)).where("not kept").count()
    assert alone < 10
    assert len(quality.mine(frame, labels.limit(0))) == 0 and len(quality.mine(frame.limit(0), labels)) == 0


def test_sample_is_the_same_every_time(spark):
    docs = graded(400, 3)
    frame = spark.createDataFrame(rows([(i, t) for i, t, _ in docs]), SCHEMA)
    a, b = quality.fit(frame, sample=100), quality.fit(frame.repartition(7), sample=100)
    for head in a.scorers:
        assert np.array_equal(a.scorers[head].keys, b.scorers[head].keys) and np.allclose(a.scorers[head].weights, b.scorers[head].weights)


def greedy_cut(groups, shards, total):
    """Groups that are cut when each goes, largest first, to the emptiest shard: a plain assignment to be beaten."""
    room = [total // shards + (s < total % shards) for s in range(shards)]
    cut = 0
    for n in sorted(groups, reverse=True):
        s = max(range(shards), key=room.__getitem__)
        if room[s] >= n:
            room[s] -= n
        else:
            cut += 1
            while n:
                s = max(range(shards), key=room.__getitem__)
                taken = min(n, room[s])
                assert taken
                room[s], n = room[s] - taken, n - taken
    return cut


@pytest.mark.parametrize("share", [0.4, 0.6, 0.9, 0.99])
def test_sharding_keeps_groups_that_fit(spark, share):
    """Groups of a large share of a shard: no more are cut than by a greedy assignment."""
    shards, quota = 6, 100
    n = int(share * quota)
    sizes = [n] * int(shards * (1 // share if share < 0.5 else 1))
    sizes += [3] * min(10, (shards * quota - sum(sizes)) // 3)
    sizes += [1] * (shards * quota - sum(sizes))
    texts_ = [f"text {g}" for g, k in enumerate(sizes) for _ in range(k)]
    placed = sharding.shard_documents(spark.createDataFrame(rows(list(enumerate(texts_))), SCHEMA), shards=shards)
    groups, whole = sharding.cut_groups(placed, "text_crc32").first()
    assert groups == sum(k > 1 for k in sizes)
    assert groups - whole <= greedy_cut([k for k in sizes if k > 1], shards, shards * quota)
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [quota] * shards


def test_pipeline(spark, tmp_path):
    good = [(i + 10_000, t) for i, t, bad in graded(150, 4) if not bad]
    docs = [*texts(), *good, (9_000, " ".join(["word%%%"] * 50)), (9_001, "you idiot " * 30), (None, "no id of mine")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows(docs)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    frame, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert frame.schema.simpleString() == spark.read.parquet(f"{tmp_path}/documents.parquet").schema.simpleString()
        now = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        ids = {i for i, _ in now}
        if k == 0:
            assert not {9_000, 9_001} & ids and {i for i, _ in good} <= ids
            assert set(now) <= set(before)
        elif k == 1:
            last = {}
            for i, t in before:
                last[lowered(t)] = max((x for x in (last.get(lowered(t)), i) if x is not None), default=None)
            assert Counter(ids) == Counter(set(last.values())) and len(now) == len(last)
        elif k == 2:
            found = components([d for d in before if d[0] is not None], 80, 5)
            assert ids == {i for i, _ in before if i is None or found[i][1] == i}
        elif k == 3:
            gone = defaultdict(set)
            for i, a, b in repeats(before):
                gone[i] |= set(range(a, b))
            rest = {i: [w for n, w in enumerate(split(t)) if n not in gone[i]] for i, t in before}
            assert {i: split(t) for i, t in now} == {i: w for i, w in rest.items() if w or not gone[i]}
    assert {r["doc_id"] for r in frame.select("doc_id").collect()} == {i for i, _ in now}


def test_pipeline_runs_as_a_whole(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_sharding_by_propagation(spark, monkeypatch, seed):
    """Groups up to a shard are placed by propagation at any size, nearly as many whole as the best assignment has."""
    rng = random.Random(seed)
    sizes = [rng.choice([2, 3, 5, 9, 14]) for _ in range(9)]
    docs = [(i, f"group {g}") for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    seated, real = [], sharding.seat
    monkeypatch.setattr(sharding, "seat", lambda groups, free: seated.extend(groups) or real(groups, free))
    placed = sharding.shard_documents(spark.createDataFrame(rows(docs), SCHEMA), shards=3)
    whole = sharding.cut_groups(placed, "text_crc32").first()["whole"]
    quota = [len(docs) // 3 + (s < len(docs) % 3) for s in range(3)]
    assert all(n > max(quota) for _, n in seated)

    def best(k, free):
        """Groups that can be whole, all assignments tried."""
        if k == len(sizes):
            return 0
        kept = [1 + best(k + 1, free[:s] + [free[s] - sizes[k]] + free[s + 1 :]) for s in range(3) if free[s] >= sizes[k]]
        return max([*kept, best(k + 1, free)])

    assert whole >= best(0, quota) - 2
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == sorted(quota)
