"""Vector codes, source divergence and embedding near-dedup against plain references."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from effectql.llm import embedding_dedup, source_divergence, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, row long, code string, class string, comp long"


def vector_rows(vectors):
    return [(i, v, k, 1, "c", "x", 2) for i, v, k in vectors]


def odd_vectors(size):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [0.0] * size, 1), (903, [None] + [1.0] * (size - 1), 1), (904, [nan] * size, 1), (905, [-inf] + [1.0] * (size - 1), 1)]


def codes_reference(vectors, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, k) for i, v, k in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))
    size = len(whole[0]) // parts
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def found(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for w in cut:
            for p in range(parts):
                held[p, found(p, w[p])[1]].append(w[p])
        for (p, e), xs in held.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, errors = [], Counter()
    for (i, _, k), w in zip(kept, cut, strict=True):
        best = [found(p, w[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), k))
        errors[k] += out[-1][2]
    return sorted(((i, c, e, errors[k]) for i, c, e, k in out), key=repr), digest


@pytest.mark.parametrize("entries", [256, 5])
def test_vector_codes(spark, entries):
    rng = random.Random(entries)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    vectors = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in vectors]
    vectors += [(i + 400, v, k) for i, v, k in vectors[:40]] + [vectors[3], (None, vectors[5][1], None), (None, vectors[6][1], 2)]
    vectors += [(-1, [-0.0009765625] * 8, 1), (-2, [30.0] * 8, 1)]
    given = [*vectors, *(v for v in odd_vectors(8) if v[0] != 902)]
    rng.shuffle(given)
    fitted = vector_codes.VectorCodes(spark.createDataFrame(vector_rows(given), SCHEMA).repartition(5), entries=entries)
    got = sorted((tuple(r) for r in fitted.codes().collect()), key=repr)
    assert (got, fitted.digest()) == codes_reference(vectors, entries=entries)


def test_vector_codes_odd_tables(spark):
    empty = vector_codes.VectorCodes(spark.createDataFrame(vector_rows(odd_vectors(8)[:2]), SCHEMA))
    assert empty.codes().count() == 0 and empty.digest() == hashlib.sha256(b"").hexdigest()
    # a length that four doesn't divide is filled up; another length than the first one's is dropped; large components are bounded
    few = [(1, [1.0, 2.0, 3.0], None), (2, [1e30, 0.0, 0.0], None), (3, [1.0, 2.0], None)]
    got = {r["vec_id"]: r for r in vector_codes.VectorCodes(spark.createDataFrame(vector_rows(few), SCHEMA)).codes().collect()}
    assert set(got) == {1, 2} and got[1]["code"] == "00000000" and got[2]["code"] == "01010100" and got[1]["error"] == got[1]["label_error"] == 0


def links_reference(vectors, threshold=0.98):
    n = len(vectors)
    sound = [v is not None and len(v) > 0 and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, k in vectors]
    parent, links = list(range(n)), [0] * n

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            (_, v, k), (_, w, m) = vectors[a], vectors[b]
            if sound[a] and sound[b] and k == m and len(v) == len(w):
                dot = math.fsum(x * y for x, y in zip(v, w, strict=True))
                if dot / (math.sqrt(math.fsum(x * x for x in v)) * math.sqrt(math.fsum(x * x for x in w))) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[top(a)] = top(b)
    least = {}
    for x in range(n):
        i = vectors[x][0]
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    out = [(vectors[x][0], links[x], least.get(top(x))) for x in range(n)]
    return sorted(((i, k, c, i == c) for i, k, c in out), key=repr)


def near_copies(seed, size=24, labels=(0, 1, 2)):
    rng = np.random.default_rng(seed)
    out = [(int(i), rng.standard_normal(size), int(rng.choice(labels))) for i in range(250)]
    for i in range(120):  # copies of others at all distances around the threshold, some of another length
        _, v, k = out[int(rng.integers(250))]
        out.append((1000 + i, (v / np.linalg.norm(v) + rng.standard_normal(size) * rng.choice([0.01, 0.03, 0.04, 0.045]) * math.sqrt(24 / size)) * rng.choice([1, 3, 1e-3]), k))
    middle = rng.standard_normal(size)
    middle /= np.linalg.norm(middle)
    for i in range(150):  # a dense group and what lies around it
        out.append((2000 + i, middle + rng.standard_normal(size) * rng.choice([0.012, 0.02, 0.03]), 1))
    step = middle
    for i in range(12):  # a chain
        step = step + rng.standard_normal(size) * 0.02
        out.append((3000 + i, step, 2))
    out = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in out]
    out += [(4000 + i, v, k) for i, v, k in out[:10]] + [out[4], (None, out[5][1], out[5][2]), (5000, out[6][1], None), (None, [0.0] * size, 1), (5001, [1.0, 2.0], 1), (5002, [1.0, 2.0], 1)]
    return out + odd_vectors(size)


@pytest.mark.parametrize("seed, size", [(1, 24), (2, 24), (3, 5)])
def test_near_copies(spark, monkeypatch, seed, size):
    if seed == 2:  # many cells and tiles
        monkeypatch.setattr(embedding_dedup, "CELL", 8)
        monkeypatch.setattr(embedding_dedup, "TILE", 16)
    vectors = near_copies(seed, size)
    random.Random(seed).shuffle(vectors)
    got = embedding_dedup.linked_vectors(spark.createDataFrame(vector_rows(vectors), SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == links_reference(vectors)


def test_dense_groups_are_not_compared(monkeypatch):
    """Of a group of near copies hardly any member is compared with another, as a center stands for most."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(32)
    x = middle / np.linalg.norm(middle) + rng.standard_normal((600, 32)) * 0.012
    plan = embedding_dedup.Plan.drawn(0.98, [("a", v) for v in x[:300]], 600)
    core, near = plan.cores(x, np.array(["a"] * 600, object))
    assert (core >= 0).mean() > 0.95 and near.any(1).all()


def test_visited_cells_hold_all_in_reach():
    rng = np.random.default_rng(9)
    points = rng.integers(-4000, 4000, (400, 3)).astype(np.int16)
    tree = embedding_dedup._tree(points.astype(np.int64)[:100], 5)
    row, cell, home = embedding_dedup.visited(points, tree, np.full(400, 5), 900**2)
    at = dict(zip(row[home].tolist(), cell[home].tolist(), strict=True))
    there = set(zip(row.tolist(), cell.tolist(), strict=True))
    assert len(at) == 400 and len(there) == len(row)
    far = ((points[:, None].astype(np.int64) - points[None]) ** 2).sum(2)
    for u, v in zip(*np.nonzero(far <= 900**2), strict=True):
        assert (int(v), at[int(u)]) in there


def test_embeddings_without_rows(spark):
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def divergence_reference(docs, most=200):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in found[lang].items() if n >= 3]
        sources = sorted(s for k, s in groups if k == lang)

        def chances(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        whole = chances(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: chances(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            terms = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found_, limit in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found_, key=lambda r: (-r[1], r[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def divergence_docs(seed, sources):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Élan", "ÉLAN", "ß", "naïve", "日本", "a\x7fb"]
    out = []
    for _ in range(400):
        k = min(rng.randrange(sources), rng.randrange(sources))
        some = vocabulary[k * 5 : k * 5 + 120] + vocabulary[-6:]
        out.append((" ".join(rng.choice(some).upper() if rng.random() < 0.2 else rng.choice(some) for _ in range(rng.randrange(40))), rng.choice(["en", "fr"]), f"s{k}"))
    out += [(None, "en", "s1"), ("", None, "x"), ("alone", None, None), ("alone alone", None, "y"), ("Alone; alone9alone", "", ""), ("aa bb", "de", "only"), ("", "it", "a"), ("", "it", "b")]
    out += [("word " * 9000 + "xa " + "y" * 70_000, "en", "s0"), ("The" * 3, "en", "é"), *[("wax wbx", "en", "s2")] * 4]
    return out


DOCUMENTS = "text string, lang string, source string, doc_id long, term string, n long, p long, g long"


@pytest.mark.parametrize("rare, block, terms", [(8, 64, 1024), (2, 3, 16), (0, 64, 1024), (100, 4, 1024)])
def test_divergence(spark, monkeypatch, rare, block, terms):
    if rare == 2:
        monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 0)
    docs = divergence_docs(rare, 14)
    rows = [(*d, 1, "t", 5, 6, 7) for d in docs]
    found = source_divergence.Divergence(spark.createDataFrame(rows, DOCUMENTS).repartition(3), rare=rare, block=block, terms=terms)
    assert sorted(tuple(r) for r in found.report(20).collect()) == divergence_reference(docs, 20)


def test_terms_in_stretches(monkeypatch):
    """Long texts, and many entries, are counted bit by bit with the same sums."""
    docs = divergence_docs(3, 5)
    batch = pa.RecordBatch.from_pylist([{"text": t or "", "lang": k or "", "source": s or ""} for t, k, s in docs])

    def sums():
        out = defaultdict(lambda: [0, 0])
        for found in source_divergence._count([batch]):
            for r in found.to_pylist():
                out[r["lang"], r["source"], r["term"]][0] += r["n"]
                out[r["lang"], r["source"], r["term"]][1] += r["docs"]
        return out

    whole = sums()
    monkeypatch.setattr(source_divergence, "STRETCH", 100)
    monkeypatch.setattr(source_divergence, "ENTRIES", 50)
    assert sums() == whole and whole["en", "s0", "word"] == [9000, 1]


def test_divergence_without_rows(spark):
    assert source_divergence.Divergence(spark.createDataFrame([], DOCUMENTS)).report().count() == 0


def test_probability_of_large_counts(spark):
    """Exact where 10^9 x count leaves 64 bits."""
    n, total = 7_123_456_789_012, 9_000_000_000_000_123
    from pyspark.sql import functions as F

    row = spark.range(1).select(source_divergence.probability(F.lit(n), F.lit(total)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // total
