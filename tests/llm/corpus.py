"""A small corpus with every odd case, and plain references for the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, sid long, kept boolean, hub string, number long"


def rows(texts):
    """Rows of documents from (doc_id, text); further columns have names that operators use inside."""
    return [(i, t, "en", "s", len(t) if t is not None else None, "d", 1, None, "h", None) for i, t in texts]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=7):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70, 10_000))
    base = words(rng, 200, 10_000)
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE TWO"), (8, "é É ß"), (9, "a\x1cb c\x85d e")]
    out += [(20 + i, " ".join(base)) for i in range(6)]  # copies
    for i in range(30):  # near copies, each with a few other words
        w = list(base)
        for k in rng.sample(range(200), rng.choice((1, 2, 4, 6))):
            w[k] = f"x{i}x{k}"
        out.append((40 + i, " ".join(w)))
    chain = words(rng, 100, 10_000)
    for i in range(6):  # a chain in which only neighbours are alike
        out.append((80 + i, " ".join(chain)))
        chain = chain[2:] + [f"c{i}", f"d{i}"]
    out += [(100 + i, " ".join(words(rng, 30, 10_000)) + "\n" + passage + "  " + " ".join(words(rng, 25, 10_000))) for i in range(5)]
    out += [(120 + i, " ".join(words(rng, rng.randrange(5, 60)))) for i in range(20)]
    out += [(150, "x" * 30_000), (151, " ".join(["same"] * 4000)), (152, " ".join(words(rng, 9000, 10_000)))]
    out += [(160, "And the line of it is here."), (161, "And the line of it is here."), (-5, "minus one two three four five six")]
    rng.shuffle(out)
    return out


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lowered(text))


def shingles(text, size):
    w = split(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs, percent, size):
    """doc_id -> (number of shingles, smallest id that links lead to), all pairs compared."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(docs, least=50):
    """(doc_id, first word, word behind) of stretches whose passages occur earlier."""
    seen, out = set(), []
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w, found = split(t), []
        for k in range(len(w) - least + 1):
            passage = tuple(w[k : k + least])
            if passage in seen:
                if found and k <= found[-1][1]:
                    found[-1][1] = k + least
                else:
                    found.append([k, k + least])
            seen.add(passage)
        out += [(i, a, b) for a, b in found]
    return out
