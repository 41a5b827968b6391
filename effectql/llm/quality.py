"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document or abstain. Expectation-maximisation estimates how
often each of them votes on good and on bad documents; all it needs are the counts of vote patterns, which
are taken over the whole corpus. Its posteriors label a bounded sample, on which a linear scorer over
hashed features is fitted; the scorer then judges every document. This is done for two heads: prose
that isn't worth keeping (``junk``) and abuse (``toxic``).

Labellers of junk go by the form of a text. Those of abuse go by words: nouns and adjectives of general
word lists in four languages, and, where some documents are labelled, words that abusive ones have and
others lack. The latter are mined from at most LABELLED labelled rows and dealt by hash to two labellers,
which so don't share a word. Labels are used for nothing else; without any, these two labellers abstain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_slices
from .wordhash import Words, column_bytes, mix, separators, words_of

#: Documents on which the scorer is fitted, at most (about; they are drawn by a hash of text and id).
SAMPLE = 8_000
#: Labelled rows from which words are mined, at most (those with the least hash of their id), and words that are kept.
LABELLED, MINED = 20_000, 4_096
#: A mined word stands in this many abusive documents at least, and this share of the documents that have it is abusive.
MINED_LEAST, MINED_SHARE = 4, 0.7
#: Features that fewer sampled documents have aren't used; words must also lie mostly in bad documents.
LEAST, LEAST_WORDS, BAD_SHARE = 4, 8, 0.6
REJECT = 0.5

# Fixed word lists: common function words of four languages, and common insults.
FUNCTION_WORDS = (
    "the of and to in is that for on with as by this be are was it at from or an a "
    "le la les de des et en un une que qui dans pour par sur est au avec plus pas du "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine "
    "el los las y del se con es no al lo para una"
).split()
# General word lists of abuse: what people are called, and what is said of them.
ABUSE_NOUNS = (
    "idiot idiots moron morons imbecile cretin loser losers scum scumbag trash vermin clown clowns jerk jerks bastard bastards "
    "bitch asshole dumbass dickhead prick twat wanker maggot filth pig swine coward freak pervert parasite fool fools dimwit halfwit "
    "abschaum arschloch arschlöcher depp deppen trottel vollidiot schwachkopf dummkopf mistkerl drecksau schlampe hurensohn wichser versager "
    "salaud salope connard connards connasse crétin abruti ordure raclure enculé bâtard imbécile racaille pourriture minable "
    "imbécil cabrón gilipollas pendejo basura escoria payaso perdedor hijoputa malnacido mamón cretino zorra"
).split()
ABUSE_ADJECTIVES = (
    "stupid pathetic worthless disgusting dumb idiotic moronic filthy useless brainless gutless spineless repulsive vile despicable "
    "braindead retarded ugly ridiculous revolting contemptible subhuman "
    "dumm dämlich blöd bescheuert widerlich ekelhaft erbärmlich wertlos hirnlos nutzlos verblödet armselig "
    "stupide débile pathétique dégoûtant dégueulasse méprisable répugnant pitoyable nul nulle "
    "estúpido estúpida idiota patético patética asqueroso asquerosa inútil despreciable repugnante miserable"
).split()

_LETTERS = separators(bytes(b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*^~{}<>@=+\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(words_of(pa.array([" ".join(words)]), _LETTERS).hashes)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if len(known) == 0:
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


#: Ways to be bad, by the labellers that look for them.
KINDS: dict[str, list[list[int]]] = {"junk": [[0, 1], [2, 3], [4, 5], [6, 7]], "toxic": [[0, 1, 2, 3]]}
#: Labellers: the head they speak to, and what they go by. A vote always speaks against a document.
LABELLERS: dict[str, list[str]] = {
    "junk": ["symbols", "symbol_ends", "capitals", "exclamations", "repeats", "sameness", "bare_marks", "no_function_words"],
    "toxic": ["abuse_nouns", "abuse_adjectives", "mined_a", "mined_b"],
}
_MEASURES = ("symbols", "symbol_ends", "capitals", "exclamations", "repeats", "sameness", "bare_marks", "function_words")


@dataclass
class Measured:
    """Measures of each row (an array for each), its words of letters, and which labellers vote."""

    words: int
    measures: dict[str, np.ndarray]
    letters: Words
    votes: dict[str, np.ndarray]


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[first[1:]] - total[first[:-1]]).astype(float)


_NOUNS, _ADJECTIVES = _hashes(ABUSE_NOUNS), _hashes(ABUSE_ADJECTIVES)
_FUNCTION = _hashes(FUNCTION_WORDS)
_NONE = np.zeros(0, np.uint64)


def measure(column: pa.Array, mined: np.ndarray = _NONE) -> Measured:
    """All labellers' measures and votes for the texts of a column. Texts without words get no votes.

    ``mined``: sorted hashes of words of labelled abuse.
    """
    spaced = words_of(column)
    letters = words_of(column, _LETTERS)
    data, rows = spaced.data, np.asarray(letters.first)
    n, ln = np.maximum(spaced.counts, 1), np.maximum(letters.counts, 1)
    _, offsets = column_bytes(column)
    length = np.maximum(np.diff(offsets), 1)
    tail = data[spaced.end - 1] if len(spaced.end) else np.zeros(0, np.uint8)
    before = data[np.maximum(spaced.end - 2, 0)] if len(spaced.end) else tail
    long_enough = spaced.end - spaced.start >= 3
    alnum = np.concatenate(([0], np.cumsum(_ALNUM[data])))
    same = np.zeros(len(letters.hashes), bool)
    same[1:] = letters.hashes[1:] == letters.hashes[:-1]
    owner = np.repeat(np.arange(len(column)), letters.counts)
    same[1:] &= owner[1:] == owner[:-1]
    order = np.lexsort((letters.hashes, owner))
    h, o = letters.hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=len(column)).astype(float)
    capital = _sums(_UPPER[data], offsets)
    m = {
        "symbols": _sums(_SYMBOL[data], offsets) / length,
        "symbol_ends": _sums(_SYMBOL[tail] & (tail == before) & long_enough, spaced.first) / n,
        "capitals": capital / np.maximum(_sums(_LETTER[data], offsets), 1),
        "exclamations": _sums((tail == 33) & (before == 33), spaced.first) / n,
        "repeats": _sums(same, rows) / ln,
        "sameness": 1 - distinct / ln,
        "bare_marks": _sums(alnum[spaced.end] == alnum[spaced.start], spaced.first) / n,
        "function_words": _sums(_member(letters.hashes, _FUNCTION), rows) / ln,
    }
    count = letters.counts
    half = mix(mined) & np.uint64(1) == 1
    lists = {"abuse_nouns": _NOUNS, "abuse_adjectives": _ADJECTIVES, "mined_a": mined[half], "mined_b": mined[~half]}
    votes = {
        "symbols": m["symbols"] > 0.03,
        "symbol_ends": m["symbol_ends"] > 0.2,
        "capitals": (m["capitals"] > 0.5) & (count >= 5),
        "exclamations": m["exclamations"] > 0.1,
        "repeats": (m["repeats"] > 0.2) & (count >= 10),
        "sameness": (distinct < 0.12 * np.minimum(ln, 2000)) & (count >= 20),
        "bare_marks": (m["bare_marks"] > 0.15) & (count >= 3),
        "no_function_words": (m["function_words"] < 0.03) & (count >= 20),
    }
    votes |= {name: _sums(_member(letters.hashes, x), rows) > 0 for name, x in lists.items()}
    return Measured(int(spaced.counts.sum()), m, letters, votes)


def patterns(column: pa.Array, mined: np.ndarray = _NONE) -> np.ndarray:
    """The votes of each row as bits, labellers of all heads in order."""
    return _bits(measure(column, mined).votes, len(column))


def _bits(votes: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for i, name in enumerate(x for names in LABELLERS.values() for x in names):
        out |= votes[name].astype(np.int64) << i
    return out


#: Hashed features of measures are even, those of words odd.
_ODD = np.uint64(1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and where each row's begin: its distinct words and in which step each measure lies."""
    return _features(measure(column), len(column))


def _features(found: Measured, n: int) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(n), found.letters.counts)
    value = found.letters.hashes | _ODD
    for i, name in enumerate(_MEASURES):
        step = np.minimum((found.measures[name] * 20).astype(np.int64), 19)
        few = np.minimum(found.letters.counts, 20) // 10
        value = np.concatenate((value, mix(((i * 32 + step) * 4 + few + 1).astype(np.uint64) << np.uint64(40)) & ~_ODD))
        owner = np.concatenate((owner, np.arange(n)))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(n + 1))


@dataclass
class LabelModel:
    """Shares of good documents and of each kind of bad ones, and how often each labeller votes on them."""

    shares: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each kind (the first is good) from votes (documents x labellers)."""
        z = np.log(self.shares) + votes @ np.log(self.rates).T + (1 - votes) @ np.log(1 - self.rates).T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def bad(self, votes: np.ndarray) -> np.ndarray:
        return 1 - self.posterior(votes)[:, 0]


def fit_labels(votes: np.ndarray, counts: np.ndarray, kinds: list[list[int]], steps: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Documents are good or bad in one of several ways; ``kinds`` names the labellers that each way begins
    with. Labellers vote on their own given the kind, and all their rates are estimated, those on good
    documents included. Only the start tells good from bad: documents without votes begin as good.
    """
    hold = np.full((len(votes), len(kinds) + 1), 0.02)
    hold[:, 0] = np.where(votes.any(axis=1), 0.02, 1)
    for k, names in enumerate(kinds, 1):
        hold[votes[:, names].any(axis=1), k] = 1
    hold /= hold.sum(axis=1, keepdims=True)
    for _ in range(steps):
        weight = hold * counts[:, None]
        total = weight.sum(axis=0)
        rates = (weight.T @ votes + 0.5) / (total + 1)[:, None]
        rates[0] = (weight[:, 0] @ votes + 0.01) / (total[0] + 10)  # a weak belief, worth ten documents, that labellers seldom err
        model = LabelModel((total + 1) / (total + 1).sum(), np.clip(rates, 1e-6, 1 - 1e-6))
        hold = model.posterior(votes)
    return model


@dataclass
class Scorer:
    """A linear model: hashes of features, sorted, and their weights."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of bad for rows of hashed features."""
        if len(self.keys) == 0:
            return np.full(len(first) - 1, 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        w = np.where(self.keys[at] == values, self.weights[at], 0.0)
        total = np.concatenate(([0.0], np.cumsum(w)))
        return 1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + self.bias, -500, 500)))


def fit_scorer(
    values: np.ndarray, first: np.ndarray, bad: np.ndarray, least: int = LEAST, share: float = 0.0, steps: int = 300, rate: float = 0.3, decay: float = 1e-3
) -> Scorer:
    """Logistic regression by full-batch gradient steps with a rate for each weight.

    Features need ``least`` documents, of which at least ``share`` are bad.
    """
    keys, index, counts = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = (counts >= least) & (np.bincount(index, bad[row], minlength=len(keys)) >= share * counts)
    used = keep[index]
    column = (np.cumsum(keep) - 1)[index[used]]
    row, keys = row[used], keys[keep]
    positive, n = bad.sum(), max(len(bad), 1)
    if positive < 1 or len(keys) == 0:
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    importance = bad * (0.3 * n / positive) + (1 - bad) * (0.7 * n / max(n - positive, 1))
    w, b = np.zeros(len(keys)), 0.0
    seen, seen_b = np.full(len(keys), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, w[column], minlength=len(bad)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - bad) * importance / n
        g = np.bincount(column, error[row], minlength=len(keys)) + decay * w / 10
        seen, seen_b = seen + g * g, seen_b + error.sum() ** 2
        w -= rate * g / np.sqrt(seen)
        b -= rate * error.sum() / np.sqrt(seen_b)
    return Scorer(keys, w, float(b))


@dataclass
class QualityModel:
    labels: dict[str, LabelModel]
    scorers: dict[str, Scorer]


def _votes(bits: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for head, names in LABELLERS.items():
        out[head] = ((bits[:, None] >> np.arange(at, at + len(names))) & 1).astype(float)
        at += len(names)
    return out


def mine(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> np.ndarray:
    """Sorted hashes of words that labelled abusive documents have and other labelled ones mostly lack.

    ``labels``: doc_id, toxic (0 or 1). Rows without either, or of no document, count for nothing; of
    labels that repeat an id the largest holds. At most ``most`` labels are read, those with the least hash
    of their id; they are broadcast. Words are counted on the executors, and at most MINED of them,
    those in the most abusive documents, are kept.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(drawn), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = words_of(batch.column(0), _LETTERS)
            toxic = np.asarray(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), found.counts)
            value, first = np.unique(np.stack((found.hashes, row.astype(np.uint64))), axis=1)
            word, index = np.unique(value, return_inverse=True)
            bad = np.bincount(index, toxic[first.astype(np.int64)], minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bad), pa.array(np.bincount(index, minlength=len(word)))], ["word", "bad", "n"])

    counted = labelled.mapInArrow(words, "word long, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    telling = counted.where((F.col("bad") >= MINED_LEAST) & (F.col("bad") >= MINED_SHARE * F.col("n")))
    kept = telling.orderBy(F.desc("bad"), "n", "word").limit(MINED).select("word").collect()
    return np.sort(np.array([r["word"] for r in kept], np.int64).view(np.uint64))


def fit(docs: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> QualityModel:
    """Fit labels on the votes of all ``docs``, and the scorers on about ``sample`` of them.

    ``labels`` (doc_id, toxic), where given, are what ``mine`` takes its words from. The driver gets the
    counts of vote patterns (at most 2 to the number of labellers) and the hashed features of the sample,
    which is the rows with the least hashes of id and text.
    """
    prepare(docs.sparkSession)
    mined = _NONE if labels is None else mine(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bits, counts = np.unique(patterns(batch.column(1), mined), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(counts)], ["bits", "n"])

    counted = texts.mapInArrow(vote, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).collect()
    bits = np.array([r["bits"] for r in counted], np.int64)
    counts = np.array([r["n"] for r in counted], float)
    total = int(counts.sum())
    if total == 0:
        nothing = Scorer(np.zeros(0, np.uint64), np.zeros(0), -5.0)
        return QualityModel({}, dict.fromkeys(LABELLERS, nothing))
    labels = {head: fit_labels(v, counts, KINDS[head]) for head, v in _votes(bits).items()}
    share = min(1.0, sample / total)

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = measure(batch.column(1), mined)
            values, first = _features(found, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array(_bits(found.votes, batch.num_rows)),
                    pa.array([values[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                ],
                ["luck", "bits", "features"],
            )

    # a hair more than the sample, then exactly those with the least hashes; equal rows are drawn together
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    near = texts.withColumn("luck", luck).where(F.col("luck") < int(share * (1 << 30)) + (share == 1))
    drawn = near.mapInArrow(sampled, "luck long, bits long, features binary").orderBy("luck", "bits", "features").limit(int(1.2 * sample) + 100).collect()
    values = [np.frombuffer(r["features"], np.uint64) for r in drawn]
    first = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
    every = np.concatenate([*values, np.zeros(0, np.uint64)])
    votes = _votes(np.array([r["bits"] for r in drawn], np.int64))
    scorers = {}
    # the form of a text speaks for junk, its words for abuse
    for head, parity, least, mostly in (("junk", 0, LEAST, 0.0), ("toxic", 1, LEAST_WORDS, BAD_SHARE)):
        used = (every & _ODD) == parity
        bounds = np.concatenate(([0], np.cumsum(used)))[first]
        scorers[head] = fit_scorer(every[used], bounds, labels[head].bad(votes[head]), least, mostly)
    return QualityModel(labels, scorers)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, junk and toxic (probabilities) and kept for each row.

    A text is kept if neither reaches REJECT. Null and empty texts have no evidence against them; they
    count as junk only if the scorer has learned so. Whole texts are scored; repeated rows each give a
    row; only doc_id and text are read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scorers = docs.sparkSession.sparkContext.broadcast(model.scorers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p = _scores(batch.column(1), scorers.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in p), pa.array(np.maximum(*p) < REJECT)], ["doc_id", "junk", "toxic", "kept"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, junk double, toxic double, kept boolean"
    )


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    prepare(docs.sparkSession)
    scorers = docs.sparkSession.sparkContext.broadcast(model.scorers)
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p = _scores(batch.column(place), scorers.value)
            yield batch.filter(pa.array(np.maximum(*p) < REJECT))

    return docs.mapInArrow(run, docs.schema)


def _scores(texts: pa.Array, scorers: dict[str, Scorer]) -> list[np.ndarray]:
    values, first = features(texts)
    return [np.round(scorers[h].score(values, first), 6) for h in ("junk", "toxic")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, labels=table(spark, sf_dir, "labels")))


NAME = "op1_quality"
SQL = None
