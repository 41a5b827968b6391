"""BPE encoding and decoding with forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can never be merged, so a word may be
cut between them before any merge is tried. The fragments are encoded independently, all of a batch
side by side in arrays, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_slices
from .wordhash import words_of

#: White space of the vocabulary's pattern beyond ASCII; 1C to 1F are symbols there.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Chunks remembered by a worker, in some 40 bytes each.
REMEMBERED = 600_000
#: Longer fragments are merged by a heap of their own, not along with the others.
LONG = 200
#: Rank of a pair that never merges.
NEVER = np.int32(2**31 - 1)
#: Letters whose class or lower case depends on the Unicode version: words with them go to the library.
_RARE = re.compile("[\u023a\u023e\u0530-\U0010ffff]")


def _byte_alphabet() -> dict[int, str]:
    """The usual printable stand-ins for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _normal(text: str) -> str:
    """NFC and lower case, each character for itself (so sigma has one form)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def _shown(text: str) -> str:
    """The text as it is split: in normal form, unless the library has to make it, with blanks for wide white space."""
    if text.isascii():
        return text.lower()
    if not _RARE.search(text):
        text = _normal(text)
    return _WIDE.sub(" ", text)


class _Memory:
    """The ids of chunks by the chunks' hashes, in sorted arrays: a large pair and a small one for what came last."""

    def __init__(self):
        self.size, self._used = 0, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._parts = [empty, empty]

    @staticmethod
    def _at(part: tuple, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(part[0]):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(part[0], hashes), len(part[0]) - 1)
        return place, part[0][place] == hashes

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        return self._at(self._parts[0], hashes)[1] | self._at(self._parts[1], hashes)[1]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of known chunks begin in ``ids``, and how many they are."""
        start, many = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for part in self._parts:
            place, there = self._at(part, hashes)
            start[there], many[there] = part[1][place[there]], part[2][place[there]]
        return start, many

    def learn(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Add chunks by sorted hashes that are not known."""
        told = np.frombuffer(b"".join(ids), np.uint32)
        many = np.array([len(x) >> 2 for x in ids], np.int64)
        while self._used + len(told) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self._used : self._used + len(told)] = told
        fresh = hashes, self._used + np.cumsum(many) - many, many
        self._used += len(told)
        self.size += len(hashes)
        large, small = self._parts
        small = self._joined(small, fresh)
        self._parts = [self._joined(large, small), tuple(x[:0] for x in small)] if len(small[0]) > 1 << 15 else [large, small]

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        place = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, place, y) for x, y in zip(a, b, strict=True))


class ForcedCutBpe:
    """Encodes and decodes as the tokenizers library does for a word-end BPE file.

    Built for files with NFC, white-space and lower-case normalisation, a splitting pattern, the byte
    alphabet and a word-end suffix; anything else raises ValueError.
    """

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None
            or [p["type"] for p in pre] != ["Split", "ByteLevel"] or not model["end_of_word_suffix"]
        ):
            raise ValueError("not a lower-case word-end BPE file")
        self.source, self._library = source, None
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self._pattern_or_line = regex.compile(pre[0]["pattern"]["Regex"] + "|\n")
        shown = _byte_alphabet()
        code = {s: b for b, s in shown.items()}
        self._from_shown = code
        #: inside[a, b]: the bytes a, b stand side by side in some token; elsewhere a cut is certain.
        self.inside = np.zeros((256, 256), bool)
        for t in self.vocab:
            t = t.removesuffix(self.end)
            for x, y in zip(t, t[1:], strict=False):
                self.inside[code[x], code[y]] = True
        none = len(self.vocab) + len(self.special)
        self._none = none
        self._first = np.array([self.vocab.get(shown[b], none) for b in range(256)], np.int32)
        self._last = np.array([self.vocab.get(shown[b] + self.end, none) for b in range(256)], np.int32)
        self._merged = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        pairs = np.array([(self.vocab[a], self.vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self._keys = pairs[:, 0] << 20 | pairs[:, 1]
        self._build_table()
        self.ranks = {int(k): i for i, k in enumerate(self._keys)}
        self._memory = _Memory()

    # -- ranks of pairs: an open hash table in arrays

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _build_table(self) -> None:
        self._table_keys = np.full((1 << 20) + 64, -1, np.int64)
        self._table_ranks = np.full((1 << 20) + 64, NEVER, np.int32)
        self._probes = 1
        for rank, (key, slot) in enumerate(zip(self._keys.tolist(), self._slot(self._keys).tolist(), strict=True)):
            k = 0
            while self._table_keys[slot + k] not in (-1, key):
                k += 1
            if self._table_keys[slot + k] == -1:
                self._table_keys[slot + k], self._table_ranks[slot + k] = key, rank
            self._probes = max(self._probes, k + 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        slots = self._slot(keys)
        found = np.where(self._table_keys[slots] == keys, self._table_ranks[slots], NEVER)
        for k in range(1, self._probes):
            again = np.flatnonzero((found == NEVER) & (self._table_keys[slots] != -1))
            if len(again) == 0:
                break
            at = slots[again] + k
            found[again] = np.where(self._table_keys[at] == keys[again], self._table_ranks[at], NEVER)
        return found

    # -- fragments and words

    def cuts(self, word: bytes) -> list[int]:
        """Places in a word's bytes where a cut is certain."""
        x = np.frombuffer(word, np.uint8)
        return (np.flatnonzero(~self.inside[x[:-1], x[1:]]) + 1).tolist()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of the pattern: cut at forced boundaries, all fragments merged side by side.

        A round finds the lowest rank of each unfinished fragment and merges its first pair of that
        rank, in arrays over all fragments.
        """
        if not words:
            return []
        data = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        line = data == 10
        ends = np.flatnonzero(line)
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        fresh = np.ones(len(data), bool)
        fresh[1:] = line[:-1] | ~self.inside[data[:-1], data[1:]]
        symbols = np.where(last, self._last[data], self._first[data])[~line]
        word = (np.cumsum(line) - line)[~line]
        fragment = np.cumsum(fresh[~line]) - 1
        owner = word[np.flatnonzero(np.diff(fragment, prepend=-1))]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.bincount(fragment)
        for f in np.flatnonzero(sizes > LONG).tolist():
            ids = np.array(self._merge_long(symbols[fragment == f].tolist()), np.int32)
            done.append((np.full(len(ids), f), ids))
        if len(done):
            short = sizes[fragment] <= LONG
            symbols, fragment = symbols[short], fragment[short]
        ranks = np.full(len(symbols), NEVER, np.int32)
        if len(symbols) > 1:
            ranks[:-1] = np.where(fragment[:-1] == fragment[1:], self._rank(symbols[:-1], symbols[1:]), NEVER)
        while len(symbols):
            starts = np.flatnonzero(np.diff(fragment, prepend=-1))
            counts = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            if (least == NEVER).any():
                over = np.repeat(least == NEVER, counts)
                done.append((fragment[over], symbols[over]))
                symbols, fragment, ranks = symbols[~over], fragment[~over], ranks[~over]
                counts, least = counts[least != NEVER], least[least != NEVER]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, counts))
            at = at[np.diff(fragment[at], prepend=-1) != 0]
            symbols[at] = self._merged[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, fragment, ranks = symbols[stay], fragment[stay], ranks[stay]
            at = at - np.arange(len(at))
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(symbols))]
                ranks[left] = np.where(
                    fragment[left] == fragment[left + 1], self._rank(symbols[left], symbols[left + 1]), NEVER
                )
            if at[-1] == len(symbols) - 1:
                ranks[-1] = NEVER
        fragments = np.concatenate([f for f, _ in done])
        ids = np.concatenate([s for _, s in done])
        order = np.argsort(fragments, kind="stable")
        fragments, ids = fragments[order], ids[order]
        known = ids != self._none
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[fragments[known]], minlength=len(words))))) * 4
        out = ids[known].astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The merges of a long fragment in n log n steps: a heap of pairs over a linked list."""
        n, merged = len(parts), self._merged.tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def rank(i: int, j: int) -> int | None:
            return self.ranks.get(parts[i] << 20 | parts[j])

        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j] = merged[r], 1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (r := rank(k, right[k])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without white space."""
        words: list[list[str]] = [[]] * len(chunks)
        mixed, rare = [], []
        for k, c in enumerate(chunks):
            if not c.isascii():
                (rare if _RARE.search(c) else mixed).append(k)
            elif c.isalpha():  # one word of the pattern
                words[k] = [c.lower()]
            else:
                mixed.append(k)
        if mixed:
            split: list[list[str]] = [[]]
            for w in self._pattern_or_line.findall(_normal("\n".join([chunks[k] for k in mixed]))):
                if w == "\n":
                    split.append([])
                else:
                    split[-1].append(w)
            for k, ws in zip(mixed, split, strict=True):
                words[k] = ws
        if rare:
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.source)
            for k in rare:
                split_ = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunks[k]))
                words[k] = [bytes(self._from_shown[x] for x in w).decode() for w, _ in split_]
        distinct = list({w for ws in words for w in ws})
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in words]

    # -- texts

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers in the machine's order (little-endian).

        Chunks between white space are told apart by 64-bit hashes and looked up in arrays, so that one that was
        seen before costs no Python object.
        """
        if self._special_split and any(s in text for text in texts for s in self.special):
            parts = [[p for p in self._special_split.split(text) if p] for text in texts]
            plain = iter(self.encode_batch([p for ps in parts for p in ps if p not in self.special]))
            return [b"".join([array("I", [self.special[p]]).tobytes() if p in self.special else next(plain) for p in ps]) for ps in parts]
        words = words_of(pa.array([_shown(text) for text in texts], pa.string()))
        if not len(words.hashes):
            return [b""] * len(texts)
        hashes, which = np.unique(words.hashes, return_inverse=True)
        if self._memory.size > REMEMBERED:
            self._memory = _Memory()
        new = np.flatnonzero(~self._memory.knows(hashes))
        if len(new):
            one = np.empty(len(hashes), np.int64)
            one[which] = np.arange(len(which))
            data = words.data.tobytes()
            spans = zip(words.start[one[new]].tolist(), words.end[one[new]].tolist(), strict=True)
            self._memory.learn(hashes[new], self._learn([data[a:b].decode() for a, b in spans]))
        start, many = self._memory.find(hashes)
        many = many[which]
        before = np.concatenate(([0], np.cumsum(many)))
        ids = self._memory.ids[np.repeat(start[which] - before[:-1], many) + np.arange(before[-1])].tobytes()
        bounds = (before[words.first] * 4).tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False) of a file without decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_loaded: dict[str, ForcedCutBpe] = {}


def tokenizer(source: str) -> ForcedCutBpe:
    """One tokenizer for each worker process, so that its memory of words outlives a task."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = ForcedCutBpe(source)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens for each row of ``docs``.

    Null text is empty and has no ids. Whole texts are encoded; repeated rows each give a row; only the
    two named columns are read; an empty table gives no rows. The driver reads the vocabulary (a file of
    fixed size) and broadcasts it, so executors need no copy of it.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = spark.sparkContext.broadcast(read_source(path or default_path()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(source.value)
        for batch in text_slices(batches):
            ids = t.encode_batch([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                ["doc_id", "ids", "n_tokens"],
            )

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_ids(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id", "ids", "n_tokens")) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``; null ids give an empty text."""
    spark = encoded.sparkSession
    source = spark.sparkContext.broadcast(read_source(path or default_path()))
    kept = encoded.select(*keep)
    place = keep.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(source.value)
        for batch in text_slices(batches, "ids"):
            texts = [t.decode(x or b"") for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "decoded"])

    fields: Any = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_ids(encode_documents(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


NAME = "op9_bpe"
SQL = None
