"""Elements of large JSON lists, read by many tasks.

Spark reads a dump in blocks, cut behind each closing brace. Whether a brace stands in a string, and how deep, depends
on all that comes before; so a first pass gives for each block how strings and brackets end in it, from either state it may begin
in, and these functions are composed block after block. A second pass, which knows where each block begins, tells whether the
list goes on over its edges, and a third one cuts the elements; those that lie across blocks are put together by the
block they begin in. The driver sees a row for each block and pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Escaped characters, and all that changes the state or parts elements.
_TOKEN = re.compile(r'\\.|["{}\[\],]', re.DOTALL)
#: The member of an object that holds the list.
MEMBER = "data"

_EDGES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("first", pa.string()), ("in_string", pa.list_(pa.bool_())), ("depth", pa.list_(pa.int64()))])
_ACROSS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("listed", pa.bool_()), ("parts", pa.bool_())])
_ELEMENTS = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("text", pa.string())])


@dataclass
class Block:
    """Where a block begins: in a string, how deep, in which kind of dump, and how it stands to its neighbours."""

    in_string: bool = False
    depth: int = 0
    bare: bool = False
    last: bool = False
    closed: bool = True  # the last text of the file is followed by a brace
    listed: bool = False
    owner: int = -1


class _Scan:
    """Walks the texts of a block and calls ``element`` with each element's text and whether it began before the block.

    ``listed`` is None where the block begins inside a member that an earlier block names.
    """

    def __init__(self, at: Block, listed: bool | None, element: Callable[[str, bool], None]):
        self.in_string, self.depth, self.listed, self.element = at.in_string, at.depth, listed, element
        self.level = 1 if at.bare else 2
        self.bare, self.key = at.bare, None
        self.parts: list[str] = []
        self.began_before, self.cut = True, False

    def inside(self) -> bool:
        return self.depth >= self.level and self.listed is not False

    def text(self, text: str) -> None:
        kept, quote = 0, 0
        for m in _TOKEN.finditer(text):
            c = m[0]
            if self.in_string:
                if c == '"':
                    self.in_string = False
                    if self.depth == 1 and not self.bare:
                        self.key = text[quote : m.start()]
            elif c == '"':
                self.in_string, quote = True, m.end()
            elif c in "{[":
                self.depth += 1
                if self.depth == self.level and (self.bare or c == "[" and self.depth == 2):
                    self.listed = self.bare or self.key == MEMBER
                    self.parts, kept, self.began_before = [], m.end(), False
                elif self.depth == self.level:
                    self.listed = False
            elif c in "}]":
                if self.depth == self.level and self.inside():
                    self._end(text[kept : m.start()])
                if self.depth == self.level:
                    self.listed = False
                self.depth -= 1
            elif c == "," and self.depth == self.level and self.inside():
                self._end(text[kept : m.start()])
                kept = m.end()
        if self.inside():
            self.parts.append(text[kept:])

    def _end(self, text: str) -> None:
        self.cut = True
        self.element("".join(self.parts) + text, self.began_before)
        self.parts, self.began_before = [], False


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The texts of each block, which lie one behind the other."""
    import itertools

    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "start", "value")), strict=True))
    for key, found in itertools.groupby(rows, lambda r: r[:2]):
        yield key, (r[2] for r in found)


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), texts in _by_block(batches):
        states, length, first = [[False, 0], [True, 0]], 0, ""
        for text in texts:
            length += len(text.encode()) + 1
            first = first or text.lstrip()[:1]
            for state in states:
                in_string, depth = state
                for m in _TOKEN.finditer(text + "}"):
                    c = m[0]
                    if c == '"':
                        in_string = not in_string
                    elif not in_string and c in "{[":
                        depth += 1
                    elif not in_string and c in "}]":
                        depth -= 1
                state[:] = in_string, depth
        yield pa.record_batch([[file], [start], [length], [first], [[s for s, _ in states]], [[d for _, d in states]]], schema=_EDGES)


def _texts(key: tuple[str, int], at: Block, texts: Iterable[str]) -> Iterator[str]:
    """Texts with the braces that stand behind them."""
    held = None
    for text in texts:
        if held is not None:
            yield held + "}"
        held = text
    if held is not None:
        yield held + "}" if not at.last or at.closed else held


def _across(told, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the list goes on behind each block (null: as before it), and whether an element ends in it."""
    for key, texts in _by_block(batches):
        at = told.value[key]
        scan = _Scan(at, None if at.depth >= (1 if at.bare else 2) else False, lambda text, before: None)
        for text in _texts(key, at, texts):
            scan.text(text)
        yield pa.record_batch([[key[0]], [key[1]], pa.array([scan.listed], pa.bool_()), [scan.cut or not scan.began_before]], schema=_ACROSS)


def _elements(told, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements (owner null), and parts of those that lie across blocks, with the block they begin in."""
    for (file, start), texts in _by_block(batches):
        at = told.value[file, start]
        out: list[tuple[int | None, str]] = []
        scan = _Scan(at, at.listed, lambda text, before, out=out, at=at: out.append((at.owner if before else None, text)))

        def batch(file=file, start=start, out=out):
            made = pa.record_batch([[file] * len(out), pa.array([o for o, _ in out], pa.int64()), [start] * len(out), pa.array([x for _, x in out], pa.string())], schema=_ELEMENTS)
            out.clear()
            return made

        for text in _texts((file, start), at, texts):
            scan.text(text)
            if len(out) >= 1024:
                yield batch()
        if scan.inside():
            out.append((at.owner if scan.began_before else start, "".join(scan.parts)))
        if out:
            yield batch()


def list_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record: the elements of the dumps' lists ({"data": [...]} or a bare list), as JSON in its shortest form.

    Strings lose their quotes, null is null. What is no JSON is given as it stands. Text of a list that breaks off is given up to there.
    A task holds one element of a dump, not the dump.
    """
    ship(spark)
    chunks = spark.read.option("lineSep", "}").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    sizes = {r["file_path"]: r["file_size"] for r in chunks.select("file_path", "file_size").distinct().collect()}
    chunks = chunks.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("start"), "value")
    edges = chunks.mapInArrow(_edges, "file string, start long, length long, first string, in_string array<boolean>, depth array<long>").collect()
    at: dict[tuple[str, int], Block] = {}
    read: dict[str, int] = {}
    state = Block()
    before = None
    for r in sorted(edges, key=lambda r: (r["file"], r["start"])):
        if r["file"] != before:
            state, before = Block(bare=r["first"] == "["), r["file"]
        at[r["file"], r["start"]] = Block(state.in_string, state.depth, state.bare)
        side = int(state.in_string)
        state = Block(r["in_string"][side], state.depth + r["depth"][side], state.bare)
        read[r["file"]] = read.get(r["file"], 0) + r["length"]
    lasts = {file: max(s for f, s in at if f == file) for file in read}
    for file, start in lasts.items():
        at[file, start].last, at[file, start].closed = True, read[file] == sizes[file]
    told = spark.sparkContext.broadcast(at)
    across = chunks.mapInArrow(lambda b: _across(told, b), "file string, start long, listed boolean, parts boolean").collect()
    listed, owner, before = False, -1, None
    for r in sorted(across, key=lambda r: (r["file"], r["start"])):
        if r["file"] != before:
            listed, owner, before = False, -1, r["file"]
        block = at[r["file"], r["start"]]
        block.listed, block.owner = listed, owner
        listed = listed if r["listed"] is None else r["listed"]
        owner = r["start"] if r["parts"] else owner
    known = spark.sparkContext.broadcast(at)
    found = chunks.mapInArrow(lambda b: _elements(known, b), "file string, owner long, start long, text string")
    # a part at a time of what lies across blocks: as many as an element has blocks
    joined = found.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    texts = found.where("owner is null").select("text").unionByName(joined.select(F.array_join("parts.text", "").alias("text"))).where(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
    return texts.select(F.when(F.trim(F.translate("text", "\r\n\t", "   ")) != "null", F.coalesce(F.get_json_object("text", "$"), "text")).alias("record"))
