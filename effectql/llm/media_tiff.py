"""TIFF media columns: pages as rows.

``decode_tiff`` walks the image directories of a file, decodes its strips or tiles (none, LZW, deflate,
PackBits) of interleaved or separate planes, undoes the horizontal predictor and yields a page for each
directory. ``encode_tiff`` writes
such files from 8-bit samples without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_slices

# Fixed values of the TIFF 6.0 format: tags, field sizes, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, FILL_ORDER = 278, 279, 284, 317, 266
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


#: No scheme packs more samples in a byte (deflate reaches 1,032, LZW some 2,700); a page that claims more is broken.
MOST_EXPANSION = 4096
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class TiffError(ValueError):
    """A file that breaks the format or needs a part of it that isn't supported."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


# -- compression schemes


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of equal bytes and literal stretches of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if len(a) == 0:
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.concatenate((starts, [len(a)])))
    out, literal = bytearray(), bytearray()

    def flush():
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        if n < 3:
            literal.extend(data[start : start + n])
            continue
        flush()
        while n:
            run = min(n, 128)
            if run == 1:
                literal.append(data[start])
            else:
                out.append(257 - run)
                out.append(data[start])
            n -= run
    flush()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int):
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    known = {bytes([i]): i for i in range(256)}
    put(256, 9)
    width, following, w = 9, 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in known:
            w += c
            continue
        put(known[w], width)
        known[w + c] = following
        following += 1
        if following == 4094:
            put(256, width)
            known = {bytes([k]): k for k in range(256)}
            following, width = 258, 9
        elif following > (1 << width) - 1:
            width += 1
        w = c
    if w:
        put(known[w], width)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    held, bits, i, width = 0, 0, 0, 9
    known: list[bytes] = []
    previous = b""
    while len(out) < size:
        while bits < width:
            if i >= len(data):
                return bytes(out)
            held = (held << 8) | data[i]
            i += 1
            bits += 8
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            known = [bytes([k]) for k in range(256)] + [b"", b""]
            width, previous = 9, b""
            continue
        if not known:
            raise TiffError("LZW data without a clear code")
        if not previous:
            if code > 255:
                raise TiffError("LZW code out of range")
            entry = known[code]
        else:
            if code < len(known):
                entry = known[code]
            elif code == len(known):
                entry = previous + previous[:1]
            else:
                raise TiffError("LZW code out of range")
            known.append(previous + entry[:1])
            if len(known) >= (1 << width) - 1 and width < 12:
                width += 1
        out += entry
        previous = entry
    return bytes(out[:size])


def _compress(data: bytes, scheme: int, level: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == LZW:
        return lzw_encode(data)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, level)
    if scheme == PACKBITS:
        return pack_bits(data)
    raise TiffError(f"compression {scheme} isn't supported")


def _expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data[:size]
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if scheme == PACKBITS:
        return unpack_bits(data, size)[:size]
    raise TiffError(f"compression {scheme} isn't supported")


# -- files


def encode_tiff(
    data: bytes, width: int = 64, rows_per_page: int = 4096, compression: int = DEFLATE, predictor: int = 2,
    tile: int = 0, rows_per_strip: int = 1024, level: int = 1, order: str = "<",
) -> bytes:
    """8-bit grey samples, ``width`` in a row, as a file of one page for each ``rows_per_page`` rows.

    ``tile`` (a multiple of 16) stores square tiles, 0 strips. The length must be a multiple of width.
    """
    if not data or len(data) % width:
        raise TiffError("the length must be a positive multiple of the width")
    whole = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + "HI", 42, 0)
    link = 4
    for top in range(0, len(whole), rows_per_page):
        page = whole[top : top + rows_per_page]
        blocks = []
        if tile:
            for y in range(0, len(page), tile):
                for x in range(0, width, tile):
                    part = page[y : y + tile, x : x + tile]
                    blocks.append(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]))))
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, len(page), rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            packed = _compress(np.ascontiguousarray(block).tobytes(), compression, level)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]),
                  (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{FIELD_CODE[kind]}", *values)
            if len(body) > 4:
                place = len(out)
                out += body
                body = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The fields of the directory at ``at``, and where the next directory lies."""
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        out = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD_CODE:
                continue
            size = FIELD_SIZE[kind] * count
            place = at + 10 + 12 * k
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            out[tag] = list(struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, place))
        return out, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"a directory leaves the file: {e}") from e


def decode_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; whatever is broken raises TiffError."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        f, following = _fields(data, at, order)
        yield _page(data, f, order, len(seen) - 1)
        at = following


def _samples(block: bytes, rows: int, wide: int, samples: int, bits: int, order: str) -> np.ndarray:
    """rows x wide x samples; samples of less than 8 bits are packed, each row from a new byte on."""
    if bits >= 8:
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        return np.frombuffer(block, kind).reshape(rows, wide, samples).astype(kind.newbyteorder("="))
    unpacked = np.unpackbits(np.frombuffer(block, np.uint8).reshape(rows, -1), axis=1)
    values = unpacked.reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))
    return values[:, : wide * samples].reshape(rows, wide, samples).astype(np.uint8)


def _page(data: bytes, f: dict[int, list[int]], order: str, number: int) -> Page:
    """A page's samples, interleaved, row by row: a byte each up to 8 bits, two (of this machine) for 16."""
    if any(not v for v in f.values()):
        raise TiffError("a field without values")
    if WIDTH not in f or LENGTH not in f or not f[WIDTH][0] or not f[LENGTH][0]:
        raise TiffError("a directory without width or length")
    width, height = f[WIDTH][0], f[LENGTH][0]
    bits, samples = f.get(BITS, [1])[0], f.get(SAMPLES, [1])[0]
    scheme, predictor, planar = f.get(COMPRESSION, [NONE])[0], f.get(PREDICTOR, [1])[0], f.get(PLANAR, [1])[0]
    if bits not in (1, 2, 4, 8, 16) or len(set(f.get(BITS, [bits]))) > 1 or not samples:
        raise TiffError("samples must all be of 1, 2, 4, 8 or 16 bits")
    if planar not in (1, 2) or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise TiffError("this planar configuration or predictor isn't supported")
    if width * height * samples * bits > 8 * MOST_EXPANSION * len(data):
        raise TiffError("a page claims more samples than the file can hold")
    tiled = TILE_OFFSETS in f
    if tiled:
        wide, high = f.get(TILE_WIDTH, [0])[0], f.get(TILE_LENGTH, [0])[0]
        offsets, counts = f[TILE_OFFSETS], f.get(TILE_COUNTS, [])
    else:
        wide, high = width, min(f.get(ROWS_PER_STRIP, [height])[0], height)
        offsets, counts = f.get(STRIP_OFFSETS, []), f.get(STRIP_COUNTS, [])
        if not counts and len(offsets) == 1 and scheme == NONE:
            counts = [len(data)]
    if not wide or not high:
        raise TiffError("strips or tiles without size")
    across, down = -(-width // wide), -(-height // high)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if not len(offsets) == len(counts) == across * down * planes:
        raise TiffError("strips or tiles don't cover the page")
    if tiled and across * wide * down * high * samples * bits > 8 * MOST_EXPANSION * len(data):
        raise TiffError("tiles claim more samples than the file can hold")
    out = np.zeros((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, at = divmod(i, across * down)
        y, x = at // across * high, at % across * wide
        rows = high if tiled else min(high, height - y)
        size = rows * -(-wide * each * bits // 8)
        block = data[offset : offset + count]
        block = _expand(block.translate(_REVERSED) if f.get(FILL_ORDER, [1])[0] == 2 else block, scheme, size)
        if len(block) < size:
            raise TiffError("a strip or tile ends early")
        a = _samples(block, rows, wide, each, bits, order)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=out.dtype)
        part = a[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + each] = part
    return Page(number, width, height, bits, samples, scheme, predictor, tiled, out.tobytes())


# -- columns

PAGE_COLUMNS = (
    "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, "
    "data binary, error string"
)


def tiff_pages(files: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page of each file; the other columns are kept, ``column`` is dropped.

    A null or broken file gives a row with page -1 and an error (after the pages that could be read). So
    does what isn't supported: other schemes than none, LZW, deflate and PackBits, samples of other than 1,
    2, 4, 8 or 16 bits, floating-point predictors.
    Rows follow each other in the order of the files and pages of their partition.
    """
    keep = [c for c in files.columns if c != column]
    ordered = files.select(*keep, column)
    names = [*keep, "page", "width", "height", "bits", "samples", "compression", "predictor", "tiled", "data", "error"]
    kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column, 4 << 20):
            source, made = [], []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    for p in decode_tiff(data or b""):
                        made.append((p.number, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.tiled, p.data, None))
                        source.append(i)
                except TiffError as e:
                    made.append((-1, None, None, None, None, None, None, None, None, str(e)))
                    source.append(i)
            if made:
                kept = [batch.column(k).take(pa.array(source)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1])
    return ordered.mapInArrow(run, f"{schema}, {PAGE_COLUMNS}")


def text_media(docs: DataFrame, width: int = 64, **options) -> DataFrame:
    """doc_id, row (tells rows of a partition apart), n_bytes, media: texts as TIFF files.

    The text's UTF-8 (null: empty) is padded with bytes 0 to a positive multiple of ``width``.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in text_slices(batches):
            raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [encode_tiff(x + b"\0" * ((-len(x)) % width if x else width), width, **options) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(row, row + len(raw)), pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "row", "n_bytes", "media"],
            )
            row += len(raw)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, row long, n_bytes long, media binary"
    )


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, pages long, feature string"
)


def page_features(pages: DataFrame) -> DataFrame:
    """Payload digests and features of documents from the page rows of ``tiff_pages``.

    The pages of a file follow each other in a partition; the pass keeps the digest, a histogram of 256
    counts and the last bytes of one file, whatever the file's size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, out = None, None, []

        def flush():
            if state is None:
                return
            n, counts = state["n"], state["counts"]
            values = np.arange(256)
            mean = float((counts * values).sum()) / max(n, 1)
            spread = (float((counts * values * values).sum()) / max(n, 1) - mean * mean) ** 0.5
            share = counts[counts > 0] / max(n, 1)
            feature = f"mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};distinct={int((counts > 0).sum())};zeros={int(counts[0])}"
            out.append((
                state["doc_id"], state["n_bytes"], n, state["sha"].hexdigest(), zlib.crc32(state["tail"]),
                state["media_bytes"], state["media_sha256"], state["pages"], feature,
            ))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "row", "n_bytes", "media_bytes", "media_sha256", "data", "error")]
            for doc_id, r, n_bytes, media_bytes, media_sha256, data, error in zip(*columns, strict=True):
                if error is not None:
                    raise TiffError(f"document {doc_id}: {error}")
                if r != row or state is None:
                    flush()
                    row = r
                    state = {"doc_id": doc_id, "n_bytes": n_bytes, "n": 0, "sha": hashlib.sha256(), "tail": b"", "media_bytes": media_bytes,
                             "media_sha256": media_sha256, "pages": 0, "counts": np.zeros(256, np.int64)}
                state["n"] += len(data)
                state["sha"].update(data)
                state["tail"] = (state["tail"] + data[-64:])[-64:]
                state["pages"] += 1
                state["counts"] += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            if len(out) >= 256:
                yield _features(out)
                out = []
        flush()
        if out:
            yield _features(out)

    return pages.mapInArrow(run, FEATURES)


def _features(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = text_media(table(spark, sf_dir, "documents"))
    stored = media.withColumn("media_bytes", F.length("media").cast("long")).withColumn(
        "media_sha256", F.sha2("media", 256)
    )
    return page_features(tiff_pages(stored))


NAME = "op4_tiff"
SQL = None
