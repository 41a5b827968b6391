"""BPE, chat formatting, TIFF and page layout."""

import hashlib
import random
import re
import struct
import time
import zlib
from array import array

import numpy as np
import pytest
from corpus import SCHEMA, rows, texts

from effectql.llm import bpe, chat, html_layout, media_tiff

ODD = ["", " ", "<|endoftext|> A<|startoftext|>b", "Don't I'LL we've 12½ ² x\x1cy \x85z áÉ ΑΣ Σας İ ŉ ǰ 日本語 हिन्दी ﬁ 😀👍 a_b __ ﻿ x​y ՘", "Ⱥ aȺb", "ß ſ K Å ΐ é", "ab" * 900, "a" * 3000]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    docs = [*texts(), *((1000 + i, t) for i, t in enumerate(ODD)), (None, "no id"), (4, "One")]
    got = bpe.decode_ids(bpe.encode_documents(spark.createDataFrame(rows(docs), SCHEMA))).collect()
    assert len(got) == len(docs)
    expected = {}
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i] = (ids, library.decode(ids, skip_special_tokens=False))
    for r in got:
        assert (list(array("I", r["ids"])), r["decoded"]) == expected[r["doc_id"]]
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bpe_of_each_letter():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    mine = bpe.tokenizer(bpe.read_source(bpe.default_path()))
    probes = [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(1, 0x530)]
    for text, known in zip(probes, library.encode_batch(probes, add_special_tokens=False), strict=True):
        assert list(array("I", mine.encode(text))) == known.ids, text
    assert mine.cuts(b"qzx"), "some pair is in no token"


def test_chat_escapes():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        t = chat.ChatTokens(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<|", "|>", "a", "é", " ", "<|body|>", "<", "s>"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
        role = rng.choice(["user", "assistant", "system", "tool", "<s>", None])
        ids, a, b, chars = t.turn(role, text)
        assert t.read_turn(np.frombuffer(ids, "<u4")) == (role or "", text)
        assert t.text(np.frombuffer(ids, "<u4")[a:b]) == text
        assert len(t.render(ids)) == chars


def test_chat_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "yes </s>"), (2, 0, None, "x"), (2, None, "tool", "y"), (3, 5, "assistant", "é"), (3, 5, "assistant", "é"), (None, 0, "user", "z")]
    turns += [(4, k, "assistant" if k % 2 else "user", f"text {k} " * 50) for k in range(300)]
    schema = "conv_id long, turn long, role string, text string, ids binary, chars string"
    frame = spark.createDataFrame([(*t, b"", "c") for t in turns], schema)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine)
        learned = "".join(x or "" for _, _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    pieces = chat.format_conversations(frame).where("conv_id = 4").orderBy("turn").collect()
    assert [p["start"] for p in pieces] == [sum(q["n_ids"] for q in pieces[:k]) for k in range(len(pieces))]
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


@pytest.mark.parametrize("compression", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("tile, order, predictor", [(0, "<", 1), (0, ">", 2), (16, "<", 2), (48, ">", 1)])
def test_tiff_round_trip(compression, tile, order, predictor):
    rng = random.Random(compression)
    for n in (64, 64 * 100, 64 * 777):
        data = bytes(rng.choice(b"aaab\0\xff") if k % 7 else rng.randrange(256) for k in range(n))
        file = media_tiff.encode_tiff(data, compression=compression, tile=tile, order=order, predictor=predictor, rows_per_page=300, rows_per_strip=37)
        pages = list(media_tiff.decode_tiff(file))
        assert b"".join(p.data for p in pages) == data
        assert [p.number for p in pages] == list(range(-(-n // 64 // 300)))
        assert all((p.compression, p.predictor, p.tiled) == (compression, predictor, bool(tile)) for p in pages)


def test_tiff_codecs_reach_full_tables():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(40_000))
    assert media_tiff.lzw_decode(media_tiff.lzw_encode(data), len(data)) == data
    assert media_tiff.unpack_bits(media_tiff.pack_bits(b"a" * 500 + data + b"b" * 129), 10**9) == b"a" * 500 + data + b"b" * 129


def test_tiff_columns(spark):
    docs = [*texts(), (None, "no id"), (4, "One")]
    media = media_tiff.text_media(spark.createDataFrame(rows(docs), SCHEMA)).selectExpr("*", "cast(length(media) as long) media_bytes", "sha2(media, 256) media_sha256")
    got = media_tiff.page_features(media_tiff.tiff_pages(media)).collect()
    assert len(got) == len(docs)
    seen = {}
    for r in got:
        text = next((t or "") for i, t in docs if i == r["doc_id"])
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    broken = spark.createDataFrame([(1, b"II*\0\xff\0\0\0"), (2, None), (3, b"")], "id long, media binary")
    assert [(r["page"], r["error"] is not None) for r in media_tiff.tiff_pages(broken).collect()] == [(-1, True)] * 3


PAGES = [
    (None, ""),
    ("", ""),
    ("plain <b>text</b>\n here", "plain text here"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x</li><li value=9>y</li><li>z</li></ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>", "Name       N\nlong name  1\nb          22"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b  c"),
    ("<script>x<p></script><style>p{}</style><p hidden>h</p><p style='color:red; display: none'>n</p><p>s", "s"),
    ("<title>t</title><body>&amp; &lt;p&gt; &copy;&nbsp;x", "& <p> © x"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>\n  x\n    y </pre>z", "  x\n    y\n\nz"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<!-- c --> a <!doctype html> b <![CDATA[ c ]]> d </x>", "a b d"),
    ("<p>un<i>closed <b>tags</p>after", "unclosed tags\n\nafter"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<img alt='pic'> <input type=submit value=Go><select><option>o</select>", "pic Go"),
    ("<div" + "><div" * 3000 + ">deep", "deep"),
]


@pytest.mark.parametrize("source, expected", PAGES, ids=range(len(PAGES)))
def test_layout(source, expected):
    assert html_layout.render(source) == expected


SHOWN = [
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> b", "a x= 1 2 b"),
    ("<svg><title>t</title><defs/><path d='M0'/>loose<text>one<tspan>!</tspan></text><text>two</text></svg> z", "one! two z"),
    ("<svg><path><p>after", "after"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<select><option>a<option selected>b</select>c", "b c"),
    ("<select multiple><optgroup label=g><option>a<option>b</select>", "g\na\nb"),
    ("<div style='visibility:hidden'>no<p>no<b style='visibility: visible'>yes</b></div>z", "yes\n\nz"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
    ("<table><tr style='visibility:hidden'><td>no<td><i style='visibility:visible'>yes</i></table>", "yes"),
    ("<div>" * 200 + "<svg>no<text>yes</text></svg><i style='visibility:hidden'>no<b style='visibility:visible'>also", "yes also"),
]


@pytest.mark.parametrize("source, expected", SHOWN, ids=range(len(SHOWN)))
def test_layout_shows_all_visible_text(source, expected):
    assert html_layout.render(source) == expected


def test_layout_never_fails():
    rng = random.Random(5)
    parts = ["<table>", "</table>", "<tr>", "<td>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "x", "&#0;", "<", ">", "<!--", "-->", "</div>", "<a href='", "'", '"', "<script>", "</script>", "<th rowspan=3>", "<dd>", "<br/>", "</br>", "<head>", "</head>", "<body>", "<html>", "<pre>"]
    for _ in range(2000):
        html_layout.render("".join(rng.choice(parts) for _ in range(rng.randrange(25))))


def test_layout_column(spark):
    frame = spark.createDataFrame([(i, h, "t") for i, (h, _) in enumerate(PAGES)] + [(None, "<p>x", "t"), (2, "again", "t")], "page_id long, html string, text string")
    got = html_layout.extract_text(frame).collect()
    assert len(got) == len(PAGES) + 2
    assert {(r["page_id"], r["text"]) for r in got} == {(i, t) for i, (_, t) in enumerate(PAGES)} | {(None, "x"), (2, "again")}
    assert html_layout.extract_text(frame.limit(0)).count() == 0


DEEP = {
    "div": "<div>" * 100_000 + "x", "text": "<div>t" * 100_000, "list": "<ul><li>" * 100_000 + "x", "list text": "<ol><li>t" * 50_000, "quote": "<blockquote>q" * 100_000,
    "table": "<table><tr><td>c" * 20_000, "inline": "<b>" * 100_000 + "x", "paragraph": "<p><table><td>" + "<div>" * 100_000 + "x", "body": "<table>" + "<tbody>" * 100_000 + "<tr><td>x",
    "terms": "<dl><dd>x" * 50_000, "options": "<select multiple>" + "<optgroup><option>x" * 20_000, "pre": "<pre>\n\nx" * 50_000,
}


@pytest.mark.parametrize("kind", DEEP)
def test_html_of_any_depth(kind):
    began = time.process_time()
    found = html_layout.render(DEEP[kind])
    assert time.process_time() - began < 10
    texts = re.sub("<[^>]*>", " ", DEEP[kind]).split()
    assert [x for x in found.split() if x == texts[0]] == texts


@pytest.mark.parametrize(
    "source, text",
    [
        ("<details><summary>s</summary>more</details>after", "s\nafter"),
        ("<details open><summary>s</summary>more</details>after", "s\nmore\nafter"),
        ("<ul><li>a<ul><li>b<blockquote>c<br>d</blockquote></ul><li><ol start=9><li>e<li>f</ol></ul>", "- a\n  - b\n\n      c\n      d\n- 9. e\n  10. f"),
        ("<ul><li></li><li>x</li></ul>", "-\n- x"),
        ("a<pre>\n\n  b\n c\n</pre>d", "a\n\n  b\n c\n\nd"),
        ("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table></table>", "a  b   c\n   dd  e"),
    ],
)
def test_html_layout_of_blocks(source, text):
    assert html_layout.render(source) == text


def tiff_file(fields, data=b"", order="<"):
    """A file of one directory, written by hand: fields of (tag, kind, values), 8 bytes of header, then ``data``."""
    code = {1: "B", 3: "H", 4: "I"}
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data) + len(data) % 2) + data + b"\0" * (len(data) % 2))
    entries, extra, place = b"", b"", len(out) + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        body = struct.pack(f"{order}{len(values)}{code[kind]}", *values)
        if len(body) > 4:
            extra, body = extra + body, struct.pack(order + "I", place + len(extra))
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return bytes(out + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + extra)


def test_tiff_codecs_on_foreign_bytes():
    # the example of the PackBits description, and LZW codes worked out by hand: clear, 65, 66, 258, 260, end in 9 bits
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media_tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 260, 257))
    coded = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media_tiff.lzw_decode(coded, 100) == b"ABABABA"


@pytest.mark.parametrize("order", "<>")
def test_tiff_of_few_bits_planes_and_reversed_bits(order):
    def page(fields, data):
        (found,) = media_tiff.decode_tiff(tiff_file(fields, data, order))
        return found.data

    size = [(256, 3, [3]), (257, 3, [2])]
    strip = lambda n: [(273, 4, [8]), (278, 3, [2]), (279, 4, [n])]
    assert page([*size, (258, 3, [1]), (259, 3, [1]), *strip(2)], b"\xa0\x40") == bytes([1, 0, 1, 0, 1, 0])
    assert page([*size, (259, 3, [1]), (266, 3, [2]), *strip(2)], b"\x05\x02") == bytes([1, 0, 1, 0, 1, 0])
    assert page([*size, (258, 3, [4]), (259, 3, [1]), *strip(4)], b"\x12\x30\x45\x60") == bytes([1, 2, 3, 4, 5, 6])
    assert page([*size, (258, 3, [2]), (259, 3, [32773]), *strip(3)], b"\x01\x1b\xe4") == bytes([0, 1, 2, 3, 2, 1])
    planes = [*size, (258, 3, [8, 8]), (259, 3, [1]), (273, 4, [8, 14]), (277, 3, [2]), (278, 3, [2]), (279, 4, [6, 6]), (284, 3, [2])]
    assert page(planes, bytes(range(12))) == bytes([0, 6, 1, 7, 2, 8, 3, 9, 4, 10, 5, 11])


BASE = {256: (3, [4]), 257: (3, [8]), 258: (3, [8]), 259: (3, [1]), 273: (4, [8, 12, 16, 20, 24, 28, 32, 36]), 278: (3, [1]), 279: (4, [4] * 8)}
BROKEN = {
    "few strips": {273: (4, [8]), 279: (4, [4])}, "many strips": {273: (4, [8] * 9), 279: (4, [4] * 9)}, "no counts": {279: None}, "no offsets": {273: None}, "width 0": {256: (3, [0])}, "length 0": {257: (3, [0])},
    "rows 0": {278: (3, [0])}, "huge": {256: (4, [1 << 31]), 257: (4, [1 << 31]), 278: (4, [1 << 31]), 273: (4, [8]), 279: (4, [32])}, "tile width 0": {322: (3, [0]), 323: (3, [16]), 324: (4, [8]), 325: (4, [32])},
    "no tile counts": {322: (3, [16]), 323: (3, [16]), 324: (4, [8])}, "huge tile": {322: (4, [1 << 30]), 323: (4, [1 << 30]), 324: (4, [8]), 325: (4, [32])}, "bits 5": {258: (3, [5])}, "no samples": {277: (3, [0])},
    "offset outside": {273: (4, [8] * 7 + [1 << 31])}, "scheme": {259: (3, [7])}, "LZW": {259: (3, [5])}, "deflate": {259: (3, [8])}, "predictor": {317: (3, [3])}, "uneven bits": {258: (3, [8, 16])},
}


def test_broken_tiff_files_give_errors(spark):
    """Every file has its rows: pages, or an error."""
    files = [(0, tiff_file([(t, *v) for t, v in BASE.items()], bytes(range(32)))), (1, None), (2, b""), (3, b"II*\0")]
    for k, (_, change) in enumerate(BROKEN.items(), 10):
        fields = sorted((t, *v) for t, v in (BASE | change).items() if v)
        files.append((k, tiff_file(fields, bytes(range(32)))))
    rng = random.Random(9)
    whole = media_tiff.encode_tiff(bytes(rng.randrange(256) for _ in range(6400)), compression=5, rows_per_page=50)
    for k in range(100, 300):
        broken = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        files.append((k, bytes(broken[: rng.randrange(len(broken))] if k % 3 == 0 else broken)))
    got = {}
    for r in media_tiff.tiff_pages(spark.createDataFrame(files, "k int, media binary")).collect():
        got.setdefault(r["k"], []).append(r)
    assert set(got) == {k for k, _ in files}
    assert [(r["data"], r["error"]) for r in got[0]] == [(bytes(range(32)), None)]
    assert all(got[k][-1]["error"] and got[k][-1]["page"] == -1 for k in [1, 2, 3, *range(10, 10 + len(BROKEN))])


def test_tables_stay_in_proportion():
    """Long cells, many columns and large spans: output and time grow with the page; ordinary tables are aligned."""
    import time

    from effectql.llm.html_layout import render

    def cell(rows, long):
        return "<table><tr><td>" + "x" * long + "</td><td>y</td></tr>" + "<tr><td>a</td><td>b</td></tr>" * rows + "</table>"

    for page in (cell(2000, 44_000), cell(16_000, 500_000), "<table><tr>" + "<td>some words</td>" * 3000 + "</tr>" + "<tr><td colspan=2999><td>z</tr>" * 3000 + "</table>"):
        began = time.perf_counter()
        assert len(render(page)) < 40 * len(page)
        assert time.perf_counter() - began < 5
    nested = "<table><tr><td>" * 20 + cell(200, 4000) + "</table>" * 20
    assert len(render(nested)) < 40 * len(nested)
    for spans in ("rowspan=1000 colspan=1000", "rowspan=1000", "colspan=1000", "rowspan=7 colspan=3"):
        for row in (1, 30, 1000):
            page = "<table>" + ("<tr>" + f"<td {spans}>q" * row) * (1_000_000 // (row * (6 + len(spans)) + 4)) + "</table>"
            began = time.perf_counter()
            assert len(render(page)) < 40 * len(page)
            assert time.perf_counter() - began < 15
    assert render("<table><tr><td>name<td>n<tr><td>a long name<td>12</table>") == "name         n\na long name  12"
    assert render("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>").split("\n") == ["a  b  c", "   d  e", "f  g  h"]
    assert render("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<tr><td>g<td>h<td>i</table>").split("\n") == ["a  b  c", "d     e", "f", "g  h  i"]
