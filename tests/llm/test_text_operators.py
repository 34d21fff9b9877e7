import time
import base64
import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from threadloom.llm import bpe, chat, html_text, q_text, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(2)
    return [
        *["", " ", "a", "a" * 3000, "é" * 400, "\U0001f600" * 200 + "x", "!" * 700, "\n" * 500 + "x", "a\x1c\x1d b\x85 c\xa0d　 e​", "0123456789" * 90],
        "".join(rng.choice("abcdeftioning") for _ in range(4000)),
        "".join(chr(rng.randrange(32, 0xD000)) for _ in range(1500)),
        "it's we'll THEY'RE don't\tx  y   z \r\n",
    ]


def test_bpe_equals_the_library(oracle):
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = odd_texts()
    ids = list(own.encode(texts))
    assert ids == [oracle.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in ids] == [t.encode() for t in texts]
    assert list(own.encode(texts)) == ids  # from what the worker remembers


def test_long_and_matrix_merges_agree():
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(60):
        raw = "".join(rng.choice("aeinrst'") for _ in range(rng.randrange(2, 200))).encode()
        width = 1 << (len(raw) - 1).bit_length()
        assert list(own._merge_matrix([raw], width)[0]) == own._merge_long(raw)


def test_bpe_over_frames(spark, oracle):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "x"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    ids = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back) == sorted((i or -1, (t or "").encode()) for i, t in rows)
    trip = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((i or -1, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for e in [oracle.encode_ordinary(t or "")])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trip) == want
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    evil = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<\\|", "<\\\\|im_sep|>", "<", "|", "<|im_sep|>", "\n", "", None, "a<", "|b", "\\\\n|"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(evil)]
    rows += [(2, 0, None, "x"), (2, None, "as\n<|im_end|>\nsistant", "y"), (3, 5, "user", "same"), (3, 5, "user", "same"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    for key in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[key].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert got[key].loss_text == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert got[3].formatted == "<|im_start|>user\nsame<|im_sep|>same<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_is_native(spark):
    plan = q_text.op1_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_records_and_reader(spark):
    rows = [(5, "http://a", "<p>x</p>"), (2, "http://b\nX: y", "<p>x</p>"), (7, None, None), (9, "é", ""), (None, "n", "<p>x</p>"), (2, "http://b\nX: y", "<p>x</p>"), (11, "long", "äöü" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.archive_round_trip(pages).collect())
    d = lambda s: warc.b32(s.encode())
    x = "<p>x</p>"
    assert got == [
        (-1, 8, d(x), "response", None, "n"),
        (2, 8, d(x), "response", None, "http://b\nX: y"),
        (2, 8, d(x), "response", None, "http://b\nX: y"),
        (5, 8, d(x), "revisit", 2, "http://a"),
        (7, 0, d(""), "response", None, None),
        (9, 0, d(""), "revisit", 7, "é"),
        (11, 1_200_000, d("äöü" * 200_000), "response", None, "long"),
    ]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_streams_members_and_finds_damage():
    import io

    raw = [warc.record(i, "u", b"p" * i, warc.b32(b"p" * i), None) for i in range(50)]
    stream = b"".join(map(warc._gzip, raw))
    for size in (1, 7, 1 << 20):
        assert list(warc.members(io.BytesIO(stream), size)) == raw
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(stream[:-3]), 64))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw[9].replace(b"ppp", b"qqq"))
    with pytest.raises(ValueError, match="framing"):
        warc.parse(raw[9][:-2])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <article>no</article> -->
<div class="cookie-notice">cookies</div><article><h1>Head &amp; line</h1><p><b>One<br><p>Two   <a href="/x>y">link</a>.</p>
<aside>side</aside><p>Three &lt;tag&gt; &am &#233;</p><div class="ad">Buy</div><form><p>sub</p></form></article>
<section id="comments"><p>Reader says</p></section><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE, "Head & line One Two link. Three <tag> &am é"),
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<div><p>a</p><p>b</p></div><footer>c</footer>", "a b"),
        ('<nav>never closed <article><p>a', "a"),
        ("<article>" + "<p>" + "word " * 50_000 + "</p></article>", " ".join(["word"] * 50_000)),
        ("<p>a<script>if (1 < 2) {}</SCRIPT>b</p>", "ab"),
        ("<ul><li><a href=x>only</a></li><li><a>links</a></li></ul><footer>f</footer><p>Body text here</p>", "Body text here"),
        ("<article><header><h1>H</h1></header><p>a</p></article>", "H a"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = " ".join(["Sentences of the article say what happened."] * 12)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><div class="article-header"><h1>H</h1></div><h2 class="section-header">S</h2><p>{0}</p></article>', "H S {0}"),
        ('<article><p>{0}</p><section id="discussion"><p>{0}</p></section><section id="related-work"><p>{0}</p></section></article>', "{0} {0} {0}"),
        ('<article><div class="side-effects"><p>{0}</p></div><p class="notice">{0}</p></article>', "{0} {0}"),
        ('<body><div class="layout has-sidebar"><p>{0}</p></div></body>', "{0}"),
        ('<div class="no-sidebar"><p>{0}</p><div class="sidebar">Buy</div></div>', "{0}"),
        ('<div class="sidebar"><p>{0}</p></div>', "{0}"),
        ('<div class="menu"><div class="menu">x</div><p class="notice">y</div><div class="t"><p>{0}</p></div>', "{0}"),
        ('<article><p>{0}</p></article><section id="comments"><article><p>{0} no</p></article></section>', "{0}"),
        ('<article><p>{0}</p></article><article class="comment"><p>no</p></article><aside><article><p>no</p></article></aside>', "{0}"),
    ],
)
def test_names_are_hints(page, want):
    assert html_text.main_text(page.format(LONG)) == want.format(LONG)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="x1">Buy now</div><div class="t"><h1>H</h1><p>{0}</p><p>Yes.</p><p>{0}</p></div><div class="x2">Note this</div><div class="x3">2020 Some Ltd</div>', "H {0} Yes. {0}"),
        ('<div class="h"><h1>H</h1></div><div class="p">{0}</div><div class="q7">Best price today</div><div class="p">Short.</div><div class="p">{0}</div>', "H {0} Short. {0}"),
    ],
)
def test_sums_choose_the_text(page, want):
    assert html_text.main_text(page.format(LONG)) == want.format(LONG)


def test_main_text_over_frames(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_main_text(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_articles_of_the_tables_are_whole():
    import html
    import re

    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", re.search("<article>(.*?)</article>", page, re.S)[1])]
        assert html_text.main_text(page) == " ".join(b for b in blocks if b)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>One<p class="note alert">Two<p>Three<p>Four</article>', "One Two Three Four"),
        ('<ul><li class="comment">one<li class="comment">two<li>three</ul><p>This is the long paragraph of the page that stays.', "three This is the long paragraph of the page that stays."),
        ('<p class="comments">x<p>This is the long paragraph of the page that stays.<div>And more of the same main text</div>', "This is the long paragraph of the page that stays. And more of the same main text"),
        ('<p>Some text of a page long enough to stay</p><a "b', 'Some text of a page long enough to stay <a "b'),
        ('<p>Some text of a page long enough to stay</p><p class="x>y</p>', "Some text of a page long enough to stay y"),
    ],
)
def test_unclosed_tags(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("piece", ['<a "', '<li class="comments">', "<nav><article>", '<div class="menu">', "<!--", '<p class="notice">x</p></i>', "<a '\"><b \"'>"])
def test_extraction_is_linear(piece):
    begin = time.perf_counter()
    html_text.main_text(piece * (250_000 // len(piece)))
    assert time.perf_counter() - begin < 5
