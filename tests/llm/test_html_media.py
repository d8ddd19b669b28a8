import hashlib
import html
import io
import random
import re
import tarfile
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from scholarlens.llm.html_text import STARTER, Chain, blocks, extracted, features, lessons, main_text, marked, train
from scholarlens.llm.media import Shard, from_png, media_columns, payload_of, png_head, to_png


def article(page):
    """The marked article by plain string work: all that the given pages need."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_all_pages_against_their_marked_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    expect = {r.page_id: article(r.html) for r in pages.collect()}
    got = extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == expect
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_edge_cases(spark):
    body = "<article><p>One &amp; two&nbsp;three.<br>Four</p>\n<p>caf&eacute; <b>bo</b>ld.</article>"
    rows = [Row(n_chars="x", html=h, url=u, page_id=i) for i, u, h in (
        (1, "u", None), (2, None, ""), (None, "u", f"<nav><a href=x>Home</a></nav>{body}<footer>All rights</footer>"), (3, "u", "<p"), (3, "u", "<script>x</p>"),
        (4, "u", "<article>" + "<p>A long and calm sentence stands here.</p>" * 5000 + "</article>"),
    )]
    frame = spark.createDataFrame(rows, "n_chars string, html string, url string, page_id long")
    got = {(r.page_id, r.url): r.text for r in extracted(frame, train([])).collect()}
    assert got[1, "u"] == "" and got[2, None] == "" and len(got) == 5
    assert got[None, "u"] == "One & two three. Four café bold."
    assert len(got[4, "u"]) == 5000 * 37 + 4999
    assert extracted(frame.limit(0)).collect() == []


def test_other_layouts_without_article_tags():
    chain = train(STARTER)
    text = "The old bridge was rebuilt in stone after the flood, and the town paid for it with a toll."
    page = (
        f"<body><div class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></div><div class='ad'>{text}</div>"
        f"<div class='content'><h1>The old bridge</h1><p>{text}</p><p>{text}</p></div>"
        f"<div id='comments'><div class='comment'>{text}</div></div><form><label>Your name</label></form><div id='footer'>All rights reserved</div></body>"
    )
    assert main_text(chain, page) == f"The old bridge {text} {text}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap!-\"'= &;scritydv1\n", max_size=80))
def test_any_markup_is_read(page):
    assert all(b.text and b.text == " ".join(b.text.split()) for b in blocks(page))


@pytest.mark.parametrize("piece", ["<b ", "<div>", "<div>x", "<b '>'", "<a href='", "<!", "<p>x", "<li><p>x", "<script>", "<i><b></i>", "<div><b></i>", "<!--"])
def test_odd_markup_takes_linear_time(piece):
    """From 16 KB to 256 KB the time grows about 16 times, and not 256."""

    def seconds(size):
        page = piece * (size // len(piece))
        began = time.process_time()
        blocks(page)
        return time.process_time() - began

    small = min(seconds(16_000) for _ in range(3))
    assert seconds(256_000) < 60 * small + 0.2


def test_pages_without_article_tags(spark, sf_dir):
    """Where the pages' article and main tags become plain divisions, 95 % of their blocks are still told apart."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    chain = train(pages[::2])
    right = total = 0
    for page in pages[1::2]:
        wanted = marked(blocks(page))
        plain = blocks(re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page))
        got = chain.viterbi(chain.scores(chain.rows(features(plain))))
        right += int((np.array(got) == wanted).sum())
        total += len(wanted)
    assert right >= 0.95 * total


def test_viterbi_equals_enumeration():
    rng = random.Random(4)
    chain = Chain({"a": 0})
    for _ in range(30):
        n = rng.randint(1, 7)
        scores = np.array([[rng.uniform(-2, 2), rng.uniform(-2, 2)] for _ in range(n)])
        chain.step = np.array([[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])

        def total(labels, scores=scores):
            return sum(scores[k][y] for k, y in enumerate(labels)) + sum(chain.step[a][b] for a, b in zip(labels, labels[1:]))

        every = [[(m >> k) & 1 for k in range(n)] for m in range(2**n)]
        assert np.isclose(total(chain.viterbi(scores)), max(map(total, every)))
        nodes, _ = chain.marginals(scores)
        weights = np.exp([total(y) for y in every])
        assert np.allclose(nodes[:, 1], [sum(w for w, y in zip(weights, every) if y[k]) / weights.sum() for k in range(n)])


def test_lessons_line_up_with_their_labels():
    made = lessons(STARTER)
    assert len(made) == 2 * len(STARTER) and all(len(f) == len(y) and set(y.tolist()) == {0, 1} for f, y in made)
    assert len(features(blocks("<p>x</p>"))) == 1


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=500))
def test_images_are_lossless(text):
    payload = payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.rstrip(b"\0") == text.rstrip(b"\0")
    image = to_png(payload)
    assert from_png(image) == payload and png_head(image[:33])["height"] == len(payload) // 64


def test_shards_are_tar_files_with_one_member_for_a_digest(tmp_path):
    shard = Shard(str(tmp_path))
    places = [shard.add(d, b) for d, b in (("a" * 64, b"xyz"), ("b" * 64, b"q" * 1000), ("a" * 64, b"xyz"))]
    shard.close()
    raw = next(tmp_path.iterdir()).read_bytes()
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        assert {m.name: tar.extractfile(m).read() for m in tar} == {"a" * 64 + ".png": b"xyz", "b" * 64 + ".png": b"q" * 1000}
    assert places[0] == places[2] and raw[places[1][0] : places[1][0] + 1000] == b"q" * 1000


def test_media_columns_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "x" * 200_000), (-2, "x" * 200_000)], "doc_id long, text string")
    texts = [(r.doc_id, r.text) for r in docs.unionByName(extra).collect()]
    rows = media_columns(docs.unionByName(extra).selectExpr("*", "1 AS shard", "2 AS feature"), str(tmp_path)).collect()
    assert len(rows) == len(texts)
    expect = sorted((str(i), len(p := payload_of((t or "").encode())), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in texts)
    assert sorted((str(r.doc_id), r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == expect
    stored = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    for r in rows:
        data = stored[r.shard][r.offset : r.offset + r.media_bytes]
        assert hashlib.sha256(data).hexdigest() == r.media_sha256 and hashlib.sha256(from_png(data)).hexdigest() == r.payload_sha256
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.shard, r.offset))
    assert all(len(v) == 1 for v in by_text.values())
    assert media_columns(docs.limit(0), str(tmp_path / "none")).collect() == []


def test_only_scripts_and_the_like_are_dropped():
    page = ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><svg><text>A label</text></svg><object>Fallback</object><noscript>No script</noscript>"
            "<xmp>Plain</xmp><script>var a</script><style>b {}</style><p>The <svg>end</p>")  # fmt: skip
    text = " ".join(b.text for b in blocks(page))
    assert text == "Let x=2 hold. A label Fallback No script Plain The end"
    for tag in ("svg", "object", "math", "script", "template"):
        assert [b.text for b in blocks(f"<p>Before</p><{tag}><p>After</p>")] == ["Before", "After"]
    assert [b.text for b in blocks("<script>" * 100_000 + "<p>x</p>")] == ["x"]
