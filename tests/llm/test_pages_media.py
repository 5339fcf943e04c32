"""Page text, page language and audio columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from ranklake.llm import html_text, langid, media


@pytest.fixture(scope="module")
def model():
    return tuple(np.array(x) for x in html_text.trained())


def test_held_out_pages(model):
    pages = html_text.training_pages(150, seed=99)
    right = sum(html_text.main_text(p, *model) == "\n".join(" ".join(k.split()) for k in kept) for p, kept in pages)
    assert right / len(pages) > 0.9


def test_article_without_furniture(model):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp; more</h1><p><b>Bold text\n here.<br><p>Second &#233; part.</article><footer>&copy; x</footer>'
    assert html_text.main_text(page, *model) == "Head & more\nBold text here.\nSecond é part."


@pytest.mark.parametrize("page", [None, "", "<", "<!-- open", "<script>never closed", "<p>" * 3000, "</div>" * 50, "<a href='x>y"])
def test_odd_pages(model, page):
    assert isinstance(html_text.main_text(page, *model), str)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>T</title><body><article><p>One.</p></article>", ["One."]),
        ("<head><meta name=a><title>T</title><style>p{}</style><p>One.<p>Two.", ["One.", "Two."]),
        ("<head><title>T</title>One <b>two</b>.<p>Three.", ["One two.", "Three."]),
        ("<head><title>T</title>One.", ["One."]),
        ("<head><noscript><div>no</div></noscript><title>T</title></head><p>One.", ["One."]),
        ("<head><script>'<body>'</script><title>T</title></head><p>One.", ["One."]),
        ("<p>One.</p><svg width=1 /><p>Two.</p>", ["One.", "Two."]),
        ("<svg><svg><text>a</text></svg><text>b</text></svg><p>One.</p>", ["One."]),
        ("<p>One.</p><button>Go<p>Two.</p><button>Menu</button><p>Three.</p>", ["One.", "Go", "Two.", "Three."]),
        ("<p>One.</p><select><option>a</select><select><p>Two.</p>", ["One.", "Two."]),
        ("<iframe src=x><p>One.</p>", ["One."]),
        ("<button><script>'<button>'</script>x</button><p>One.", ["One."]),
        ("<p>One.</p><script><p>Two.</p>", ["One."]),
    ],
)
def test_skipped_elements_end(page, texts):
    assert [x for x in html_text.parse(page).text if x is not None] == texts


def test_page_with_open_head(model):
    page = "<html><head><title>T</title>{}<body><nav><a href='/a'>a</a></nav><article><h1>Head</h1><p>Some words, here.</p><p>Second part.</p></article>"
    assert html_text.main_text(page.format(""), *model) == html_text.main_text(page.format("</head>"), *model) == "Head\nSome words, here.\nSecond part."
    import time

    start = time.time()
    html_text.parse("<head><button><svg><object>x" * 40_000)
    assert time.time() - start < 20


@pytest.mark.parametrize("page", ["<a " * 100_000, "<button " * 100_000, "<p>x</p>" + "<" * 200_000, "<!--" * 100_000])
def test_unclosed_pages_take_linear_time(model, page):
    import time

    began = time.time()
    html_text.main_text(page, *model)
    assert time.time() - began < 20


def test_tail_without_a_tag(model):
    texts = lambda page: [x for x in html_text.parse(page).text if x is not None]
    assert texts("<p>One.</p>two <b") == ["One.", "two <b"]
    assert texts("<p>One.</p><script>a > b") == ["One."]
    assert texts("<p>One.</p><!-- a > b") == ["One."]
    assert texts("<p>One.</p>two<!-- c") == ["One.", "two"]


def test_messages_equal_enumeration(model):
    from itertools import product

    tree = html_text.parse("<div class=ad><p>x y z</p></div><article><p>Some words here.</p><p>More.</p></article>")
    n = len(tree.parent)
    node, pair = model
    weight = np.zeros(n)
    total = 0.0
    for y in product((0, 1), repeat=n):
        s = sum(y[i] * node[tree.features[i]].sum() for i in range(n))
        s += sum(pair[4 * (tree.text[i] is not None) + 2 * y[p] + y[i]] for i, p in enumerate(tree.parent) if p >= 0)
        total += np.exp(s)
        weight += np.exp(s) * np.array(y)
    assert 1 / (1 + np.exp(-np.array(html_text.marginals(tree, node, pair)))) == pytest.approx(weight / total)


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>Plain words, here.</p>", "y"), (2, None, "<p>Plain words, here.</p>", "y")], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert rows[0] == (1, "", 0) and len(rows) == 3 and rows[1] == rows[2]
    assert html_text.extract(df.limit(0)).count() == 0


def test_language_of_pages(spark, sf):
    rows = langid.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.95


def test_language_without_the_declaration(spark, sf):
    """Held-out accuracy where the truth is no input: the declaration is taken out of the pages."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    truth = {r.page_id: r.declared for r in langid._address(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", r"(?i)<html\b[^>]*>", "<html>")).withColumn("url", F.lit(None).cast("string"))
    got = {r.page_id: r for r in langid.identify(bare, langid.train(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert {r.declared for r in got.values()} == {""}
    known = [i for i, x in truth.items() if x]
    assert np.mean([got[i].lang == truth[i] for i in known]) > 0.9


@pytest.mark.parametrize(("page", "declared"), [("<!-- <html lang=xx> --><html lang=de>", "de"), ("<html xml:lang=fr data-lang=es lang='it'>", "it"), ("<html xml:lang=fr>", ""), ("<html LANG = \"pt-BR\">", "pt")])
def test_declaration(spark, page, declared):
    df = spark.createDataFrame([(1, "http://a.de/x", page)], "page_id long, url string, html string")
    assert langid._address(df).first().declared == declared


def test_three_hundred_languages_all_stay(spark):
    rows = [(i, f"wort{i} " * 20, f"l{i:03d}") for i in range(300)]
    languages, logs = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(languages) == 300 and logs.shape[0] == 300


def test_language_evidence(spark, sf):
    fitted = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    df = spark.createDataFrame([(1, None, None), (2, "http://a.de/x", ""), (3, "nonsense", "<html lang='xx'><p>the and of</p>")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in langid.identify(df, fitted).collect()}
    assert set(rows) == {1, 2, 3} and rows[2].suffix == "de" and rows[3].declared == "xx"
    assert all(0 < r.posterior <= 1 for r in rows.values())
    assert langid.identify(df.limit(0), fitted).count() == 0
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang for r in langid.identify(df, nothing).collect()] == [None] * 3


def test_declared_language_after_a_long_comment(spark, sf):
    fitted = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    page = "<!-- " + "licence " * 2000 + "-->\n" * 3 + "<!DOCTYPE html>" + " " * 5000 + "<HTML class=a lang='fr-CA'><p>le et la</p>"
    df = spark.createDataFrame([(1, "http://a.de/x", page), (2, "http://a.de/y", "<html>" + "x" * 9000 + "<html lang=de>")], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in langid.identify(df, fitted).collect()} == {1: "fr", 2: ""}


def test_wave_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        data = media.payload(bytes(range(256)) * (n // 256) + bytes(n % 256))
        assert len(data) % 576 == 0 and len(data) > 0
        assert media.from_wave(media.to_wave(data)) == (media.RATE, data)
    with pytest.raises(ValueError):
        media.from_wave(b"no")


def test_features_equal_plain_sums():
    """Log-mel frames and segments against loops over samples, filters and frames."""
    r = np.random.default_rng(3)
    data = bytes(r.integers(0, 256, 3 * 576).astype(np.uint8))
    x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    y = media.resample(x - x.mean())
    mel = media.log_mel(y)
    frames = max(1, -(-max(len(y) - media.FRAME, 0) // media.HOP) + 1)
    assert mel.shape == (frames, media.MELS)
    t = np.arange(media.FRAME)
    for f in (0, frames // 2, frames - 1):
        part = np.zeros(media.FRAME)
        own = y[f * media.HOP : f * media.HOP + media.FRAME]
        part[: len(own)] = own
        part = part * (0.5 - 0.5 * np.cos(2 * np.pi * t / media.FRAME))
        power = [abs(np.sum(part * np.exp(-2j * np.pi * k * t / media.FRAME))) ** 2 for k in range(media.FRAME // 2 + 1)]
        want = np.log10(np.maximum(np.array(power) @ media._mel(), 10.0**media.FLOOR))
        assert mel[f] == pytest.approx(want, abs=1e-6)
    for _ in range(50):
        e = r.normal(0, 0.2, 40)
        middle, state, want = np.median(e), False, []
        for i, v in enumerate(e):
            state = v >= middle + media.OPEN_DB / 10 or (state and v >= middle + media.CLOSE_DB / 10)
            want.append(state)
        got = np.zeros(40, bool)
        for a, b in media.segments(e):
            got[a:b] = True
        assert got.tolist() == want


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(4800) / 8000)
    y = media.resample(x)
    z = np.sin(2 * np.pi * 440 * np.arange(len(y)) / (8000 * 2 / 3))
    assert np.abs(y - z)[100:-100].max() < 1e-4


def test_hysteresis():
    e = np.array([0, 0, 0, 0.3, 0.05, 0.05, -0.3, 0, 0, 0.0])
    assert media.segments(e) == [(3, 6)]


def test_media_table(spark, docs, empty, corpus):
    rows = media.describe(docs)
    streams = {r.doc_id: bytes(r.media) for r in media.stored(docs).collect()}
    by_id = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate(corpus):
        raw = (t or "").encode()
        data = media.payload(raw)
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert r.media_bytes == len(streams[i]) and r.media_sha256 == hashlib.sha256(streams[i]).hexdigest()
        assert media.from_wave(streams[i]) == (media.RATE, data)
    assert by_id[3].feature == by_id[63].feature
    flat = media.fixed_shape(rows.toArrow())
    assert flat.schema.field("mel").type.shape == [media.MELS, media.PATCH]
    assert media.describe(empty).count() == 0


def test_query_builds_the_tensors(spark, sf):
    got = {r.doc_id: r for r in media.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5).collect()
    for d in docs:
        tensors = media.patches(*media.analysed(media.payload((d.text or "").encode())))
        whole = b"".join(np.array([t["start_s"], t["end_s"]], "<f8").tobytes() + np.array(t["mel"], "<f4").tobytes() for t in tensors)
        assert (got[d.doc_id].n_tensors, got[d.doc_id].tensors_sha256) == (len(tensors), hashlib.sha256(whole).hexdigest())
