"""Operators on small rows with answers worked out by hand."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklake.functions import arrays as A
from ranklake.functions import measures as M
from ranklake.functions import texts as T
from ranklake.functions import urls as U
from ranklake.operators import causal as C
from ranklake.operators import html_features as H
from ranklake.operators import labels as L
from ranklake.operators import latent as La
from ranklake.operators import ranks as R
from ranklake.operators import relational as Rel
from ranklake.operators import retrieval as Ret
from ranklake.operators import sampling as S
from ranklake.plans import registry
from tests.oracles import rows_of_spark, rows_of_sql


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_domains(spark):
    url = F.lit("https://www.Shop.Example.com:8080/a")
    r = one(spark, d=U.domain_of(url), keep=U.domain_of(F.lit("not a url")), s=U.stripped_host(F.lit("web.com/x")), h=U.link_host(F.lit("mailto:x")), uk=U.link_suffix(F.lit("x.ac.uk")))
    assert (r.d, r.keep, r.s, r.h, r.uk) == ("Shop.Example.com:8080", "not a url", "eb.com", None, "ac.uk")


def test_rank_biased_overlap(spark):
    a, b = F.array(*map(F.lit, "abcde")), F.array(*map(F.lit, "edcba"))
    r = one(spark, same=A.rbo(a, a, 5), apart=A.rbo(a, F.array(*map(F.lit, "vwxyz")), 5), turned=A.rbo(a, b, 5), archived=A.rbo_archived(a, a, 5))
    assert r.same == pytest.approx(1.0)
    assert r.apart == 0.0
    assert r.archived == 0.0
    assert 0 < r.turned < 1


def test_list_measures(spark):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))
    empty = F.array().cast("array<int>")
    r = one(spark, j=A.jaccard(a, b), none=A.jaccard(empty, empty), o=A.overlap_at(a, b, 4), p=A.position(a, F.lit(2)), no=A.position(a, F.lit(9)))
    assert (r.j, r.none, r.o, r.p, r.no) == (pytest.approx(1 / 3), 0.0, 0.25, 1, None)


def test_zero_vectors(spark):
    z = F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, c=A.cosine(z, z), u=A.unit(z))
    assert (r.c, r.u) == (0.0, [0.0, 0.0])
    with pytest.raises(Exception, match="direction"):
        one(spark, u=A.strict_unit(z))


def test_dates_and_stars(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    r = one(spark, d=M.parse_date(F.lit("March 5, 2023")), none=M.parse_date(F.lit("soon")), old=M.age_bucket(F.lit(None).cast("timestamp"), now), future=M.age_bucket(F.lit("2025-01-01").cast("timestamp"), now), s=M.stars(F.lit(0.02)), t=M.stars(F.lit(0.02), "strict"))
    assert (str(r.d), r.none, r.old, r.future, r.s, r.t) == ("2023-03-05 00:00:00", None, 0, 4, "**", "*")


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(M.safe_corr(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_text_rules(spark):
    r = one(spark, blank=T.rejection_reason(F.lit(" \n")), short=T.rejection_reason(F.lit("hi there")), link=T.rejection_reason(F.lit("see https://x.org for more of it")), fine=T.rejection_reason(F.lit("what is the best way home")), foreign=T.rejection_reason(F.lit("это очень длинный вопрос a b c")))
    assert (r.blank, r.short, r.link, r.fine, r.foreign) == ("empty", "too-short", "external-identifier", None, "non-english")
    d = one(spark, n=T.stats_density(F.lit("1,234 and 50% in 2020 cost $10")), none=T.stats_density(F.lit(" ")), has=T.has_stats(F.lit("no numbers")))
    assert d.n > 0 and d.none is None and d.has is False


def test_ranker_answers(spark):
    answer = "<think>\n1. x.com\n</think>\n1. `A.com`\n- b.org\n\n* c.net"
    r = one(spark, lines=T.ranked_lines(F.lit(answer)), ok=T.permutation(F.lit("C002,C001"), F.lit(2)), twice=T.permutation(F.lit("C001 C001"), F.lit(2)), strange=T.permutation(F.lit("C001 C003"), F.lit(2)))
    assert r.lines == ["a.com", "b.org", "c.net"]
    assert (r.ok, r.twice, r.strange) == (["C002", "C001"], None, None)


def test_rank_changes_of_new_items_are_null(spark):
    before = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "k string, d string, rank int")
    after = spark.createDataFrame([("k", "c", 1), ("k", "b", 2), ("k", "a", 3)], "k string, d string, rank int")
    got = {r.d: (r.pre_rank, r.post_rank, r.rank_delta) for r in R.rank_changes(before, after, ["k"], "d").collect()}
    assert got == {"c": (None, 1, None), "b": (2, 2, 0), "a": (1, 3, -2)}


def test_fallback_join_takes_last_exact_and_first_loose(spark):
    right = spark.createDataFrame([("k", "u", "d", 1, 10), ("k", "u", "d", 2, 20), ("k", "w", "d", 0, 30)], "k string, url string, d string, seq int, v int")
    left = spark.createDataFrame([("k", "u", "d"), ("k", "x", "d"), ("q", "u", "e")], "k string, url string, d string")
    got = {(r.k, r.url): (r.v, r.how) for r in Rel.fallback_join(left, right, ["k", "url"], ["k", "d"], ["v"], "seq").collect()}
    assert got == {("k", "u"): (20, "exact"), ("k", "x"): (30, "loose"), ("q", "u"): (None, "none")}


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "x double, n int")
    assert Rel.nan_to_null(df).first().x is None


def test_selections():
    assert S.increasing_selection([5.0, 1.0, 3.0, 3.0], [1.0, 3.1]) == [1, 2]
    assert S.assignment([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]
    levels = S.jittered_levels(6, 1)
    assert levels[0] == 0 and levels[-1] == 1 and levels == sorted(levels)
    with pytest.raises(ValueError):
        S.increasing_selection([1.0, 1.0], [1.0, 2.0])


def test_assignment_is_cheapest():
    from itertools import permutations

    r = np.random.default_rng(3)
    for _ in range(30):
        c = r.integers(0, 20, (4, 6)).tolist()
        got = S.assignment(c)
        best = min(sum(c[i][p[i]] for i in range(4)) for p in permutations(range(6), 4))
        assert sum(c[i][j] for i, j in enumerate(got)) == best


def test_chunks():
    assert Ret.chunk_text(None) == [] and Ret.chunk_text("short") == ["short"]
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    chunks = Ret.chunk_text(text)
    assert all(100 <= len(c) <= 1001 for c in chunks)
    assert chunks[1].startswith(chunks[0][-200:])


def test_page_features():
    page = """<html><head><title>T</title><script type="application/ld+json">{"@graph":[{"@type":["FAQPage"]}]}</script></head>
    <body><nav>menu</nav><h2>How so?</h2><p>Body text<p>more <a href="/in">in</a> <a href="https://mit.edu/x">out</a><img alt="a"><img>
    <time datetime="2024-01-02">x</time></body></html>"""
    f = H.features(page, "https://www.example.com/")
    assert f["error"] is None and f["title"] == "T" and f["structured"] and f["question_heading"]
    assert (f["internal_links"], f["outbound_links"], f["authority_links"], f["n_images"], f["images_alt"]) == (1, 1, 1, 2, 1)
    assert "menu" not in f["body_text"] and f["dates"] == ["2024-01-02"] and f["digest"] == "How so? Body text more in out x"
    assert H.features(None, None)["n_links"] == 0


def test_ols_matches_numpy(spark):
    r = np.random.default_rng(0)
    x, z = r.normal(size=300), r.normal(size=300)
    y = 2 * x - z + r.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y, strict=True)], "x double, z double, y double")
    design = np.column_stack([x, z, np.ones(300)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    inv = np.linalg.inv(design.T @ design)
    got = C.ols(df, "y", "x", ["z"])
    assert got["coef"] == pytest.approx(beta[0]) and got["se"] == pytest.approx(math.sqrt(inv[0, 0] * (e @ e) / 297))
    h = np.einsum("ij,jk,ik->i", design, inv, design)
    hc3 = inv @ (design.T * (e / (1 - h)) ** 2) @ design @ inv
    assert C.ols(df, "y", "x", ["z"], "hc3")["se"] == pytest.approx(math.sqrt(hc3[0, 0]))


def test_plr_finds_the_effect(spark):
    r = np.random.default_rng(1)
    z = r.normal(size=2000)
    d = z + r.normal(size=2000)
    y = 0.5 * d + z + r.normal(size=2000)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(z, d, y, strict=True))], "k long, z double, d double, y double")
    fit = C.plr(df, "k", "y", "d", ["z"])
    assert abs(fit["coef"] - 0.5) < 4 * fit["se"] < 0.2
    assert C.plr(df.limit(50), "k", "y", "d", ["z"])["error"] == "too few rows"


def test_student_tail():
    assert C.student_tail(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    assert C.student_tail(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_sensitivity_value_removes_the_effect():
    s = C.sensitivity(0.5, 0.1, 1000, 0.2, 0.3, 1.0, 1.0)
    zero = C.sensitivity(0.5, 0.1, 1000, 0.2, 0.3, 1.0, 1.0, s["rv"], s["rv"])
    assert zero["lower"] == pytest.approx(0, abs=1e-9)


def test_judgments(spark):
    good = '{"answer_type":"rating","overall_readiness_0_100":50,' + ",".join(f'"{s}":4' for s in L.SCALES) + ',"category":"mixed","ambiguity_1_7":2,"confidence_0_1":0.4,"brief_reason":"ok then"}'
    df = spark.createDataFrame([(good,), ("nothing",), (good.replace('"ok then"', '""'),), (good.replace(':50', ':101'),), (good[:-1] + ',"x":1}',)], "raw string")
    got = [r.problems for r in L.judgments(df, "raw").collect()]
    assert got == [[], ["no-object"], ["reason-length"], ["readiness-range"], ["wrong-keys"]]


def test_bradley_terry_orders_items(spark):
    rows = [("s", "a", "b", 1.0)] * 8 + [("s", "b", "c", 1.0)] * 8 + [("s", "a", "c", 1.0)] * 8 + [("s", "b", "a", 1.0)]
    out = {r.item: r.strength for r in La.bradley_terry(spark.createDataFrame(rows, "s string, l string, r string, w double"), ["s"], "l", "r", "w").collect()}
    assert out["a"] > out["b"] > out["c"] and sum(out.values()) == pytest.approx(0, abs=1e-9)


def test_newton_step_without_a_matrix(monkeypatch):
    r = np.random.default_rng(3)
    i, j, v, g = r.integers(0, 90, 800), r.integers(0, 90, 800), r.random(800), r.normal(size=90)
    dense = La._step(i, j, v, g, 0.1)
    monkeypatch.setattr(La, "DENSE", 10)
    assert La._step(i, j, v, g, 0.1) == pytest.approx(dense, abs=1e-8)


def test_ordinal_fit_recovers_direction():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 2))
    y = np.digitize(2 * x[:, 0] + r.logistic(size=400), [-1, 1])
    w, cuts = La.ordinal_fit(x, y)
    assert w[0] > 1 and abs(w[1]) < 0.5 and cuts[0] < cuts[1]


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {(q.query, q.place): q["item"] for q in Ret.nearest(df.where("id % 20 = 0"), df, "id", "v", 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-(u @ u[q]))[:3].tolist()


@pytest.mark.parametrize("block", [5, 8192])
def test_retrieve_by_blocks_equals_all_pairs(spark, block):
    """Copies, equal scores, vectors without a score, of other lengths, not a number or next to zero, keys without chunks or
    null: the same passages as a score for each pair, but no pair is a row of the plan."""
    r = np.random.default_rng(14)
    base = r.normal(size=(12, 4)).tolist()
    odd = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [2.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [1e-162, 2e-162, -1e-162, 1e-162], [1e160] * 4, [float("inf"), 1.0, 0.0, 0.0], [1e-200] * 4]
    draw = lambda: odd[int(r.integers(len(odd)))] if r.random() < 0.25 else [v * float(r.choice([1, 1, 1, 2, -1])) for v in base[int(r.integers(12))]]
    chunks = [(key, f"t{i}", i if i % 9 else None, draw()) for i, key in enumerate(r.choice(["a", "b", "c"], 240).tolist())]
    chunks = [*((k, t, o, v) for k, t, o, v in chunks if o is not None), ("a", "first", None, base[0]), (None, "lost", 1000, base[0])]
    asked = [(i, key, draw()) for i, key in enumerate(r.choice(["a", "b", "none"], 60).tolist())] + [(100, None, base[0])] + [(200 + i, "c", v) for i, v in enumerate(odd)]
    chunks = spark.createDataFrame(chunks, "key string, text string, place long, v array<double>")
    asked = spark.createDataFrame(asked, "id long, key string, q array<double>")
    got = Ret.retrieve(asked, chunks, ["key"], "q", "v", "text", "place", block=block)
    pairs = asked.join(chunks, "key").withColumn("s", A.cosine(F.col("q"), F.col("v")))
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "place"))).where("n <= 3")
    want: dict = {x.id: [] for x in asked.collect()}
    for x in best.orderBy("id", "n").collect():
        want[x.id].append(x.text)
    assert {x.id: x.passage for x in got.collect()} == {i: " --- ".join(t) for i, t in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_many_equal_vectors_are_scored_once_and_in_order():
    import pyarrow as pa

    x = np.random.default_rng(15).normal(size=(30, 16))
    items = pa.chunked_array([pa.array(np.repeat(x, 2000, axis=0).tolist())])
    which, item, score = Ret._closest(pa.chunked_array([pa.array(x.tolist())]), items, 3)
    assert which.tolist() == np.repeat(np.arange(30), 3).tolist()
    assert item.tolist() == (2000 * np.repeat(np.arange(30), 3) + np.tile(np.arange(3), 30)).tolist() and score == pytest.approx(np.ones(90))


@pytest.mark.parametrize("seed", range(6))
def test_chunks_hold_the_whole_text_in_order(seed):
    """Each chunk goes on where the last one ended, but for the carried overlap; nothing but a short tail is lost."""
    import random

    r = random.Random(seed)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 900))]
    text = "".join(w + r.choice([" ", " ", ". ", "! ", "\n\n"]) for w in words)
    chunks = Ret.chunk_text(text, 120, 30, 20)
    plain = lambda t: " ".join(t.split())
    held = chunks[0]
    for c in chunks[1:]:
        carry = held[-30:]
        assert c.startswith(carry) and len(c) <= 120 + 31
        held += c[len(carry) :]
    whole = plain(text)
    assert whole.startswith(plain(held)) and len(whole) - len(plain(held)) <= 30 + 20


def test_recovered_json():
    from ranklake.functions.answers import load_json

    assert load_json(' {"a": [1]} ') == {"a": [1]} and load_json("x {no} {\"b\": 2} y") == {"b": 2}
    assert load_json('{"prompt_templates": ["a]", {"b \\"q\\""}], ') == {"prompt_templates": ["a]", 'b "q"']}
    for bad in (None, "", "none", '{"prompt_templates": [', '{"prompt_templates": []'):
        with pytest.raises(ValueError):
            load_json(bad)


def test_fixed_values_of_page_features():
    from datetime import UTC, datetime

    now = datetime(2024, 1, 1, tzinfo=UTC)
    f = lambda page, **k: H.features(page, "https://www.shop.example/x", now, **k)
    assert [f(f"<time datetime='{d}'></time>")["freshness"] for d in ("2023-12-01", "2023-03-01", "2022-03-01", "2020-01-01T10:00:00Z", "2015-01-01", "2025-01-01", "soon")] == [4, 3, 2, 1, 0, 4, 0]
    assert [f(f"<body><p>{t}</p>")["freshness"] for t in ("on 2023-12-01", "2014-05-05 then 2022/03/01", "March 5, 2022 x", "5 March 2022", "nothing")] == [4, 2, 2, 2, 0]
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    assert [f(ld(x))["structured"] for x in ('{"@type": "QAPage"}', '[{"@graph": {"@type": ["X", "Recipe"]}}]', '{"a": {"@type": "Recipe"}}', '{"@type": "Person"}', "{")] == [True, True, False, False, False]
    assert f(ld('{"@type": "Recipe"}'), legacy=True)["structured"] is False and f("<h2>Ready?</h2>", legacy=True)["question_heading"] is False
    links = "<a href='https://mit.edu/'>1</a><a href='https://mit.edu/'>2</a><a href='https://a.gov.uk'>3</a><a href='https://x.arxiv.org'>4</a><a href='https://shop.example/y'>5</a><a href='https://x.com/z'>6</a>"
    got = f(links)
    assert (got["authority_links"], got["external_citation"], got["outbound_links"], got["internal_links"]) == (3, True, 5, 1)
    assert f("<a href='https://x.com/z'>6</a>")["external_citation"] is False


def test_references_without_a_semicolon_stay_where_asked():
    page = '<script type="application/ld+json">{"@type": "R&amp"}</script><p>a &amp;&amp;&amp</p> b &quot;&quo <a href="/x?a=1&amp;b&amp">c &bogus; d &#65;&#66 &copy</a> &'
    f, loose = H.features(page, "https://x.example/", closed=True), H.features(page, "https://x.example/")
    assert f["body_text"] == 'a &&&amp b "&quo c &bogus; d A&#66 &copy &'
    assert loose["body_text"] == 'a &&& b "&quo c &bogus; d AB © &'
    assert H.parse(page, closed=True).links == ["/x?a=1&b&amp"] and H.parse(page, closed=True).ld == H.parse(page).ld == ['{"@type": "R&amp"}']
    assert H.features("﷐ &amp x", "", closed=True)["body_text"] == "﷐ &amp x"


def test_body_text_equals_its_sql_where_references_are_cut(spark, tmp_path):
    html = ["<title>t</title><p>of&amp;&amp</p>Bleiner&quo <nav>x</nav>&copy;", "<p>&amp;amp; &am</p>&a <b>&middot;</b>"]
    spark.createDataFrame([(i, "https://x.example/", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cols, expected = rows_of_sql(con, registry.oracle_sql()["h1_body_text"])
    got = registry.queries()["h1_body_text"](spark, str(tmp_path))
    assert sorted(got.columns) == cols and rows_of_spark(got) == expected
