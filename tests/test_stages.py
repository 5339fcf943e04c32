"""Stage drivers and audits on small invented rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ranklake.operators import causal as C
from ranklake.operators import labels as L
from ranklake.operators import latent as La
from ranklake.operators import stages
from ranklake.operators.retrieval import embed_hashed
from ranklake.sources import files


@pytest.fixture(scope="module")
def serp(spark):
    rows = [("red shoes", 1, "Red shoes here", "https://www.a.com/x"), ("red shoes", 2, "Blue", "http://b.org/y"), ("red shoes", None, "skip", "http://c.org"), ("hats", 1, "Hats", "https://a.com/h")]
    return spark.createDataFrame(rows, "keyword string, position int, title string, url string")


@pytest.fixture(scope="module")
def pages(spark):
    body = "red shoes cost $10 and 50% off in 2020. " * 20
    return spark.createDataFrame([("https://www.a.com/x", f"<h2>Why red?</h2><p>{body}</p>"), ("http://b.org/y", "<p>blue</p>"), ("http://none", None)], "url string, html string")


def test_feature_stage(spark, serp, pages):
    brands = spark.createDataFrame([("a.com", "brand")], "domain string, source_type string")
    rows = {(r.keyword, r.url): r for r in stages.feature_stage(serp, pages, brands).collect()}
    assert len(rows) == 3
    a, b, h = rows["red shoes", "https://www.a.com/x"], rows["red shoes", "http://b.org/y"], rows["hats", "https://a.com/h"]
    assert a.html_present and a.question_heading and a.treat_stats_present == 1 and a.conf_title_kw == 1 and a.source_type == "brand"
    assert b.source_type == "other" and not h.html_present and h.conf_word_count is None


def test_merge_stage(spark):
    rec = {"run_id": "r", "keyword": "k", "used_fallback": False, "ranked_results": [{"domain": "a.com", "url": "u1"}, {"domain": "z.com", "url": ""}], "rank_changes": [{"domain": "a.com", "pre_rank": 2, "post_rank": 1, "rank_delta": 1}, {"domain": "z.com", "pre_rank": None, "post_rank": 2, "rank_delta": None}]}
    records = spark.read.schema(files.RERANK).json(spark.sparkContext.parallelize([json.dumps(rec)]))
    features = spark.createDataFrame([("k", "u1", "a.com", 1, 7), ("k", "u9", "z.com", 2, 8)], "keyword string, url string, domain string, position int, v int")
    got = {r.domain: (r.url, r.rank_delta, r.v, r.how) for r in stages.merge_stage(records, features, ["v"]).collect()}
    assert got == {"a.com": ("u1", 1, 7, "exact"), "z.com": ("", None, 8, "loose")}


def test_index_stage(spark, pages):
    rows = stages.index_stage(pages, embed_hashed).collect()
    assert {r.url for r in rows} == {"https://www.a.com/x"} and all(len(r.embedding) == 16 for r in rows)


def test_union_and_inventory(spark):
    a = spark.createDataFrame([("k", 1)], "keyword string, x int")
    b = spark.createDataFrame([("k", "q"), ("z", "q")], "keyword string, y string")
    whole, cover = stages.union_stage({"one": a, "two": b}, ["keyword"])
    assert whole.count() == 3 and {r.keyword: r.coverage for r in cover.collect()} == {"k": "all", "z": "single"}
    assert {r.table: r.rows for r in stages.inventory({"a": a, "b": b}).collect()} == {"a": 1, "b": 2}


def test_report_tables(spark):
    fits = spark.createDataFrame([("pooled", "y", "t", 0.5, 5.0, 0.001), ("cell", "y", "t", 0.1, 0.5, 0.6)], "slice string, outcome string, treatment string, coef double, t_stat double, p_val double")
    t = stages.report_tables(fits)
    assert t["by_slice"].first().pooled == "0.5000***" and t["share"].first().share_clear == 0.5 and t["largest"].first()["slice"] == "pooled"


def test_questions(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"items": [{"question_id": 1, "title": "a &amp; b", "link": "u", "tags": ["x"]}, {"question_id": None, "title": "t", "link": "u"}]}))
    assert [(r.title, r.probe_ids) for r in files.read_questions(spark, str(p), "p1").collect()] == [("a & b", ["p1"])]


def test_judgment_diagnostics(spark):
    df = spark.createDataFrame([("a", "b", "a", "j"), ("b", "a", "a", "j"), ("c", "d", "c", "j"), ("d", "c", "d", "j")], "l string, r string, w string, judge string")
    row = La.judgment_diagnostics(df, "l", "r", "w", "judge").first()
    assert (row.n, row.n_repeated, row.left_share, row.order_consistency) == (4, 0, 0.75, 0.5)


def test_axes_and_cells(spark):
    assert La.axis_cosines({"a": [1, 0], "b": [1, 1]})[0][2] == pytest.approx(0.70710678)
    p = La.plane([2, 0, 0], [1, 1, 0])
    assert (p @ p.T).round(9).tolist() == [[1, 0], [0, 1]]
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.9, 0.9), (5.0, 5.0)], "x double, y double")
    assert {(r.column, r.row): r.n for r in La.support_cells(df, "x", "y", (0, 1, 0, 1), 2).collect()} == {(0, 0): 1, (1, 1): 2}


def test_export_and_batches(spark):
    items = spark.createDataFrame([(1, "open"), (2, "shut")], "item_id long, source_name string")
    notes = spark.createDataFrame([(1, 5), (2, 6)], "item_id long, score int")
    policy = spark.createDataFrame([("open", True), ("shut", False)], "source_name string, redistributable boolean")
    whole, allowed = L.export(items, notes, policy)
    assert whole.count() == 2 and [r.item_id for r in allowed.collect()] == [1]
    q = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("e", "h5")], "task_id string, prompt_sha256 string")
    r = spark.createDataFrame([("a", "x", "h1"), ("b", "x", "h9"), ("d", "x", "h4"), ("e", "x", "h5"), ("e", "y", "h5")], "task_id string, response string, prompt_sha256 string")
    assert {x.task_id: x.problem for x in L.batch_responses(q, r).collect()} == {"a": None, "b": "other-prompt", "c": "missing", "d": "unknown", "e": "repeated"}
    row = L.calibration_audit(spark.createDataFrame([("k", "one"), ("k", "two"), ("z", "two")], "key string, t string"), "t", "key", ["o"]).first()
    assert (row.n, row.n_texts, row.n_keys_with_several, row.lacks_0) == (3, 2, 1, 0)


def test_category_audit(spark):
    df = spark.range(500).select("id", F.sin("id").alias("a"), (F.sin("id") * 2 + F.cos(F.col("id") * 7) * 0.01).alias("b"), F.cos(F.col("id") * 3).alias("c"), F.cos(F.col("id") * 5).alias("y"))
    got = {r["treatment"]: r["advice"] for r in C.category_audit(df, "id", ["b", "c"], ["a"])}
    assert got == {"b": "drop", "c": "keep"}
    assert [r["controls"] for r in C.drop_refits(df, "id", "y", "c", {"a": ["a"]}, ["a", "b"])] == ["all", "without a"]
