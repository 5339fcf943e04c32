"""File formats, resumable work and streams on temporary folders."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from ranklake.operators import incremental as I
from ranklake.sources import files
from ranklake.streaming import events as E


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"run_id":"r","keyword":"k","ranked_domains":["a","b"]}\n\nbroken{\n')
    assert [r.ranked_domains for r in files.read_rerank(spark, str(p)).collect()] == [["a", "b"]]
    with pytest.raises(Exception):
        files.read_rerank(spark, str(p), strict=True).collect()


def test_snapshot(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"serp_results": {"k": {"raw_results": [{"position": 1, "url": "u", "engines": ["x", "y"]}]}, "e": {"raw_results": [], "error": "timeout"}}}))
    rows = {r.keyword: (r.url, r.engines, r.error) for r in files.read_snapshot(spark, str(p)).collect()}
    assert rows["k"] == ("u", "x|y", None) and rows["e"][0] is None and rows["e"][2] == "timeout"


def test_api_chunks(spark, tmp_path):
    p = tmp_path / "c.json"
    item = {"type": "organic", "rank_group": 1, "domain": "a.com", "url": "u"}
    p.write_text(json.dumps({"tasks": [{"status_code": 20000, "result": [{"keyword": "k", "items": [item, item | {"type": "paid"}]}]}, {"status_code": 40000, "result": [{"keyword": "z", "items": [item]}]}]}))
    assert [(r.keyword, r.domain) for r in files.read_api_chunks(spark, str(p)).collect()] == [("k", "a.com")]


def test_dialogues_and_instructions(spark, tmp_path):
    p = tmp_path / "d.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write(json.dumps({"chosen": "\n\nHuman: hi\n\nAssistant: yo\n\nHuman: bye\n\nAssistant: ok", "rejected": "\n\nHuman: hi\n\nAssistant: no"}) + "\n")
    assert [(r.turn, r.text) for r in files.read_dialogues(spark, str(p)).orderBy("turn").collect()] == [(0, "hi"), (1, "bye")]
    q = tmp_path / "i.jsonl"
    q.write_text('{"instruction":"a","context":"","category":"c"}\n{"instruction":"b","context":"x","response":"secret"}\n')
    rows = files.read_instructions(spark, str(q), "d").orderBy("source_record_id").collect()
    assert [(r.source_record_id, r.has_attached_context) for r in rows] == [("d:000000", False), ("d:000001", True)]
    assert "response" not in rows[0].asDict()


def test_partitioned_round_trip_prunes(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, "ddg", 20), ("q", 2, "sx", 50)], "keyword string, position int, engine string, pool int")
    files.write_partitioned(df, str(tmp_path / "serp"), ["engine", "pool"])
    got = files.read_serp(spark, str(tmp_path / "serp"), "ddg", 20)
    assert [r.keyword for r in got.collect()] == ["k"]
    assert "PartitionFilters: [isnotnull(engine" in got._jdf.queryExecution().toString()


def test_csv_to_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y"""\n')
    files.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).first().asDict() == {"a": 1, "b": 'x, "y"'}


def test_html_by_digest(spark, tmp_path):
    import hashlib

    (tmp_path / (hashlib.sha256(b"u").hexdigest()[:16] + ".html")).write_text("<p>é</p>")
    rows = {r.url: r.html for r in files.html_from_files(spark, str(tmp_path), spark.createDataFrame([("u",), ("v",)], "url string")).collect()}
    assert rows == {"u": "<p>é</p>", "v": None}


def test_resume_is_idempotent(spark):
    work = spark.range(10).withColumnRenamed("id", "k")
    done = I.remaining(work, work.where("k < 4"), ["k"])
    assert done.count() == 6
    assert I.remaining(work, work.where("k < 4").union(done), ["k"]).count() == 0


def test_stream_equals_batch(spark, tmp_path, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.deduplicated(E.read_events(spark, str(tmp_path / "in")), "ts", ["event_id"], "3650 days")
    got = E.drained(stream, str(tmp_path / "cp"), "deduplicated_events")
    assert got.count() == batch.select("event_id").distinct().count()


def test_windowed_stream_restarts(spark, tmp_path, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    whole = E.windowed_counts(batch, "ts", ["event_type"], "value")
    stream = E.windowed_counts(E.read_events(spark, str(tmp_path / "in")), "ts", ["event_type"], "value")
    got = E.drained(stream, str(tmp_path / "cp"), "windowed_events", "complete")
    assert got.agg(F.sum("n")).first()[0] == whole.agg(F.sum("n")).first()[0] == batch.count()
