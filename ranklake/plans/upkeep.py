"""Resumable work, snapshots, sources and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental as I
from ..streaming import events as E
from .registry import query, table


@query("x2_x3_remaining", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderkey % 5 <> 0")
def remaining(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.remaining(work, done, ["o_orderkey"], work.where("o_orderkey % 5 = 0"))


@query(
    "x5_work_plan",
    """WITH t AS (SELECT c_nationkey, count(*) AS n_target, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS n_done FROM customer GROUP BY ALL)
SELECT *, n_target - n_done AS n_missing, CASE WHEN n_target = n_done THEN 'whole' WHEN n_done < 0.5 * n_target THEN 'quarantine' ELSE 'open' END AS state FROM t""",
)
def work_plan(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return I.plan(target, target.join(done.distinct(), "c_custkey", "left_semi"), ["c_nationkey"], "c_custkey")


@query("x7_snapshot_diff", "SELECT coalesce(a.k, b.k) AS l_suppkey, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL) b ON a.k = b.k")
def diff(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return I.snapshot_diff(lines.where("l_linenumber = 1"), lines.where("l_linenumber = 2"), ["l_suppkey"])


@query("x8_x9_scrub_backfill", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'local' ELSE 'api' END AS backend, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'int4' END, 'bf16') AS precision FROM orders WHERE o_orderstatus = 'F'")
def scrub(spark: SparkSession, d: str) -> DataFrame:
    rows = I.scrub(table(spark, d, "orders"), "o_orderstatus", "F")
    rows = rows.withColumn("params", F.struct(F.when(F.col("o_orderkey") % 3 == 0, "local").alias("backend"), F.when(F.col("o_orderkey") % 2 == 0, "int4").alias("precision")))
    return I.backfill_field(rows, "params", {"backend": "api", "precision": "bf16"}).select("o_orderkey", "params.backend", "params.precision")


@query("s5_last_record", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("seq"))
    return I.last_by_order(rows, ["user_id"], "seq").drop("seq")


@query("s8_s9_nested_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def nested(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("x1_windowed_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark: SparkSession, d: str) -> DataFrame:
    return E.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value")


@query(
    "x1_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"), "ts", "user_id")


@query("x10_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return E.deduplicated(table(spark, d, "events"), "ts", ["event_id"]).agg(F.count("*").alias("n"))
