"""Judgments, tasks and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import aggregates as A
from ..operators import labels as L
from .registry import query, table


@query(
    "p1_label_tasks",
    """WITH t AS (SELECT doc_id AS item_id, j.judge_slot, j.i FROM documents, (VALUES ('a', 0), ('b', 1), ('c', 2)) j(judge_slot, i))
SELECT item_id, judge_slot, 'task:' || left(sha256('v1:' || item_id || ':' || judge_slot), 24) AS task_id, CASE WHEN (strpos('0123456789abcdef', left(sha256(item_id::VARCHAR), 1)) - 1 + i) % 2 = 0 THEN 'low-first' ELSE 'high-first' END AS presentation_variant FROM t""",
)
def tasks(spark: SparkSession, d: str) -> DataFrame:
    return L.tasks(table(spark, d, "documents"), "doc_id", ["a", "b", "c"])


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of four kinds written from the labels: whole, out of range, abstaining with a score, and no object."""
    good = F.to_json(F.struct(F.lit("rating").alias("answer_type"), (F.col("quality") * 50 + F.when(F.col("doc_id") % 4 == 1, 100).otherwise(0)).alias("overall_readiness_0_100"), *[F.lit(4).alias(s) for s in L.SCALES], F.lit("mixed").alias("category"), F.lit(3).alias("ambiguity_1_7"), F.lit(0.5).alias("confidence_0_1"), F.lit("fine").alias("brief_reason")))
    k = F.col("doc_id") % 4
    raw = F.when(k == 3, "I cannot say").when(k == 2, F.replace(good, F.lit('"rating"'), F.lit('"dont_know"'))).otherwise(F.concat(F.lit("Sure: "), good))
    return table(spark, d, "labels").select("doc_id", "quality", raw.alias("raw"))


@query(
    "p2_p4_judgments",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN quality * 50 + CASE WHEN doc_id % 4 = 1 THEN 100 ELSE 0 END WHEN doc_id % 4 = 2 THEN quality * 50 END AS overall, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN quality = 1 THEN 'readiness-range' ELSE '' END WHEN 2 THEN 'score-of-abstention' ELSE 'no-object' END AS problems FROM labels""",
)
def judgments(spark: SparkSession, d: str) -> DataFrame:
    out = L.judgments(answers(spark, d), "raw")
    return out.select("doc_id", F.col("overall_readiness_0_100").alias("overall"), F.array_join("problems", ",").alias("problems"))


@query(
    "p5_collected",
    "SELECT state, count(*) AS n FROM (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'answered' WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'missing' END AS state FROM documents) GROUP BY state",
)
def collected(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("doc_id").cast("string").alias("task_id")
    docs = table(spark, d, "documents")
    return L.collected(docs.select(id_), table(spark, d, "labels").select(id_), docs.where("doc_id % 10 = 0").select(id_)).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "p7_freeze_audit",
    """WITH i AS (SELECT *, sha256(text) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'development' ELSE 'confirmation' END AS split FROM documents)
SELECT 'digest-differs' AS "check", 0 AS n UNION ALL SELECT 'not-eligible', count_if(NOT len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) BETWEEN 3 AND 100) FROM i UNION ALL SELECT 'no-license', count_if(lang = '') FROM i
 UNION ALL SELECT 'repeated-text', count(*) FROM (SELECT sha FROM i GROUP BY sha HAVING count(*) > 1) UNION ALL SELECT 'split-group', count(*) FROM (SELECT source FROM i GROUP BY source HAVING count(DISTINCT split) > 1)""",
)
def audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256)).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "development").otherwise("confirmation"))
    return L.freeze_audit(rows, "text", "sha", "split", "source", T.eligible(F.col("text")), "lang")


@query(
    "p8_first_user_turns",
    "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING len(regexp_extract_all(arg_min(text, turn), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) BETWEEN 3 AND 100",
)
def user_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    first = L.first_user_turns(turns, "turns", ["user"])
    return turns.select("conv_id", first.alias("text")).where(T.eligible(F.col("text")))


@query("p9_clause_checks", "SELECT conv_id, turn, list_filter([CASE WHEN length(text) < 20 THEN 'short' END, CASE WHEN length(text) > 400 THEN 'long' END, CASE WHEN regexp_matches(text, '\\b\\d{1,3}%') OR regexp_matches(text, '(^|[^\\w.])0?\\.\\d+') THEN 'leaked-number' END, CASE WHEN NOT regexp_matches(text, '[a-z]') THEN 'lacks:[a-z]' END], lambda x: x IS NOT NULL) AS failures FROM conversations")
def clauses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", L.clause_checks(F.col("text"), required=["[a-z]"]).alias("failures"))


@query("p11_candidates", "SELECT l_orderkey, l_suppkey, 'C' || lpad(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey)::VARCHAR, 3, '0') AS candidate FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.candidate_binding(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct(), ["l_orderkey"], "l_suppkey")


@query("p14_panel", "SELECT n_nationkey, style, level::DOUBLE AS level, sha256('7:' || n_nationkey || ':' || style || ':' || CASE level WHEN 0 THEN '0.0' ELSE '1.0' END) AS order_key FROM nation, (VALUES ('plain'), ('formal')) s(style), (VALUES (0), (1)) l(level)")
def panel(spark: SparkSession, d: str) -> DataFrame:
    return L.panel(table(spark, d, "nation").select("n_nationkey"), ["plain", "formal"], [0, 1], 7)


@query(
    "j19_a35_judge_pairs",
    """WITH j AS (SELECT l_partkey AS item, l_linenumber AS judge, max(l_quantity) AS score, min(l_returnflag) AS cat FROM lineitem GROUP BY ALL), p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.score AS x, b.score AS y, a.cat = b.cat AS same FROM j a JOIN j b ON a.item = b.item AND a.judge < b.judge),
 r AS (SELECT *, rank() OVER (PARTITION BY judge_a, judge_b ORDER BY x) + (count(*) OVER (PARTITION BY judge_a, judge_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY judge_a, judge_b ORDER BY y) + (count(*) OVER (PARTITION BY judge_a, judge_b, y) - 1) / 2.0 AS ry FROM p)
SELECT judge_a, judge_b, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 6) AS mean_gap, round(avg((abs(x - y) <= 10)::INT), 6) AS within, round(avg(same::INT), 6) AS same_category FROM r GROUP BY ALL""",
)
def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("judge")).agg(F.max("l_quantity").alias("score"), F.min("l_returnflag").alias("cat"))
    out = A.judge_pairs(rows, "item", "judge", "score", "cat")
    return out.select("judge_a", "judge_b", "n", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "mean_gap", "within", "same_category")])


@query("labels_rates", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
