"""Comparisons of variants, order probes, judgments, axes and targets, resumable writes, and the user's own functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import incremental as I
from ..operators import labels as L
from ..operators import latent as La
from ..operators import ranks as R
from ..operators import relational as Rel
from ..operators import retrieval as Ret
from ..operators import sampling as S
from ..sources.scratch import folder
from . import movement as M
from .registry import query, sql_of, table
from .vectors import _E, vectors

# ---- comparisons ---------------------------------------------------------------


@query("r11_variant_comparison", f"SELECT l_orderkey, k.kendall, r.rbo, j.jaccard FROM ({sql_of('r8_kendall_a')}) k JOIN ({sql_of('r10_rbo')}) r USING (l_orderkey) JOIN ({sql_of('c21_c22_jaccard_overlap')}) j USING (l_orderkey) WHERE j.k = 3")
def variant_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two variants' lists of each keyword; keywords without a pair have no row."""
    both = M.lists(spark, d)
    a, b = F.col("a"), F.col("b")
    said = both.select("l_orderkey", F.round(A.rbo(a, b, 5), 6).alias("rbo"), F.round(A.jaccard(A.head(a, 3), A.head(b, 3)), 6).alias("jaccard"))
    tau = R.kendall(M.ranked(spark, d), ["l_orderkey"], "l_suppkey", "pre", "post")
    return tau.join(said, "l_orderkey").select("l_orderkey", F.round("kendall", 6).alias("kendall"), "rbo", "jaccard")


_PROBE = sql_of("r13_order_pairs_k")


@query("r14_order_report", f"SELECT k, count(*) AS n, round(avg(jaccard), 5) AS jaccard, round(avg(overlap_at_k), 5) AS overlap, min(jaccard) AS worst FROM ({_PROBE}) GROUP BY k")
def order_report(spark: SparkSession, d: str) -> DataFrame:
    rows = M.order_pairs_k(spark, d)
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 5).alias("jaccard"), F.round(F.avg("overlap_at_k"), 5).alias("overlap"), F.min("jaccard").alias("worst"))


def _set_agreement(rows: DataFrame, key: str, side: str, a: str, b: str, item: str) -> DataFrame:
    """Jaccard of a key's item sets on two sides, by counts: no set is gathered."""
    per = rows.where(F.col(side).isin(a, b)).groupBy(key, item).agg(F.max((F.col(side) == a).cast("int")).alias("__a"), F.max((F.col(side) == b).cast("int")).alias("__b"))
    out = per.groupBy(key).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"), F.sum(F.col("__a") * F.col("__b")).alias("n_both"))
    return out.where("n_a > 0 and n_b > 0").withColumn("jaccard", F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 6))


def _agreement_sql(side: str, a: str, b: str) -> str:
    return f"""WITH p AS (SELECT l_suppkey, l_partkey, max(({side} = '{a}')::INT) AS a, max(({side} = '{b}')::INT) AS b FROM lineitem WHERE {side} IN ('{a}', '{b}') GROUP BY ALL)
SELECT l_suppkey, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, round(sum(a * b)::DOUBLE / (sum(a) + sum(b) - sum(a * b)), 6) AS jaccard FROM p GROUP BY l_suppkey HAVING sum(a) > 0 AND sum(b) > 0"""


@query("r15_model_agreement", _agreement_sql("l_returnflag", "A", "R"))
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The sets that two models return for a keyword."""
    return _set_agreement(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "A", "R", "l_partkey")


@query("r16_grounded_agreement", _agreement_sql("l_linestatus", "O", "F"))
def grounded_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The sets with and without retrieved passages."""
    return _set_agreement(table(spark, d, "lineitem"), "l_suppkey", "l_linestatus", "O", "F", "l_partkey")


@query("r6_overlap_at_k", f"WITH {M.LISTS} SELECT l_orderkey, round(len(list_intersect(a[1:4], b[1:4]))::DOUBLE / 4, 6) AS overlap_4, round(len(list_intersect(a[1:10], b[1:10]))::DOUBLE / 10, 6) AS overlap_10 FROM lists")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = M.lists(spark, d)
    return rows.select("l_orderkey", *[F.round(A.overlap_at(F.col("a"), F.col("b"), k), 6).alias(f"overlap_{k}") for k in (4, 10)])


@query("j18_label_pairs", "WITH v AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS label FROM lineitem) SELECT a.l_suppkey, a.label AS label_a, b.label AS label_b FROM v a JOIN v b ON a.l_suppkey = b.l_suppkey AND a.label < b.label")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a keyword's labels; a keyword has a handful of labels."""
    v = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("label")).distinct()
    other = v.select("l_suppkey", F.col("label").alias("label_b"))
    return v.withColumnRenamed("label", "label_a").join(other, "l_suppkey").where("label_a < label_b").select("l_suppkey", "label_a", "label_b")


@query("j23_calibration_join", "SELECT doc_id, round(x, 6) AS x FROM (SELECT doc_id, n_chars / 20000.0 AS x, source FROM documents) JOIN labels USING (doc_id) WHERE quality = 1 AND x BETWEEN 0 AND 1")
def calibration_join(spark: SparkSession, d: str) -> DataFrame:
    """Usable items with coordinates inside the bounds; items without coordinates are left out."""
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 20000.0).alias("x"))
    usable = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return usable.join(x, "doc_id").where("x between 0 and 1").select("doc_id", F.round("x", 6).alias("x"))


@query("j24_label_join", "SELECT doc_id, 'task-' || doc_id AS task_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the item in their task's name; a label without its item raises."""
    labels = table(spark, d, "labels").select(F.concat(F.lit("task-"), "doc_id").alias("task_id"), "quality")
    items = table(spark, d, "documents").select("doc_id", "lang", F.lit(True).alias("__there"))
    rows = labels.withColumn("doc_id", F.split_part("task_id", F.lit("-"), F.lit(2)).cast("long")).join(items, "doc_id", "left")
    known = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no item of "), "task_id")).cast("string")).otherwise(F.col("lang"))
    return rows.select("doc_id", "task_id", "quality", known.alias("lang"))


@query("f10_columns_by_role", "SELECT * FROM (VALUES (0, 'l_orderkey'), (1, 'axis_a'), (2, 'l_quantity'), (3, 'treat_b'), (4, 'dfs_d'), (5, 'conf_c'), (6, 'l_tax')) t(place, name)")
def columns_by_role(spark: SparkSession, d: str) -> DataFrame:
    """A frame's columns in order of their roles, as a table of places."""
    rows = table(spark, d, "lineitem").selectExpr("l_tax", "l_tax AS dfs_d", "l_tax AS conf_c", "l_tax AS treat_b", "l_quantity", "l_tax AS axis_a", "l_orderkey")
    return spark.createDataFrame(list(enumerate(Rel.by_role(rows, ["l_orderkey"], ["l_quantity"]).columns)), "place int, name string")


_FRAME = "PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"


@query(
    "w19_frames",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, round(avg(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling, lag(l_quantity) OVER w AS shifted, ntile(4) OVER w AS quarter,
 sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM lineitem WINDOW w AS ({_FRAME})""".replace("(w ROWS", f"({_FRAME} ROWS"),
)
def frames(spark: SparkSession, d: str) -> DataFrame:
    """Rows and range frames, shifts and tiles."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    near = Window.partitionBy("l_suppkey").orderBy("l_orderkey").rangeBetween(-100, 0)
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.round(F.avg(q).over(w.rowsBetween(-2, 0)), 6).alias("rolling"), F.lag(q).over(w).alias("shifted"), F.ntile(4).over(w).alias("quarter"), F.sum(q).over(near).alias("near"))


# ---- judgments -----------------------------------------------------------------


@query("p3_abstentions", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'dont_know' WHEN doc_id % 3 = 1 THEN 'not_applicable' ELSE 'rating' END AS answer_type, CASE WHEN doc_id % 3 = 2 THEN quality * 50 END AS score, '' AS problems FROM labels")
def abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Answers that abstain have no scores and are whole all the same."""
    k = F.col("doc_id") % 3
    score = lambda x: F.when(k == 2, x)
    kind = F.when(k == 0, "dont_know").when(k == 1, "not_applicable").otherwise("rating")
    fields = [kind.alias("answer_type"), score(F.col("quality") * 50).alias("overall_readiness_0_100"), *[score(F.lit(4)).alias(s) for s in L.SCALES], score(F.lit("mixed")).alias("category"), F.lit(3).alias("ambiguity_1_7"), F.lit(0.5).alias("confidence_0_1"), F.lit("some reason").alias("brief_reason")]
    raw = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    out = L.judgments(table(spark, d, "labels").select("doc_id", raw.alias("raw")), "raw")
    return out.select("doc_id", "answer_type", F.col("overall_readiness_0_100").alias("score"), F.array_join("problems", ",").alias("problems"))


@query("p6_exports", "SELECT scope, count(*) AS n FROM (SELECT 'local' AS scope FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'public' FROM documents JOIN labels USING (doc_id) WHERE source LIKE '%0' OR source LIKE '%2') GROUP BY scope")
def exports(spark: SparkSession, d: str) -> DataFrame:
    """All labels, and those of sources that may be passed on."""
    docs = table(spark, d, "documents")
    policy = docs.select("source").distinct().withColumn("redistributable", F.col("source").rlike("[02]$"))
    whole, public = L.export(docs.select("doc_id", "source"), table(spark, d, "labels"), policy, "doc_id", "source")
    tagged = [df.select(F.lit(n).alias("scope")) for n, df in (("local", whole), ("public", public))]
    return tagged[0].unionAll(tagged[1]).groupBy("scope").agg(F.count("*").alias("n"))


@query(
    "p12_calibration_audit",
    """SELECT count(*) AS n, count(DISTINCT sha256(text)) AS n_texts, min(length(text))::INT AS shortest, max(length(text))::INT AS longest, count_if(NOT regexp_matches(text, '[.]')) AS lacks_0,
 (SELECT count_if(k > 1) FROM (SELECT count(DISTINCT sha256(text)) AS k FROM conversations GROUP BY conv_id)) AS n_keys_with_several FROM conversations""",
)
def calibration_audit(spark: SparkSession, d: str) -> DataFrame:
    return L.calibration_audit(table(spark, d, "conversations"), "text", "conv_id", ["[.]"])


@query(
    "p15_p18_rankers",
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS p FROM lineitem GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS size FROM f)
SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY CASE WHEN size % 2 = 0 THEN n ELSE -n END) AS ranked, any_value(size % 2 = 0) AS used_fallback FROM s GROUP BY l_orderkey""",
)
def rankers(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in ranker turns lists around and fails on even ones, whose pool order stays."""

    def ranker(prompts):
        lists = prompts.str.split("\n")
        return lists.map(lambda x: "" if len(x) % 2 == 0 else "\n".join(f"{i + 1}. {v}" for i, v in enumerate(reversed(x))))

    pool = R.first_seen_rank(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber")
    return Ret.rerank(pool, ["l_orderkey"], "l_suppkey", "rank", 100, ranker, "neutral", [])


@query("p16_shards", "SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4 AS shard FROM documents")
def shards(spark: SparkSession, d: str) -> DataFrame:
    return L.sharded(table(spark, d, "documents").select("doc_id"), "doc_id", 4)


@query(
    "p17_batch_responses",
    "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN o_custkey IS NULL THEN 'unknown' WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 5 = 1 THEN 'repeated' WHEN c_custkey % 5 = 2 THEN 'other-prompt' END AS problem FROM (SELECT c_custkey, c_custkey AS o_custkey FROM customer UNION ALL SELECT NULL, NULL FROM nation)) GROUP BY problem",
)
def batch_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses matched to their requests by task and by the digest of the prompt."""
    c = table(spark, d, "customer")
    name = F.concat(F.lit("t"), F.col("c_custkey"))
    requests = c.select(name.alias("task_id"), F.sha2("c_name", 256).alias("prompt_sha256"))
    k = F.col("c_custkey") % 5
    copies = F.explode(F.sequence(F.lit(1), F.when(k == 1, 2).otherwise(1)))
    answers = c.where(k != 0).select(name.alias("task_id"), F.lit("ok").alias("response"), F.sha2(F.when(k == 2, "other").otherwise(F.col("c_name")), 256).alias("prompt_sha256"), copies.alias("__n")).drop("__n")
    strange = table(spark, d, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("task_id"), F.lit("ok").alias("response"), F.lit("").alias("prompt_sha256"))
    return L.batch_responses(requests, answers.unionByName(strange)).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "e16_judgment_diagnostics",
    """WITH j AS (SELECT l_returnflag AS judge, l_suppkey AS a, l_partkey AS b, CASE WHEN l_quantity > 25 THEN l_suppkey ELSE l_partkey END AS w FROM lineitem WHERE l_suppkey <> l_partkey),
 x AS (SELECT judge, least(a, b) AS lo, greatest(a, b) AS hi, count(DISTINCT (a = least(a, b))) AS orders, avg((w = least(a, b))::INT) AS share, count(*) AS n, sum((w = a)::INT) AS l FROM j GROUP BY ALL)
SELECT judge, sum(n)::BIGINT AS n, count_if(n > orders) AS n_repeated, round(sum(l) / sum(n), 6) AS left_share, round(avg(CASE WHEN orders = 2 THEN (share IN (0, 1))::INT END), 6) AS order_consistency FROM x GROUP BY judge""",
)
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_suppkey <> l_partkey").select("l_returnflag", "l_suppkey", "l_partkey", F.when(F.col("l_quantity") > 25, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("winner"))
    out = La.judgment_diagnostics(rows, "l_suppkey", "l_partkey", "winner", "l_returnflag")
    return out.select(F.col("l_returnflag").alias("judge"), "n", "n_repeated", F.round("left_share", 6).alias("left_share"), F.round("order_consistency", 6).alias("order_consistency"))


# ---- axes, paths and targets -----------------------------------------------------

_U = "(('0x' || substr(md5('42:' || vec_id || ':' || rep), 1, 8))::BIGINT + 0.5) / 4294967296"
_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


@query(
    "e10_r12_a44_bootstrap",
    f"""WITH {_E}, u AS (SELECT label, e[1] AS x, rep, {_U} AS u FROM e, (SELECT unnest(range(100)) AS rep)), w AS (SELECT *, {' + '.join(f'(u > {c})::INT' for c in _CUTS)} AS w FROM u),
 m AS (SELECT label, rep, sum(x * w) / sum(w) AS m FROM w WHERE w > 0 GROUP BY ALL), b AS (SELECT label, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY label)
SELECT label, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM b JOIN (SELECT label, avg(e[1]) AS mean FROM e GROUP BY label) USING (label)""",
)
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    out = La.bootstrap_mean(vectors(spark, d), "vec_id", "first", ["label"], 100)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(
    "e11_permutation",
    f"""WITH {_E}, v AS (SELECT vec_id, e[1] AS x, 10 * e[1] * e[2] + e[3] AS y FROM e), m AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY rep ORDER BY md5('42:' || vec_id || ':' || rep), vec_id) AS b
 FROM v, (SELECT unnest(range(1, 51)) AS rep)), n AS (SELECT p.rep, corr(p.x, q.y) AS r FROM m p JOIN m q ON p.rep = q.rep AND p.a = q.b GROUP BY p.rep), o AS (SELECT corr(x, y) AS observed FROM v)
SELECT round(any_value(observed), 6) AS observed, round(quantile_cont(r, 0.95), 6) AS null_95, round((count_if(r >= observed) + 1) / (count(*) + 1), 6) AS p FROM n, o""",
)
def permutation(spark: SparkSession, d: str) -> DataFrame:
    out = La.permutation_control(vectors(spark, d), "vec_id", "first", "bend", 50)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_PATHS = f"""{_E}, s AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::DOUBLE AS a, e[1] AS r, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM e),
 n AS (SELECT *, lead(r) OVER w AS nr, lead(v) OVER w AS nv, rank() OVER (PARTITION BY label ORDER BY r) + (count(*) OVER (PARTITION BY label, r) - 1) / 2.0 AS rr FROM s WINDOW w AS (PARTITION BY label ORDER BY a)),
 t AS (SELECT *, sqrt(list_sum(list_transform(list_zip(nv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS step FROM n)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return vectors(spark, d).withColumn("level", (F.row_number().over(w) - 1).cast("double"))


@query(
    "e17_measured_paths",
    f"""WITH {_PATHS} SELECT label, count(step) FILTER (WHERE nv IS NOT NULL) AS n_steps, count_if(nr <= r) AS n_reversals, round(avg(abs(r - a)), 6) AS mean_error, round(corr(a, rr), 6) AS spearman,
 round(avg(step) FILTER (WHERE nv IS NOT NULL), 6) AS mean_step, count_if(nr <= r) = 0 AS rises FROM t GROUP BY label""",
)
def measured_paths(spark: SparkSession, d: str) -> DataFrame:
    out = La.measured_paths(_paths(spark, d), "label", "level", "first", "embedding")
    return out.select("label", "n_steps", "n_reversals", "rises", *[F.round(c, 6).alias(c) for c in ("mean_error", "spearman", "mean_step")])


@query(
    "e17_calibrated_levels",
    """WITH s AS (SELECT l_suppkey AS style, l_linenumber, l_quantity AS q, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber >= 5 THEN 1 END AS level FROM lineitem), e AS (SELECT style, avg(q) FILTER (WHERE level = 0) AS lo, avg(q) FILTER (WHERE level = 1) AS hi FROM s GROUP BY style)
SELECT style, count(*) AS n, count(CASE WHEN hi - lo > 1e-9 THEN (q - lo) / (hi - lo) END) AS n_placed, round(avg(CASE WHEN hi - lo > 1e-9 THEN (q - lo) / (hi - lo) END), 4) AS mean FROM s JOIN e USING (style) GROUP BY style""",
)
def calibrated_levels(spark: SparkSession, d: str) -> DataFrame:
    """Strengths between a style's low and high ends; the quantity stands for the fitted strength."""
    level = F.when(F.col("l_linenumber") == 1, 0).when(F.col("l_linenumber") >= 5, 1)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("style"), F.col("l_quantity").alias("strength"), level.alias("level"))
    out = La.calibrated_levels(rows, "style", "level", "strength")
    return out.groupBy("style").agg(F.count("*").alias("n"), F.count("realized").alias("n_placed"), F.round(F.avg("realized"), 4).alias("mean"))


_AXIS = f"""{_E}, x AS (SELECT vec_id, label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM e), f AS (SELECT label, i, avg(x) FILTER (WHERE vec_id % 2 = 0) AS a, avg(x) FILTER (WHERE vec_id % 2 = 1) AS b FROM x GROUP BY ALL),
 m AS (SELECT i, avg(b - a) AS m, avg(a) AS ma, avg(b) AS mb FROM f GROUP BY i), d AS (SELECT i, m / sqrt((SELECT sum(m * m) FROM m)) AS d, ma, mb FROM m), z AS (SELECT sum(ma * d) AS lo, sum(mb * d) AS hi FROM d),
 c AS (SELECT label, f.i, a, b, d, (a + b) / 2 AS mid FROM f JOIN d ON f.i = d.i)"""
_PLACED = f"""{_AXIS}, p AS (SELECT vec_id, label, (sum(x.x * d) - any_value(lo)) / (any_value(hi) - any_value(lo)) AS coordinate, sqrt(greatest(sum((x.x - mid) * (x.x - mid)) - pow(sum((x.x - mid) * d), 2), 0)) / (any_value(hi) - any_value(lo)) AS off_axis
 FROM x JOIN c USING (label, i), z GROUP BY vec_id, label)"""


def _axis(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """A policy axis from each label's mean vectors of even and of odd ids."""
    rows = vectors(spark, d).withColumn("end", (F.col("vec_id") % 2).cast("int"))
    ends = La.centroid(rows, ["label", "end"], "embedding")
    return La.policy_axis(ends, "label", "end", "centroid"), rows


@query("e21_policy_axis", f"WITH {_AXIS} SELECT label, round(sum((b - a) * d) / sqrt(sum((b - a) * (b - a))), 6) AS cosine FROM c GROUP BY label")
def policy_axis(spark: SparkSession, d: str) -> DataFrame:
    axis, _ = _axis(spark, d)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in axis["cosines"].items()], "label int, cosine double")


@query("e21_policy_locations", f"WITH {_PLACED} SELECT vec_id, round(coordinate, 5) AS coordinate, round(abs(coordinate - vec_id % 2), 5) AS error, round(off_axis, 4) AS off_axis FROM p")
def policy_locations(spark: SparkSession, d: str) -> DataFrame:
    axis, rows = _axis(spark, d)
    out = La.located(rows, axis, "label", "end", "embedding")
    return out.select("vec_id", F.round("coordinate", 5).alias("coordinate"), F.round("error", 5).alias("error"), F.round("off_axis", 4).alias("off_axis"))


@query(
    "e21_policy_validation",
    f"""WITH {_PLACED}, n AS (SELECT *, lead(coordinate) OVER (PARTITION BY label ORDER BY vec_id) AS nx, abs(coordinate - vec_id % 2) AS error FROM p), g AS (SELECT label, count(*) AS n, count_if(error > 20 OR off_axis > 60) AS n_rejected, count_if(nx + 0.5 < coordinate) = 0 AS monotone FROM n GROUP BY label)
SELECT *, n_rejected = 0 AND monotone AS passed FROM g""",
)
def policy_validation(spark: SparkSession, d: str) -> DataFrame:
    axis, rows = _axis(spark, d)
    return La.validated(La.located(rows, axis, "label", "end", "embedding"), "label", "vec_id", 20.0, 60.0, 0.5)


@query(
    "e25_axis_cosines",
    f"WITH {_E}, x AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM e), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) SELECT 'c' || a.label AS a, 'c' || b.label AS b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS cosine FROM c a JOIN c b ON a.i = b.i AND 'c' || a.label < 'c' || b.label GROUP BY ALL",
)
def axis_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of the labels' centroids; one vector a label reaches the driver."""
    axes = {f"c{r['label']}": r["centroid"] for r in La.centroid(vectors(spark, d), ["label"], "embedding").collect()}
    return spark.createDataFrame([(a, b, round(c, 6)) for a, b, c in La.axis_cosines(axes)], "a string, b string, cosine double")


@query(
    "e29_support_cells",
    f"WITH {_E}, c AS (SELECT greatest(0, least(9, floor((e[1] + 1) / 2 * 10)))::INT AS \"column\", greatest(0, least(9, floor((e[2] + 1) / 2 * 10)))::INT AS \"row\" FROM e WHERE e[1] BETWEEN -1 AND 1 AND e[2] BETWEEN -1 AND 1) SELECT \"column\", \"row\", count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY ALL",
)
def support_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("second", F.get("embedding", F.lit(1)).cast("double"))
    return La.support_cells(rows, "first", "second", (-1.0, 1.0, -1.0, 1.0), 10).withColumn("share", F.round("share", 6))


@query("e32_plane", f"WITH {_E} SELECT vec_id, round(e[1], 6) AS x, round(e[2], 6) AS y FROM e")
def plane(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates in the plane of two directions that are not orthogonal: the second keeps what the first lacks."""
    a, b = np.zeros(64), np.zeros(64)
    a[0], b[0], b[1] = 2, 1, 3
    basis = La.plane(a, b)
    rows = La.project(vectors(spark, d), "embedding", {"x": basis[0], "y": basis[1]})
    return rows.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("e33_path_cycles", f"WITH {_PATHS} SELECT label, count(*) AS n, count_if(nr <= r) = 0 AS first_rises, round(corr(a, rr), 6) AS first_spearman FROM t GROUP BY label")
def path_cycles(spark: SparkSession, d: str) -> DataFrame:
    out = La.path_cycles(_paths(spark, d), "label", "level", ["first"])
    return out.select("label", "n", "first_rises", F.round("first_spearman", 6).alias("first_spearman"))


_POINTS = f"{_E}, p AS (SELECT vec_id, (e[1] + 1) / 2 AS x, (e[2] + 1) / 2 AS y FROM e), i AS (SELECT *, least(3, floor(x * 4))::INT AS c, least(3, floor(y * 4))::INT AS r FROM p WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1)"


@query(
    "e27_support_targets",
    f"""WITH {_POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY c, r ORDER BY sha256('42:' || vec_id), vec_id) - 1 AS k, count(*) OVER (PARTITION BY c, r) AS size FROM i), g AS (SELECT c, r, size, row_number() OVER (ORDER BY sha256('42:' || c || ':' || r)) - 1 AS cell FROM (SELECT DISTINCT c, r, size FROM o WHERE size >= 3)),
 w AS (SELECT n_nationkey AS key, row_number() OVER (ORDER BY sha256('42:' || n_nationkey), n_nationkey) - 1 AS place FROM nation), t AS (SELECT key, target, (place * 6 + target) % (SELECT count(*) FROM g) AS cell FROM w, (SELECT unnest(range(6)) AS target)),
 d AS (SELECT key, target, g.c, g.r, ('0x' || substr(md5('42:left:' || key || ':' || target), 1, 8))::BIGINT % size AS l, ('0x' || substr(md5('42:right:' || key || ':' || target), 1, 8))::BIGINT % size AS m, ('0x' || substr(md5('42:between:' || key || ':' || target), 1, 8))::BIGINT / 4294967296 AS u FROM t JOIN g USING (cell))
SELECT key, target, d.c AS "column", d.r AS "row", round(u * a.x + (1 - u) * b.x, 6) AS x, round(u * a.y + (1 - u) * b.y, 6) AS y FROM d JOIN o a ON d.c = a.c AND d.r = a.r AND d.l = a.k JOIN o b ON d.c = b.c AND d.r = b.r AND d.m = b.k""",
)
def support_targets(spark: SparkSession, d: str) -> DataFrame:
    """Six targets for each nation over the cells that hold vectors."""
    points = vectors(spark, d).select("vec_id", ((F.col("first") + 1) / 2).alias("x"), ((F.get("embedding", F.lit(1)).cast("double") + 1) / 2).alias("y"))
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    out = La.support_targets(points, "vec_id", "x", "y", keys, "key", 6, n=4)
    return out.select("key", "target", "column", "row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_BRIDGE = f"""{_E}, q AS (SELECT e[1] AS x, e[2] AS y, e[3] AS s, e[4] AS t FROM e), c AS (SELECT regr_sxx(x, x) + 0.001 AS xx, regr_sxx(y, y) + 0.001 AS yy, regr_sxy(x, y) AS xy, regr_sxy(x, s) AS xs, regr_sxy(y, s) AS ys, regr_sxy(x, t) AS xt, regr_sxy(y, t) AS yt, xx * yy - xy * xy AS det FROM q)"""


@query(
    "e30_coordinate_bridge",
    f"WITH {_BRIDGE} SELECT 'x' AS coordinate, round((xs * yy - ys * xy) / det, 6) AS s, round((xt * yy - yt * xy) / det, 6) AS t FROM c UNION ALL SELECT 'y', round((ys * xx - xs * xy) / det, 6), round((yt * xx - xt * xy) / det, 6) FROM c",
)
def coordinate_bridge(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyst")])
    found = La.coordinate_bridge(rows, ["s", "t"], "x", "y")["directions"]
    return spark.createDataFrame([(c, *(round(float(v), 6) for v in r)) for c, r in zip("xy", found, strict=True)], "coordinate string, s double, t double")


@query("e31_feedback", "SELECT n_nationkey, 0.25 * (1 - pow(0.5, 5)) + 0.5 AS x FROM nation")
def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds of steering by halves towards a target, with a scorer that reads the state back: each leaves half the way."""
    bridge = {"coordinate_mean": np.full(2, 0.5), "state_mean": np.full(2, 0.5), "directions": np.eye(2)}
    render = lambda state: ",".join(f"{v:.12f}" for v in state)
    score = lambda text: [float(v) for v in text.split(",")]
    steps = La.feedback([0.5, 0.5], [0.75, 0.5], bridge, render, score, lambda text: True, close=0.0)
    return table(spark, d, "nation").select("n_nationkey", F.lit(steps[-1]["x"]).alias("x"))


@query("t11_jitter_levels", "SELECT i::INT AS i, CASE WHEN i IN (0, 10) THEN i / 10 ELSE i / 10 + (('0x' || substr(sha256('42:' || i), 1, 12))::BIGINT / pow(16, 12) * 2 - 1) * 0.4 / 10 END AS level FROM (SELECT unnest(range(11)) AS i)")
def jitter(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(S.jittered_levels(11, 42))), "i int, level double")


@query("t15_population_paths")
def population_paths(spark: SparkSession, d: str) -> DataFrame:
    """For each label a grid of two by three cells, each filled by one of its vectors at the least total cost, first entries
    rising along rows and second ones from row to row. Styles are independent here, as no vector has two labels."""
    import pandas as pd

    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.asc_nulls_last("vec_id"), "first", "second")) - 1
    rows = vectors(spark, d).select("label", "vec_id", "first", F.get("embedding", F.lit(1)).cast("double").alias("second")).withColumn("turn", turn).withColumn("cell", F.col("turn") % 6)
    i, j = F.floor(F.col("cell") / 2), F.col("cell") % 2
    rows = rows.withColumn("cost", F.abs(F.col("first") - (j - 0.5)) + F.abs(F.col("second") - (i - 1) / 2)).where(F.col("cost") < float("inf"))
    rows = rows.groupBy("label", "cell", "first", "second", "cost").agg(F.min(F.struct("turn", "vec_id")).alias("t")).select("label", "cell", "first", "second", "cost", "t.turn", "t.vec_id")  # of copies the first is enough

    def best(group):
        grid = [[[], []] for _ in range(3)]
        for r in group.sort_values("turn").itertuples():
            grid[r.cell // 2][r.cell % 2].append({"id": r.vec_id, "hash": r.turn, "x": r.first, "y": r.second, "cost": r.cost})
        return S.population_paths({0: grid})[0] or []

    def bounds(key, group):
        least, chosen = group.groupby("cell")["cost"].min(), best(group)
        over = S.path_excess([c["cost"] for c in chosen], least.tolist()) if chosen else np.inf
        return pd.DataFrame({"of": [key[0]] * len(least), "at": least.index, "least": least.to_numpy(), "over": over})

    def pick(key, group):
        chosen = best(group)
        return pd.DataFrame({"label": [key[0]] * len(chosen), "place": list(range(len(chosen))), "vec_id": [c["id"] for c in chosen], "cost": [round(c["cost"], 6) for c in chosen]})

    # a path of each cell's 32 cheapest bounds what a vector of the best path may cost, so no label's vectors are gathered
    cheap = rows.withColumn("n", F.row_number().over(Window.partitionBy("label", "cell").orderBy("cost", "turn"))).where("n <= 32").drop("n")
    bound = cheap.groupBy("label").applyInPandas(bounds, "of int, at int, least double, over double")
    near = rows.join(bound, F.col("label").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).where("cost - least <= over")
    return near.select(*rows.columns).groupBy("label").applyInPandas(pick, "label int, place int, vec_id long, cost double")


# ---- resumable writes and the user's own functions --------------------------------


@query("x4_flushed_batches", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY ALL")
def flushed(spark: SparkSession, d: str) -> DataFrame:
    """Work is appended in batches; each run takes only what earlier ones have not written, also after a broken run."""
    path = folder(spark, "flushed")
    work = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    batch = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 2), 16, 10).cast("int")
    work.where(batch < 64).write.mode("append").parquet(path)
    for limit in (128, 256):
        done = spark.read.parquet(path)
        I.remaining(work.where(batch < limit), done, ["o_orderkey"]).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"))


@query(
    "g1_g8_user_functions",
    """SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity * 2 + length(l_linestatus)), 6) AS mean, max(CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END) AS word, count(*) * 2 AS copies FROM lineitem GROUP BY ALL""",
)
def user_functions(spark: SparkSession, d: str) -> DataFrame:
    """A function of a row, of a column, of a group, a generator and one registered by name, each the user's own."""
    import pandas as pd

    spark.udf.register("twice_and_length", F.pandas_udf(lambda q, s: q * 2 + s.str.len(), "double"))
    word = F.pandas_udf(lambda q: q.map(lambda x: "many" if x > 25 else "few"), "string")
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_linestatus").withColumn("row", F.expr("twice_and_length(l_quantity, l_linestatus)")).withColumn("word", word("l_quantity"))
    copied = lines.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))

    def sums(batches):
        import pyarrow as pa

        for b in batches:  # partial sums of a batch, so that no group is gathered
            t = pa.table(b.to_pydict()).to_pandas().assign(first=lambda x: x["copy"] == 0)
            g = t.groupby("l_returnflag").agg(n=("first", "sum"), total=("row", lambda s: s.sum() / 2), word=("word", "max"), copies=("copy", "size")).reset_index()
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"flag": g["l_returnflag"], "n": g["n"].astype("int64"), "total": g["total"], "word": g["word"], "copies": g["copies"].astype("int64")}), preserve_index=False)

    per = copied.select("l_returnflag", "row", "word", "copy").mapInArrow(sums, "flag string, n long, total double, word string, copies long")
    return per.groupBy("flag").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.max("word").alias("word"), F.sum("copies").alias("copies"))
