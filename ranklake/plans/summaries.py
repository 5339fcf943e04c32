"""Grouped summaries, pivots, slices and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import aggregates as A
from .registry import query, table


@query("a1_a15_counts", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("n_parts"))


@query(
    "a2_a3_cell_summary",
    """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.1), 6) AS p10, count(*) AS n, count(DISTINCT l_suppkey) AS n_kw FROM lineitem GROUP BY ALL""",
)
def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.round(F.percentile("l_quantity", F.lit(0.1)), 6).alias("p10"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_kw"))


@query(
    "a4_t9_high_variance",
    """WITH p AS (SELECT l_orderkey, count(l_quantity) AS n, var_samp(l_quantity) AS var FROM lineitem GROUP BY ALL HAVING count(l_quantity) >= 5)
SELECT l_orderkey, n, round(var, 6) AS var FROM p WHERE var >= (SELECT quantile_cont(var, 0.75) FROM p) + 1e-9""",
)
def variance(spark: SparkSession, d: str) -> DataFrame:
    rows = A.high_variance_keys(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    limit = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_quantity").alias("n"), F.var_samp("l_quantity").alias("var")).where("n >= 5").agg(F.percentile("var", F.lit(0.75)).alias("q"))
    return rows.crossJoin(F.broadcast(limit)).where("var >= q + 1e-9").select("l_orderkey", "n", F.round("var", 6).alias("var"))


@query(
    "a5_a6_first_known",
    """SELECT user_id, arg_min(x, seq) FILTER (WHERE x IS NOT NULL) AS first_high, arg_min(e, seq) FILTER (WHERE e IS NOT NULL) AS first_click
FROM (SELECT user_id, event_id AS seq, CASE WHEN value > 50 THEN value END AS x, CASE WHEN event_type = 'click' THEN event_type END AS e FROM events) GROUP BY user_id""",
)
def first_known(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("value") > 50, F.col("value")).alias("x"), F.when(F.col("event_type") == "click", F.col("event_type")).alias("e"))
    return rows.groupBy("user_id").agg(A.first_known("x", "seq").alias("first_high"), A.first_known("e", "seq").alias("first_click"))


@query("a7_numeric_means", "SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL")
def means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax")
    return rows.groupBy("l_suppkey").agg(*[F.round(F.avg(c), 6).alias(c) for c, t in rows.dtypes if t == "double"])


@query(
    "a8_a9_flag_consistency",
    """SELECT count_if(hi > 0) AS n_flagged, count_if(hi <> lo) AS n_mixed, count_if(kinds > 1) AS n_many FROM (SELECT l_suppkey, max((l_discount > 0.05)::INT) AS hi, min((l_discount > 0.05)::INT) AS lo, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY ALL)""",
)
def consistency(spark: SparkSession, d: str) -> DataFrame:
    high = (F.col("l_discount") > 0.05).cast("int")
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(high).alias("hi"), F.min(high).alias("lo"), F.countDistinct("l_returnflag").alias("kinds"))
    return per.agg(F.count_if(F.col("hi") > 0).alias("n_flagged"), F.count_if(F.col("hi") != F.col("lo")).alias("n_mixed"), F.count_if(F.col("kinds") > 1).alias("n_many"))


@query("a11_a12_rates", "SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS rate, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_selected, count(*) AS n_pool FROM orders GROUP BY ALL")
def rates(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(hit), 6).alias("rate"), F.sum(hit).alias("n_selected"), F.count("*").alias("n_pool"))


@query("a13_value_counts", "SELECT coalesce(quality::VARCHAR, '(missing)') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("(missing)")).alias("quality")).agg(F.count("*").alias("n"))


@query("a14_a43_crosstab", "SELECT lang, count_if(toxic = 0) AS toxic_0, count_if(toxic = 1) AS toxic_1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return A.crosstab(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "lang", "toxic", [0, 1])


@query("a16_a17_pivot", "SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN m END) AS A, max(CASE WHEN l_returnflag = 'N' THEN m END) AS N, max(CASE WHEN l_returnflag = 'R' THEN m END) AS R FROM (SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("m"))
    return A.pivot_unique(rows, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "m")


@query(
    "a18_pair_delta",
    """SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS l_quantity_a, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS l_quantity_b,
 round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A') - avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS l_quantity_delta FROM lineitem GROUP BY ALL""",
)
def delta(spark: SparkSession, d: str) -> DataFrame:
    rows = A.pair_delta(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "A", "R", ["l_quantity"])
    return rows.select("l_suppkey", *[F.round(c, 6).alias(c) for c in rows.columns if c != "l_suppkey"])


@query(
    "a19_text_pivot",
    """SELECT l_returnflag, coalesce(max(CASE WHEN l_linestatus = 'F' THEN t END), '') AS F, coalesce(max(CASE WHEN l_linestatus = 'O' THEN t END), '') AS O FROM (SELECT l_returnflag, l_linestatus, count(*)::VARCHAR || CASE WHEN count(*) > 10000 THEN '***' ELSE '' END AS t FROM lineitem GROUP BY ALL) GROUP BY ALL""",
)
def text_pivot(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.count("*").cast("string"), F.when(F.count("*") > 10000, "***").otherwise(""))
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(cell.alias("t"))
    return rows.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.first("t")).na.fill("")


@query("a20_a21_sets", "SELECT l_suppkey, len(list_distinct(list(l_returnflag))) AS n_flags, list_contains(list(DISTINCT l_linenumber), 1) AND list_contains(list(DISTINCT l_linenumber), 7) AS both_ends FROM lineitem GROUP BY ALL")
def sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of bounded domains only: three flags and seven line numbers."""
    lines = F.collect_set("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.size(F.collect_set("l_returnflag")).cast("long").alias("n_flags"), (F.array_contains(lines, 1) & F.array_contains(lines, 7)).alias("both_ends"))


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_tax")


@query(
    "a22_a24_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(stddev_pop({c}), 6) AS std_pop, min({c}) AS min, max({c}) AS max, """
        + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{int(p * 100):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
        + " FROM lineitem"
        for c in _DESCRIBED
    ),
)
def describe(spark: SparkSession, d: str) -> DataFrame:
    return A.describe(table(spark, d, "lineitem"), _DESCRIBED)


_COVERED = "SELECT '{c}' AS \"column\", count({c}) AS n, count(*) AS total, round(count({c}) / count(*), 6) AS share, (count(*) - count({c}))::VARCHAR || '/' || count(*)::VARCHAR AS report FROM documents LEFT JOIN labels USING (doc_id)"


@query("a25_a26_coverage", " UNION ALL ".join(_COVERED.format(c=c) for c in ("text", "quality", "toxic")))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["text", "quality", "toxic"])


@query("a27_key_mean", "SELECT o_custkey, round(avg(s_acctbal), 2) AS difficulty FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING abs(avg(s_acctbal) * 100 - floor(avg(s_acctbal) * 100) - 0.5) > 1e-6")
def key_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").select("l_orderkey", "s_acctbal")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = rows.join(orders, "l_orderkey").groupBy("o_custkey").agg(F.avg("s_acctbal").alias("m"))
    # values at a rounding edge depend on the order of the sum
    return out.where("abs(m * 100 - floor(m * 100) - 0.5) > 1e-6").select("o_custkey", F.round("m", 2).alias("difficulty"))


_JUDGED = """j AS (SELECT l_partkey AS item, l_suppkey AS judge, CASE WHEN l_linenumber = 7 THEN 'dont_know' ELSE 'rating' END AS kind, l_quantity AS score, round(l_discount * 100)::INT AS conf FROM lineitem)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as ratings: parts are items, suppliers judges, line 7 an abstention."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("judge"), F.when(F.col("l_linenumber") == 7, "dont_know").otherwise("rating").alias("kind"), F.col("l_quantity").alias("score"), F.round(F.col("l_discount") * 100).cast("int").alias("conf"))


@query(
    "a28_a29_consensus",
    f"""WITH {_JUDGED}, v AS (SELECT *, CASE WHEN kind = 'rating' THEN score END AS s FROM j), m AS (SELECT item, median(s) AS med FROM v GROUP BY item),
 g AS (SELECT item, any_value(med) AS median, round(avg(s), 6) AS mean, median(abs(s - med)) AS mad, count(s) AS n_ratings, count(*) AS n_judges, round(avg(conf), 6) AS confidence FROM v JOIN m USING (item) GROUP BY item)
SELECT *, round(1 - n_ratings / n_judges, 6) AS abstained, n_ratings >= 2 AND coalesce(mad, 1e9) <= 15 AND confidence >= 5 AS usable FROM g""",
)
def consensus(spark: SparkSession, d: str) -> DataFrame:
    rows = A.consensus(judged(spark, d), "item", "score", "kind", "conf", least_confidence=5.0)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "confidence", "abstained")})


@query("a30_saliency", "WITH t AS (SELECT event_type, value, event_type IN ('click', 'view') AS hit_a, event_type = 'purchase' AS hit_b FROM events), m AS (SELECT 'look' AS label, avg(value) FILTER (WHERE hit_a) AS tagged, avg(value) FILTER (WHERE NOT hit_a) AS other FROM t UNION ALL SELECT 'buy', avg(value) FILTER (WHERE hit_b), avg(value) FILTER (WHERE NOT hit_b) FROM t) SELECT label, round(tagged, 6) AS tagged, round(other, 6) AS other, round(tagged / greatest(other, 1e-12), 6) AS ratio FROM m")
def saliency(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("event_type").isin("click", "view"), F.lit("look")), F.when(F.col("event_type") == "purchase", F.lit("buy"))))
    rows = A.saliency_ratio(table(spark, d, "events").withColumn("tags", tags), "tags", "value", ["look", "buy"])
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("tagged", "other", "ratio")])


@query("a31_merged_arrays", "SELECT l_suppkey, list_sort(list_distinct(list(l_returnflag) || list(l_linestatus))) AS tags, list_sort(list(DISTINCT l_linenumber)) AS probes FROM lineitem GROUP BY ALL")
def merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.array("l_returnflag", "l_linestatus").alias("tags"), F.array("l_linenumber").alias("probes"))
    # distinct first: the unions then gather at most the few different arrays of a key
    rows = rows.distinct()
    return A.merged_arrays(rows, ["l_suppkey"], ["tags", "probes"])


@query("a32_a33_cell_counts", "SELECT l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS cell, count(*) AS n FROM lineitem GROUP BY ALL")
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_linenumber").alias("cell")).agg(F.count("*").alias("n"))


@query("a34_leaking_groups", "SELECT l_partkey, count(DISTINCT l_returnflag) AS n_splits FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def leaking(spark: SparkSession, d: str) -> DataFrame:
    return A.leaking_groups(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("a36_counts_of_counts", "SELECT size, count(*) AS n_items FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY ALL) GROUP BY size")
def sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.counts_of_counts(table(spark, d, "lineitem"), "l_orderkey")


@query(
    "a37_two_proportions",
    """WITH p AS (SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n1, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS n2,
 avg((o_orderstatus = 'F')::INT) FILTER (WHERE o_orderpriority = '1-URGENT') AS r1, avg((o_orderstatus = 'F')::INT) FILTER (WHERE o_orderpriority <> '1-URGENT') AS r2, avg((o_orderstatus = 'F')::INT) AS r FROM orders)
SELECT n1, n2, round(r1, 6) AS rate_1, round(r2, 6) AS rate_2, round((r1 - r2) / sqrt(r * (1 - r) * (1 / n1 + 1 / n2)), 6) AS z FROM p""",
)
def proportions(spark: SparkSession, d: str) -> DataFrame:
    hit, first = (F.col("o_orderstatus") == "F").cast("int"), F.col("o_orderpriority") == "1-URGENT"
    p = table(spark, d, "orders").agg(F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"), F.avg(F.when(first, hit)).alias("r1"), F.avg(F.when(~first, hit)).alias("r2"), F.avg(hit).alias("r"))
    z = (F.col("r1") - F.col("r2")) / F.sqrt(F.col("r") * (1 - F.col("r")) * (1 / F.col("n1") + 1 / F.col("n2")))
    return p.select("n1", "n2", F.round("r1", 6).alias("rate_1"), F.round("r2", 6).alias("rate_2"), F.round(z, 6).alias("z"))


@query("a38_correlation_per_source", "SELECT source, count(*) AS n, round(corr(n_chars, length(text) - length(replace(text, ' ', ''))), 6) AS r FROM documents GROUP BY source HAVING count(*) >= 3")
def per_source(spark: SparkSession, d: str) -> DataFrame:
    spaces = (F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))).cast("double")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(M.safe_corr(F.col("n_chars").cast("double"), spaces), 6).alias("r")).where("n >= 3")


@query("a39_best_coverage", "SELECT l_returnflag, l_linestatus, n FROM (SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) ORDER BY n DESC, l_returnflag, l_linestatus LIMIT 1")
def best_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.countDistinct("l_partkey").alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(1)


@query("a40_best_row", "SELECT o_custkey, o_totalprice, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best(spark: SparkSession, d: str) -> DataFrame:
    return A.best_row(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query(
    "a41_d11_slices",
    """SELECT 'pooled' AS slice, '' AS value, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'engine', l_returnflag, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY l_returnflag
 UNION ALL SELECT 'model', l_linestatus, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY l_linestatus UNION ALL SELECT 'cell', l_returnflag || '|' || l_linestatus, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def slices(spark: SparkSession, d: str) -> DataFrame:
    rows = A.sliced(table(spark, d, "lineitem"), {"pooled": [], "engine": ["l_returnflag"], "model": ["l_linestatus"], "cell": ["l_returnflag", "l_linestatus"]})
    return rows.groupBy("slice", "value").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a41_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("a42_mean_available", "SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE (coalesce(quality, 0) + coalesce(toxic, 0)) / ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) END AS mean FROM documents LEFT JOIN labels USING (doc_id)")
def mean_available(spark: SparkSession, d: str) -> DataFrame:
    known = F.array_compact(F.array("quality", "toxic"))
    total = F.aggregate(known, F.lit(0), lambda a, x: a + x.cast("int"))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.try_divide(total.cast("double"), F.size(known)).alias("mean"))


@query("a23_safe_stats", "SELECT l_suppkey, count(x) AS n, coalesce(round(avg(x), 6), 0) AS mean, coalesce(median(x), 0) AS median, coalesce(round(stddev_pop(x), 6), 0) AS std, coalesce(min(x), 0) AS min, coalesce(max(x), 0) AS max FROM (SELECT l_suppkey, CASE WHEN l_quantity > 49 THEN l_extendedprice END AS x FROM lineitem) GROUP BY ALL")
def safe_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 49, F.col("l_extendedprice")).alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy("l_suppkey").agg(F.count("x").alias("n"), zero(F.round(F.avg("x"), 6)).alias("mean"), zero(F.median("x")).alias("median"), zero(F.round(F.stddev_pop("x"), 6)).alias("std"), zero(F.min("x")).alias("min"), zero(F.max("x")).alias("max"))
