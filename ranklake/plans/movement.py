"""Ranked lists over the order lines: an order is a keyword, its suppliers are the ranked domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import ranks as R
from .registry import query, table

#: One row for each (order, supplier), as in the pool before re-ranking.
PAIRS = """pairs AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS line, max(l_extendedprice) AS price,
 min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_suppkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_suppkey) AS pre,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, l_suppkey) AS post FROM pairs)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"), F.max("l_extendedprice").alias("price"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Both ranks of every (order, supplier); the two windows share the shuffle by order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    return pairs(spark, d).withColumn("pre", F.row_number().over(w.orderBy("line", "l_suppkey"))).withColumn("post", F.row_number().over(w.orderBy(F.desc("price"), "l_suppkey")))


@query(
    "a10_movement",
    f"""WITH {PAIRS}, d AS (SELECT *, abs(pre - post) AS x FROM r)
SELECT l_returnflag, l_linestatus, count(*) AS n, median(x) AS median_abs, round(avg(x), 6) AS mean_abs,
 round(avg(CASE WHEN x >= 1 THEN 1.0 ELSE 0.0 END), 6) AS share_1, round(avg(CASE WHEN x >= 3 THEN 1.0 ELSE 0.0 END), 6) AS share_3
FROM d GROUP BY GROUPING SETS ((), (l_returnflag, l_linestatus))""",
)
def movement(spark: SparkSession, d: str) -> DataFrame:
    return R.movement(ranked(spark, d).withColumn("delta", F.col("pre") - F.col("post")), "delta", ["l_returnflag", "l_linestatus"])


@query(
    "w1_first_seen_rank",
    "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_suppkey) AS rank FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS p FROM lineitem GROUP BY ALL)",
)
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.first_seen_rank(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber")


@query(
    "w2_rank_changes",
    """WITH a AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_suppkey) AS rank FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS p FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)),
 b AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_suppkey) AS rank FROM (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL))
SELECT l_orderkey, l_suppkey, b.rank AS post_rank, a.rank AS pre_rank, a.rank - b.rank AS rank_delta FROM b LEFT JOIN a USING (l_orderkey, l_suppkey)""",
)
def changes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    before = R.first_seen_rank(lines.where("l_linenumber <= 4"), ["l_orderkey"], "l_suppkey", "l_linenumber")
    after = R.first_seen_rank(lines, ["l_orderkey"], "l_suppkey", "l_extendedprice", ascending=False)
    return R.rank_changes(before, after, ["l_orderkey"], "l_suppkey")


@query(
    "r7_spearman_ordinal",
    f"WITH {PAIRS} SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum((pre - post) * (pre - post))::DOUBLE / (count(*) * (count(*) * count(*) - 1)) END, 6) AS spearman FROM r GROUP BY l_orderkey",
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return R.spearman_ordinal(ranked(spark, d), ["l_orderkey"], "pre", "post").withColumn("spearman", F.round("spearman", 6))


@query(
    "r8_kendall_a",
    f"""WITH {PAIRS}, p AS (SELECT a.l_orderkey, sign(a.pre - b.pre) * sign(a.post - b.post) AS s FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)
SELECT l_orderkey, count(*) AS n_pairs, round(sum(s)::DOUBLE / count(*), 6) AS kendall FROM p GROUP BY l_orderkey""",
)
def kendall_a(spark: SparkSession, d: str) -> DataFrame:
    return R.kendall(ranked(spark, d), ["l_orderkey"], "l_suppkey", "pre", "post").withColumn("kendall", F.round("kendall", 6))


@query(
    "r9_kendall_b",
    """WITH pairs AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS x, max(l_quantity) AS y FROM lineitem GROUP BY ALL),
 p AS (SELECT a.l_orderkey, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM pairs a JOIN pairs b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)
SELECT l_orderkey, count(*) AS n_pairs, round(sum(sx * sy)::DOUBLE / nullif(sqrt(count_if(sx <> 0)::DOUBLE * count_if(sy <> 0)), 0), 6) AS kendall FROM p GROUP BY l_orderkey""",
)
def kendall_b(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("x"), F.max("l_quantity").alias("y"))
    return R.kendall(base, ["l_orderkey"], "l_suppkey", "x", "y", ties="b").withColumn("kendall", F.round("kendall", 6))


LISTS = f"""{PAIRS}, lists AS (SELECT l_orderkey, list(l_suppkey ORDER BY pre) AS a, list(l_suppkey ORDER BY post) AS b FROM r GROUP BY l_orderkey)"""


def lists(spark: SparkSession, d: str) -> DataFrame:
    """Both orders of each order's suppliers as arrays (an order has few lines)."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "l_suppkey"))), lambda x: x["l_suppkey"])
    return ranked(spark, d).groupBy("l_orderkey").agg(by("pre").alias("a"), by("post").alias("b"))


@query(
    "c21_c22_jaccard_overlap",
    f"""WITH {LISTS} SELECT l_orderkey, k, round(len(list_intersect(a[1:k], b[1:k]))::DOUBLE / len(list_distinct(list_concat(a[1:k], b[1:k]))), 6) AS jaccard,
 round(len(list_intersect(a[1:k], b[1:k]))::DOUBLE / k, 6) AS overlap FROM lists, (VALUES (1), (3), (5)) AS t(k)""",
)
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = lists(spark, d)
    measures = [F.struct(F.lit(k).alias("k"), F.round(A.jaccard(A.head(F.col("a"), k), A.head(F.col("b"), k)), 6).alias("jaccard"), F.round(A.overlap_at(F.col("a"), F.col("b"), k), 6).alias("overlap")) for k in (1, 3, 5)]
    return rows.select("l_orderkey", F.explode(F.array(*measures)).alias("m")).select("l_orderkey", "m.*")


_RBO = """round(0.1 * list_sum(list_transform(range(1, 6), lambda d: {share} * pow(0.9, d - 1))) + {last} * pow(0.9, 5), 6)"""
_SHARE = "(len(list_intersect(a[1:d], b[1:d]))::DOUBLE / d)"
_SAME = "((len(list_intersect(a[1:d], b[1:d])) - len(list_filter(range(1, d + 1), lambda e: a[e] = b[e])))::DOUBLE / d)"


@query(
    "r10_rbo",
    f"""WITH {LISTS} SELECT l_orderkey, {_RBO.format(share=_SHARE, last="(len(list_intersect(a[1:5], b[1:5]))::DOUBLE / 5)")} AS rbo,
 {_RBO.format(share=_SAME, last="((len(list_intersect(a[1:5], b[1:5])) - len(list_filter(range(1, 6), lambda e: a[e] = b[e])))::DOUBLE / 5)")} AS rbo_archived FROM lists""",
)
def rbo(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return lists(spark, d).select("l_orderkey", F.round(A.rbo(a, b, 5), 6).alias("rbo"), F.round(A.rbo_archived(a, b, 5), 6).alias("rbo_archived"))


@query(
    "c24_position",
    f"WITH {LISTS} SELECT l_orderkey, coalesce(list_position(b, a[1]), 0) - 1 AS place, len(a) AS n FROM lists",
)
def place(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("l_orderkey", A.position(F.col("b"), F.get("a", F.lit(0))).alias("place"), F.size("a").cast("long").alias("n"))


@query(
    "w5_top_k_per_group",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 3",
)
def top(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "lineitem"), ["l_orderkey"], 3, F.desc("l_extendedprice"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


@query(
    "w3_w4_first_row_per_key",
    "SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem) WHERE n = 1",
)
def first(spark: SparkSession, d: str) -> DataFrame:
    return R.first_by(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")).select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")


@query(
    "w6_average_ranks",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rank FROM lineitem""",
)
def average(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", R.average_rank("l_quantity", "l_suppkey").alias("rank"))


@query("w7_ordinal_ranks", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer")
def ordinal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", R.ordinal_rank("c_acctbal", "c_custkey", "c_nationkey").alias("rank"))


@query(
    "w8_mean_rank",
    """WITH s AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
 r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY -round(m, 6)) + (count(*) OVER (PARTITION BY l_returnflag, round(m, 6)) - 1) / 2.0 AS rank FROM s)
SELECT l_suppkey, round(avg(rank), 6) AS mean_rank FROM r GROUP BY l_suppkey""",
)
def mean_rank(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg((-F.round(F.avg("l_quantity"), 6)).alias("m"))
    return s.withColumn("rank", R.average_rank("m", "l_returnflag")).groupBy("l_suppkey").agg(F.round(F.avg("rank"), 6).alias("mean_rank"))


@query(
    "w9_w11_neighbour_steps",
    """WITH s AS (SELECT l_orderkey, l_suppkey, line, price, lead(price) OVER (PARTITION BY l_orderkey ORDER BY line, l_suppkey) - price AS step FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS line, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL))
SELECT l_orderkey, count(step) AS n_steps, round(greatest(avg(CASE WHEN step >= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN step <= 0 THEN 1.0 ELSE 0.0 END)), 6) AS monotone FROM s WHERE step IS NOT NULL GROUP BY l_orderkey""",
)
def steps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("line", "l_suppkey")
    s = pairs(spark, d).withColumn("step", F.lead("price").over(w) - F.col("price")).where("step is not null")
    up, down = (F.avg(c.cast("double")) for c in (F.col("step") >= 0, F.col("step") <= 0))
    return s.groupBy("l_orderkey").agg(F.count("step").alias("n_steps"), F.round(F.greatest(up, down), 6).alias("monotone"))


@query(
    "w10_neighbour_accuracy",
    """WITH s AS (SELECT l_orderkey, line, price, lead(line) OVER w AS nl, lead(price) OVER w AS np FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS line, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY line, price))
SELECT l_orderkey, count(*) AS n_pairs, round(avg(CASE WHEN np > price THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s WHERE nl > line GROUP BY l_orderkey""",
)
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbour_accuracy(pairs(spark, d), "line", "price", "l_orderkey").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "w18_differences_and_sums",
    "SELECT event_id, user_id, round(value - lag(value) OVER w, 6) AS step, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def differences(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query(
    "r17_url_assignment",
    """WITH a AS (SELECT l_orderkey, l_returnflag AS dom, l_linenumber * 1000000 + l_suppkey AS place, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber * 1000000 + l_suppkey) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_suppkey FROM lineitem)),
 b AS (SELECT l_orderkey, l_returnflag AS dom, l_partkey AS url, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 4)),
 h AS (SELECT l_orderkey, dom, place, url FROM a JOIN b USING (l_orderkey, dom, n))
SELECT l_orderkey, dom, place, url, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, dom) AS url_rank FROM h""",
)
def urls(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "dom")
    mentions = lines.select("l_orderkey", "dom", "l_linenumber", "l_suppkey").distinct().withColumn("place", F.col("l_linenumber") * 1000000 + F.col("l_suppkey"))
    pool = lines.where("l_linenumber <= 4").select("l_orderkey", "dom", F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("url")).distinct()
    return R.assign_urls(mentions, pool, ["l_orderkey"], "dom", "url")


@query(
    "r18_ablation_delta",
    f"""WITH {PAIRS}, a AS (SELECT l_orderkey, l_suppkey, pre AS ra FROM r WHERE pre <= 3), b AS (SELECT l_orderkey, l_suppkey, post AS rb FROM r WHERE post <= 3)
SELECT l_orderkey, l_suppkey, -(coalesce(rb, 4) - coalesce(ra, 4)) AS delta FROM a FULL JOIN b USING (l_orderkey, l_suppkey)""",
)
def ablation(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked(spark, d)
    keys = ["l_orderkey", "l_suppkey"]
    a, b = rows.where("pre <= 3").select(*keys, F.col("pre").alias("ra")), rows.where("post <= 3").select(*keys, F.col("post").alias("rb"))
    return a.join(b, keys, "full_outer").select(*keys, (-(F.coalesce("rb", F.lit(4)) - F.coalesce("ra", F.lit(4)))).alias("delta"))


@query(
    "r13_order_pairs",
    """WITH v AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS label, l_orderkey FROM lineitem WHERE l_linenumber <= 2),
 s AS (SELECT l_suppkey, label, list_sort(list(l_orderkey)) AS items FROM v GROUP BY ALL)
SELECT a.l_suppkey, a.label AS label_a, b.label AS label_b, len(a.items) AS n_a, len(b.items) AS n_b,
 round(len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items))), 6) AS jaccard FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.label < b.label""",
)
def order_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of all pairs of labels by counting shared items: no set is gathered whole."""
    v = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("label"), "l_orderkey").distinct()
    sizes = v.groupBy("l_suppkey", "label").agg(F.count("*").alias("n"))
    side = lambda s: sizes.select("l_suppkey", F.col("label").alias(f"label_{s}"), F.col("n").alias(f"n_{s}"))
    labels = side("a").join(side("b"), "l_suppkey").where("label_a < label_b")
    shared = v.select("l_suppkey", F.col("label").alias("label_a"), "l_orderkey").join(v.select("l_suppkey", F.col("label").alias("label_b"), "l_orderkey"), ["l_suppkey", "l_orderkey"]).where("label_a < label_b")
    shared = shared.groupBy("l_suppkey", "label_a", "label_b").agg(F.count("*").alias("s"))
    out = labels.join(shared, ["l_suppkey", "label_a", "label_b"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return out.withColumn("jaccard", F.round(F.col("s") / (F.col("n_a") + F.col("n_b") - F.col("s")), 6)).drop("s")


@query(
    "r13_order_pairs_k",
    """WITH v AS (SELECT l_suppkey, l_returnflag || l_linestatus AS label, l_orderkey, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
 s AS (SELECT k, l_suppkey, label, list(l_orderkey) AS items FROM v JOIN (SELECT unnest(range(1, (SELECT max(l_linenumber) + 1 FROM lineitem))) AS k) ON line <= k GROUP BY ALL),
 p AS (SELECT a.k, a.l_suppkey, a.label AS label_a, b.label AS label_b, len(a.items) AS n_a, len(b.items) AS n_b, len(list_intersect(a.items, b.items)) AS n_both FROM s a JOIN s b ON a.k = b.k AND a.l_suppkey = b.l_suppkey AND a.label < b.label)
SELECT *, round(n_both::DOUBLE / (n_a + n_b - n_both), 6) AS jaccard, round(n_both::DOUBLE / k, 6) AS overlap_at_k FROM p""",
)
def order_pairs_k(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of labels at every K, an item counting from its first line on; ``r13_order_pairs`` is K = 2."""
    lines = table(spark, d, "lineitem")
    v = lines.groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("label"), "l_orderkey").agg(F.min("l_linenumber").alias("line"))
    ks = lines.agg(F.explode(F.sequence(F.lit(1), F.max("l_linenumber"))).alias("k"))

    def up_to_k(rows: DataFrame, *by: str) -> DataFrame:
        counts = rows.groupBy(*by, "line").agg(F.count("*").alias("n"))
        return counts.join(F.broadcast(ks), F.col("line") <= F.col("k")).groupBy("k", *by).agg(F.sum("n").alias("n"))

    sizes = up_to_k(v, "l_suppkey", "label")
    side = lambda s: sizes.select("k", "l_suppkey", F.col("label").alias(f"label_{s}"), F.col("n").alias(f"n_{s}"))
    labels = side("a").join(side("b"), ["k", "l_suppkey"]).where("label_a < label_b")
    half = lambda s: v.select("l_suppkey", "l_orderkey", F.col("label").alias(f"label_{s}"), F.col("line").alias(f"line_{s}"))
    shared = half("a").join(half("b"), ["l_suppkey", "l_orderkey"]).where("label_a < label_b").withColumn("line", F.greatest("line_a", "line_b"))
    shared = up_to_k(shared, "l_suppkey", "label_a", "label_b").withColumnRenamed("n", "n_both")
    out = labels.join(shared, ["k", "l_suppkey", "label_a", "label_b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return out.withColumns({"jaccard": F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 6), "overlap_at_k": F.round(F.col("n_both") / F.col("k"), 6)})
