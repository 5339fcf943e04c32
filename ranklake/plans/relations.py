"""Joins, unions, set comparisons and row filters over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query, table

Lines = "SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem"


@query("s3_f3_column_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'A'")
def scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 45 and l_returnflag = 'A'").select("l_orderkey", "l_quantity")


@query("s4_distinct_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey").where("o_custkey is not null").distinct()


@query("f1_f2_complete_cases", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def complete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").na.drop(subset=["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("f4_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def membership(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    customers = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    big = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(customers, "o_custkey", "left_semi").join(big, "o_orderkey", "left_anti").select("o_orderkey")


@query("f5_f6_text_predicates", "SELECT doc_id, starts_with(source, 'src1') AS starts, suffix(source, '5') AS ends, coalesce(contains(text, 'the '), false) OR coalesce(contains(lang, 'e'), false) AS has FROM documents")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    has = F.coalesce(F.col("text").contains("the "), F.lit(False)) | F.coalesce(F.col("lang").contains("e"), F.lit(False))
    return table(spark, d, "documents").select("doc_id", F.col("source").startswith("src1").alias("starts"), F.col("source").endswith("5").alias("ends"), has.alias("has"))


@query("f7_f8_recode_rename", "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' ELSE l_returnflag END AS engine, l_linestatus AS model, count(*) AS n FROM lineitem GROUP BY ALL")
def recode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").replace({"A": "accepted"}, subset=["l_returnflag"]).withColumnsRenamed({"l_returnflag": "engine", "l_linestatus": "model"}).groupBy("engine", "model").agg(F.count("*").alias("n"))


@query("f9_f11_columns", "SELECT doc_id, lang, 0.0::DOUBLE AS conf_missing FROM documents")
def columns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    schema = StructType().add("doc_id", LongType()).add("lang", StringType()).add("conf_missing", DoubleType())
    rows = R.ensure_columns(table(spark, d, "documents").select("lang", "doc_id"), schema, 0.0)
    return R.by_role(rows, ["doc_id"], []).select(*R.unique_columns(["doc_id", "lang", "conf_missing", "doc_id"]))


@query("f12_f13_dummies", "SELECT o_orderkey, (o_orderstatus = 'O')::INT AS cell_o, (o_orderstatus = 'P')::INT AS cell_p FROM orders")
def dummies(spark: SparkSession, d: str) -> DataFrame:
    """0/1 columns of all levels but the first in order."""
    return table(spark, d, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == v).cast("int").alias(f"cell_{v.lower()}") for v in ("O", "P")])


@query("f14_numeric", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("none"))
    return R.numeric(rows, ["k", "none"])


@query("f16_usable_columns", "SELECT 'l_quantity' AS column_name UNION ALL SELECT 'l_discount'")
def usable(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("same", F.lit(1))
    found = R.usable_columns(rows, ["l_quantity", "same", "l_discount"])
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query("f17_policy_filter", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src3', 'src4') GROUP BY source")
def policy(spark: SparkSession, d: str) -> DataFrame:
    blocked = spark.createDataFrame([("src3", False), ("src4", False)], "source string, allowed boolean")
    rows = table(spark, d, "documents").join(F.broadcast(blocked), "source", "left").where(F.coalesce("allowed", F.lit(True)))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("f21_string_predicate", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 0")
def bound(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_nationkey = :nation AND s_acctbal > :least", args={"nation": 7, "least": 0}, supplier=table(spark, d, "supplier"))


_SUPPLIED = "SELECT o_orderkey, l_suppkey, l_partkey, l_quantity, l_linenumber * 1000000 + l_partkey AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(
    "j1_fallback_join",
    """WITH f AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, l_linenumber * 1000000 + l_partkey AS seq FROM lineitem WHERE l_linenumber >= 4),
 x AS (SELECT l_orderkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY seq DESC, l_quantity) AS n FROM f) WHERE n = 1),
 y AS (SELECT l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq, l_quantity) AS n FROM f) WHERE n = 1),
 p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT p.l_orderkey, p.l_suppkey, coalesce(x.l_quantity, y.l_quantity) AS l_quantity,
 CASE WHEN x.l_orderkey IS NOT NULL THEN 'exact' WHEN y.l_orderkey IS NOT NULL THEN 'loose' ELSE 'none' END AS how
FROM p LEFT JOIN x USING (l_orderkey, l_suppkey) LEFT JOIN y ON p.l_orderkey = y.l_orderkey""",
)
def fallback(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    features = lines.where("l_linenumber >= 4").select("l_orderkey", "l_suppkey", "l_quantity", F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), "l_quantity").alias("seq"))
    # of equal places the smaller quantity stands first in both directions
    last = features.withColumn("seq", F.struct(F.col("seq.seq").alias("seq"), F.col("l_quantity").alias("q")))
    return _fallback(lines.select("l_orderkey", "l_suppkey").distinct(), last)


def _fallback(left: DataFrame, features: DataFrame) -> DataFrame:
    exact = features.groupBy("l_orderkey", "l_suppkey").agg(F.max_by(F.col("l_quantity"), F.struct("seq.seq", -F.col("seq.q"))).alias("l_quantity"), F.max_by("seq", F.struct("seq.seq", -F.col("seq.q"))).alias("seq"))
    loose = features.groupBy("l_orderkey").agg(F.min_by(F.struct("l_suppkey", "l_quantity", "seq"), F.struct("seq.seq", "seq.q")).alias("v")).select("l_orderkey", "v.*")
    rows = exact.unionByName(loose).distinct()
    return R.fallback_join(left, rows, ["l_orderkey", "l_suppkey"], ["l_orderkey"], ["l_quantity"], "seq")


@query("j2_join_on_available_keys", "SELECT c_custkey, c_nationkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def available(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey").select("c_nationkey", "n_name", "n_regionkey")
    return R.join_available(table(spark, d, "customer"), nation, ["c_nationkey", "keyword", "url"]).select("c_custkey", "c_nationkey", "c_name", "n_name", "n_regionkey")


@query(
    "j3_three_level_fallback",
    """WITH q AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), s AS (SELECT l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity < 10 GROUP BY ALL)
SELECT l_orderkey, l_suppkey, coalesce(q.q, s.q, n.q) AS q FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) p LEFT JOIN q USING (l_orderkey, l_suppkey) LEFT JOIN s USING (l_suppkey) LEFT JOIN (SELECT s_suppkey AS l_suppkey, s_nationkey::DOUBLE AS q FROM supplier) n USING (l_suppkey)""",
)
def three(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    first = lines.where("l_linenumber = 1").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q0"))
    second = lines.where("l_quantity < 10").groupBy("l_suppkey").agg(F.max("l_quantity").alias("q1"))
    third = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("double").alias("q2"))
    out = lines.select("l_orderkey", "l_suppkey").distinct().join(first, ["l_orderkey", "l_suppkey"], "left").join(second, "l_suppkey", "left").join(third, "l_suppkey", "left")
    return out.select("l_orderkey", "l_suppkey", F.coalesce("q0", "q1", "q2").alias("q"))


@query("j4_replace_columns", "SELECT s_suppkey, s_name, s_nationkey, round(avg(l_quantity), 6) AS s_acctbal FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL")
def replaced(spark: SparkSession, d: str) -> DataFrame:
    lookup = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_quantity"), 6).alias("s_acctbal"))
    return R.replace_columns(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), lookup, ["s_suppkey"], ["s_acctbal"])


_MONTHS = {"a": "l_returnflag = 'A' AND l_quantity > 48", "b": "l_returnflag = 'R' AND l_quantity > 45", "c": "l_quantity > 40"}


@query(
    "j5_j6_outer_backfill",
    "SELECT l_suppkey, coalesce(a.v, b.v, c.v) AS v FROM "
    + " FULL JOIN ".join(f"(SELECT l_suppkey, max(l_partkey) AS v FROM lineitem WHERE {w} GROUP BY ALL) {k}" + (" USING (l_suppkey)" if k != "a" else "") for k, w in _MONTHS.items()),
)
def backfill(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return R.backfilled([lines.where(w).groupBy("l_suppkey").agg(F.max("l_partkey").alias("v")) for w in _MONTHS.values()], ["l_suppkey"], "v")


@query(
    "j7_j21_lookups_at_three_grains",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, o_orderpriority, s_nationkey, p_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""",
)
def lookups(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return lines.join(supplier, "l_suppkey", "left").join(part, "l_partkey", "left").join(orders, "l_orderkey", "left")


@query(
    "j8_fill_join",
    """SELECT doc_id, coalesce(quality, f) AS quality FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE length(lang)::INT END AS quality FROM documents) LEFT JOIN (SELECT doc_id, max(quality)::INT AS f FROM labels GROUP BY doc_id) USING (doc_id)""",
)
def fill(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.char_length("lang")).alias("quality"))
    right = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return R.fill_join(left, right, ["doc_id"], ["quality"])


@query("j9_j10_member_flag", "SELECT o_orderkey, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09))::INT AS selected FROM orders")
def flag(spark: SparkSession, d: str) -> DataFrame:
    keys_ = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.member_flag(table(spark, d, "orders").select("o_orderkey"), keys_, ["o_orderkey"])


@query("j11_group_anti", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R' OR l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)")
def group_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    has = lines.where("l_returnflag = 'R' and l_quantity > 25").select("l_orderkey").distinct()
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    return lines.where("l_returnflag != 'R'").select(*cols).unionByName(lines.where("l_returnflag = 'R'").join(has, "l_orderkey", "left_semi").select(*cols))


_PAIR = "l_suppkey, l_partkey, l_quantity"


@query(
    "j12_j13_variant_pairs",
    f"SELECT l_suppkey, l_partkey, a.l_quantity AS l_quantity_nr, b.l_quantity AS l_quantity_rag FROM (SELECT {_PAIR} FROM lineitem WHERE l_returnflag = 'A') a JOIN (SELECT {_PAIR} FROM lineitem WHERE l_returnflag = 'R') b USING (l_suppkey, l_partkey)",
)
def variants(spark: SparkSession, d: str) -> DataFrame:
    return R.variant_pairs(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_returnflag", "A", "R", ["l_quantity"], ("_nr", "_rag"))


_ROBUST = "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL HAVING count(DISTINCT l_linenumber) = 2"


@query("j14_j15_u9_robust_pairs", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN ({_ROBUST}) USING (l_suppkey, l_partkey)")
def robust(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    found = R.robust_keys(lines, ["l_suppkey", "l_partkey"], "l_linenumber", [1, 2])
    return lines.join(found, ["l_suppkey", "l_partkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("j16_j17_cell_grid", "SELECT n_name, variant, pool FROM nation, (VALUES ('biased'), ('neutral')) v(variant), (VALUES (20), (50)) p(pool)")
def grid(spark: SparkSession, d: str) -> DataFrame:
    """A design is a few values for each factor; only such small frames are crossed."""
    design = spark.createDataFrame([(v, p) for v in ("biased", "neutral") for p in (20, 50)], "variant string, pool int")
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(design))


@query("j20_carry_over", "SELECT o_orderkey, coalesce(m, 'new') AS mode, coalesce(n, 0) AS tries FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_linestatus) AS m, count(*)::INT AS n FROM lineitem WHERE l_quantity > 30 GROUP BY ALL) USING (o_orderkey)")
def carried(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("mode"), F.count("*").cast("int").alias("tries"))
    return R.carry_over(table(spark, d, "orders").select("o_orderkey"), old, ["o_orderkey"], {"mode": "new", "tries": 0})


@query(
    "j22_identity_check",
    """WITH l AS (SELECT doc_id, count(*) AS n, min(lang) AS v FROM documents WHERE doc_id % 7 <> 0 GROUP BY ALL), r AS (SELECT doc_id, count(*) AS n, min(CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END) AS v FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL)
SELECT doc_id, CASE WHEN l.n IS NULL THEN 'missing-left' WHEN r.n IS NULL THEN 'missing-right' WHEN l.n > 1 OR r.n > 1 THEN 'repeated' WHEN l.v IS DISTINCT FROM r.v THEN 'differs' END AS problem FROM l FULL JOIN r USING (doc_id)""",
)
def identity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    return R.checked_one_to_one(docs.where("doc_id % 7 != 0"), other.where("doc_id % 5 != 0"), ["doc_id"], ["lang"])


@query("j26_key_order", "SELECT n_nationkey, n FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY ALL) USING (n_nationkey)")
def aligned(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return R.in_key_order(table(spark, d, "nation").select("n_nationkey"), counts, ["n_nationkey"])


@query("u1_u2_union", "SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier', NULL FROM supplier")
def union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return R.union_all([a, b])


@query("u3_union_common", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def common(spark: SparkSession, d: str) -> DataFrame:
    return R.union_common([table(spark, d, "documents"), table(spark, d, "labels")])


@query(
    "u5_set_sizes",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_a_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_b_only""",
)
def sizes(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return R.set_sizes(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query(
    "u6_u7_gaps",
    """WITH t AS (SELECT c_nationkey, c_custkey FROM customer), g AS (SELECT * FROM t WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM g)
SELECT c_nationkey, count(*) AS n_missing, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey::VARCHAR) FILTER (WHERE n <= 5) AS sample FROM r GROUP BY c_nationkey""",
)
def gaps(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.gap_summary(target.distinct().join(done, "c_custkey", "left_anti"), ["c_nationkey"], "c_custkey")


@query(
    "u8_presence",
    """WITH c AS (SELECT l_suppkey, l_partkey, count_if(l_returnflag = 'A') AS n_A, count_if(l_returnflag = 'N') AS n_N, count_if(l_returnflag = 'R') AS n_R FROM lineitem GROUP BY ALL)
SELECT *, (n_A > 0)::INT AS has_A, (n_N > 0)::INT AS has_N, (n_R > 0)::INT AS has_R, CASE (n_A > 0)::INT + (n_N > 0)::INT + (n_R > 0)::INT WHEN 3 THEN 'all' WHEN 1 THEN 'single' ELSE 'some' END AS coverage FROM c""",
)
def presence(spark: SparkSession, d: str) -> DataFrame:
    return R.presence(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_returnflag", ["A", "N", "R"])


@query("u10_text_dedup", "SELECT doc_id, sha256(text) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    """Only digests travel, not texts."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    best = rows.groupBy("sha").agg(F.min(F.struct("source", "doc_id")).alias("b"))
    return best.select("b.doc_id", "sha")


@query(
    "u12_extension",
    "SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, sha256(text) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1) WHERE n = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
)
def extension(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return R.extend_unseen(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("t1_t2_sort_helpers", "SELECT c_custkey, abs(c_acctbal) AS size FROM customer ORDER BY size DESC, c_custkey")
def by_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("size")).orderBy(F.desc("size"), "c_custkey")


@query("t3_top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
