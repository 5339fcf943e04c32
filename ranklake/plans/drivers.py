"""Whole stages as queries: unions with dictionaries, metric merges, reports, manifests and batteries of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stages as St
from ..sources.scratch import folder
from .registry import query, table
from .vectors import vectors

_DESCRIBED = ("l_quantity", "l_linenumber", "s_acctbal", "run_id")


@query(
    "z5_unified_dictionary",
    """WITH w AS (SELECT l_quantity, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'old' ELSE 'new' END AS run_id, s_acctbal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey)
"""
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(count({c}) / count(*), 6) AS share FROM w" for c in _DESCRIBED),
)
def unified_dictionary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_linenumber", "l_linestatus")
    runs = {n: lines.where(F.col("l_linestatus") == s).drop("l_linestatus") for n, s in (("old", "F"), ("new", "O"))}
    features = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return St.dictionary_stage(runs, features, ["l_suppkey"], _DESCRIBED)[1].drop("type")


@query(
    "z7_metric_merge",
    """SELECT l_returnflag, count(*) AS n, count(o_totalprice) AS with_order, count(p.q) AS with_pair, count(s_acctbal) AS with_supplier, round(sum(s_acctbal), 2) AS total FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey
 LEFT JOIN (SELECT l_orderkey, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) p USING (l_orderkey, l_suppkey) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def metric_merge(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    by_key = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    by_pair = lines.where("l_quantity > 25").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    by_domain = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    out = St.metric_stage(lines, by_key, by_pair, by_domain, "l_orderkey", "l_suppkey")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("with_order"), F.count("q").alias("with_pair"), F.count("s_acctbal").alias("with_supplier"), F.round(F.sum("s_acctbal"), 2).alias("total"))


def _section(section: str, value: str, source: str) -> str:
    return f"""SELECT '{section}' AS section, {value} AS value, count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 5) AS mean_a,
 round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 5) AS mean_b, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F') - avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 5) AS delta FROM {source} GROUP BY ALL"""


@query(
    "z8_variant_report",
    " UNION ALL ".join(
        [
            _section("all", "''", "lineitem"),
            _section("flag", "l_returnflag", "lineitem"),
            _section("flag and mode", "l_returnflag || '|' || l_linenumber", "lineitem"),
            _section("shared keys", "''", "(SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linestatus) = 2))"),
        ]
    ),
)
def variant_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag", "l_linenumber", "l_quantity")
    out = St.variant_report(lines, "l_linestatus", "F", "O", ["l_partkey"], {"flag": ["l_returnflag"], "flag and mode": ["l_returnflag", "l_linenumber"]}, "l_quantity")
    return out.select("section", "value", "n_a", "n_b", *[F.round(c, 5).alias(c) for c in ("mean_a", "mean_b", "delta")])


_COLS = ("l_quantity", "l_extendedprice", "l_tax")
_LONG = ["SELECT 'size' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM lineitem", "SELECT 'size', 'cells', count(*)::DOUBLE FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)"]
_LONG += [f"SELECT 'coverage', '{c}', count({c}) / count(*) FROM lineitem UNION ALL SELECT 'mean', '{c}', round(avg({c}), 5) FROM lineitem UNION ALL SELECT 'deviation', '{c}', round(stddev_samp({c}), 5) FROM lineitem" for c in _COLS]
_LONG += [f"SELECT 'correlation', '{y}~l_tax', round(corr({y}, l_tax), 5) FROM lineitem UNION ALL SELECT 'spread', '{y}', round(max(m) - min(m), 5) FROM (SELECT avg({y}) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus)" for y in _COLS[:2]]


@query("z9_analysis_report", " UNION ALL ".join(_LONG))
def analysis_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    out = St.analysis_report(lines, ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"], ["l_tax"])
    return out.withColumn("value", F.round("value", 5))


@query("z10_reviewer_tables", "SELECT l_returnflag, l_linenumber, printf('%.3f (%.3f)', avg(l_quantity), stddev_samp(l_quantity)) AS shown, count(l_quantity) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def reviewer_tables(spark: SparkSession, d: str) -> DataFrame:
    return St.reviewer_tables(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity").where("n > 1")


@query("z13_consolidated", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("nation", "orders", "supplier")))
def consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Tables copied below one folder, twice: the second run keeps what is there."""
    root = folder(spark, "consolidated")
    tables = {t: table(spark, d, t) for t in ("nation", "orders", "supplier")}
    St.consolidated(tables, root)
    return St.consolidated({t: df.limit(0) for t, df in tables.items()}, root).select("table", "rows")


@query("z12_inventory", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("customer", "part", "events")))
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return St.inventory({t: table(spark, d, t) for t in ("customer", "part", "events")}).select("table", "rows")


@query("z4_z6_union_gaps", "SELECT coverage, count(*) AS n FROM (SELECT l_orderkey, CASE count(DISTINCT l_linestatus) WHEN 2 THEN 'all' ELSE 'single' END AS coverage FROM lineitem GROUP BY l_orderkey) GROUP BY coverage")
def union_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The union of two variants' runs, and how many keys both hold."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    runs = {n: lines.where(F.col("l_linestatus") == s).drop("l_linestatus") for n, s in (("old", "F"), ("new", "O"))}
    return St.union_stage(runs, ["l_orderkey"])[1].groupBy("coverage").agg(F.count("*").alias("n"))


@query("e8_e35_robustness_battery")
def battery(spark: SparkSession, d: str) -> DataFrame:
    out = St.robustness_battery(vectors(spark, d), "vec_id", "label", "embedding", "bend")
    return out.withColumn("value", F.round("value", 6))


@query("e4_ordinal_levels")
def ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Proportional odds of an order's priority on two numbers, over counts of equal rows: at most 5 x 7 x 8 of them reach
    the driver."""
    import numpy as np

    from ..operators import latent as La

    lines = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("a"), F.floor(F.col("l_quantity") / 10).cast("double").alias("b"), F.least(F.floor(F.col("l_discount") * 100 / 4), F.lit(2)).cast("int").alias("y"))
    counts = lines.groupBy("a", "b", "y").count().orderBy("a", "b", "y").toPandas()
    w, cuts = La.ordinal_fit(counts[["a", "b"]].to_numpy(), counts["y"].to_numpy(), counts["count"].to_numpy(float))
    return spark.createDataFrame([*[(f"weight {n}", round(float(v), 4)) for n, v in zip("ab", np.atleast_1d(w), strict=True)], *[(f"cut {i}", round(float(v), 4)) for i, v in enumerate(cuts)]], "name string, value double")


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Result lists of orders whose results are their suppliers' pages, and the pages; every third supplier has none."""
    from .pages import built_pages

    url = lambda k: F.concat(F.lit("https://s"), k, F.lit(".example/home"))
    lines = table(spark, d, "lineitem")
    serp = lines.select(F.concat(F.lit("shop "), "l_suppkey").alias("keyword"), F.col("l_linenumber").alias("position"), F.concat(F.lit("Shop "), "l_suppkey").alias("title"), url(F.col("l_suppkey")).alias("url")).distinct()
    pages = built_pages(spark, d).withColumn("url", url(F.col("s_suppkey"))).withColumn("html", F.when(F.col("s_suppkey") % 3 != 0, F.col("html")))
    return serp, pages.select("url", "html")


@query(
    "z1_feature_stage",
    """WITH s AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) SELECT l_suppkey % 3 <> 0 AS html_present, count(*) AS n, count(CASE WHEN l_suppkey % 3 <> 0 THEN 1 END) AS n_words, sum(CASE WHEN l_suppkey % 3 <> 0 THEN 1 END)::BIGINT AS with_stats,
 count_if(l_suppkey % 3 <> 0 AND l_suppkey % 4 IN (0, 1)) AS structured, count(*) AS titled FROM s GROUP BY ALL""",
)
def feature_stage(spark: SparkSession, d: str) -> DataFrame:
    rows = St.feature_stage(*_pool(spark, d))
    return rows.groupBy("html_present").agg(F.count("*").alias("n"), F.count("conf_word_count").alias("n_words"), F.sum("treat_stats_present").alias("with_stats"), F.count_if("structured").alias("structured"), F.sum("conf_title_kw").alias("titled"))


@query(
    "z2_merge_stage",
    """SELECT o_orderkey::VARCHAR AS keyword, 'd' || o_custkey AS domain, CASE WHEN o_custkey % 2 = 0 THEN 'u' || o_custkey ELSE '' END AS url, 3 AS pre_rank, 1 AS post_rank, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'P'""",
)
def merge_stage(spark: SparkSession, d: str) -> DataFrame:
    """Rerank records joined to the features of their page, or where the page is not known, of their domain."""
    orders = table(spark, d, "orders")
    domain, url = F.concat(F.lit("d"), "o_custkey"), F.concat(F.lit("u"), "o_custkey")
    change = F.struct(domain.alias("domain"), F.lit(3).alias("pre_rank"), F.lit(1).alias("post_rank"), F.lit(2).alias("rank_delta"))
    result = F.struct(domain.alias("domain"), F.when(F.col("o_custkey") % 2 == 0, url).otherwise("").alias("url"))
    records = orders.select(F.lit("r").alias("run_id"), F.col("o_orderkey").cast("string").alias("keyword"), F.lit(False).alias("used_fallback"), F.when(F.col("o_orderstatus") == "P", "broken").alias("error"), F.array(change).alias("rank_changes"), F.array(result).alias("ranked_results"))
    features = orders.select(F.col("o_orderkey").cast("string").alias("keyword"), url.alias("url"), domain.alias("domain"), F.lit(1).alias("position"), F.col("o_totalprice").alias("score"))
    return St.merge_stage(records, features, ["score"]).select("keyword", "domain", "url", "pre_rank", "post_rank", "score")


@query(
    "z3_index_stage",
    """WITH t AS (SELECT s_suppkey, ['Prices', 'How to buy', 'Ready?', 'Island tours', 'what else'][s_suppkey % 5 + 1] || ' Terms Made on 2021-06-01, sold 1,234 times.' AS text FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT 'https://s' || s_suppkey || '.example/home' AS url, 0 AS chunk_idx, text, [length(text)::DOUBLE, (length(text) - length(replace(text, 'e', '')))::DOUBLE] AS embedding FROM t""",
)
def index_stage(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of pages with vectors; the embedder here gives lengths."""
    embed = lambda t: F.array(F.char_length(t).cast("double"), F.char_length(F.regexp_replace(t, "[^e]", "")).cast("double"))
    return St.index_stage(_pool(spark, d)[1], embed, least=20)


@query(
    "z11_report_tables",
    """WITH f AS (SELECT l_returnflag AS outcome, l_linestatus AS treatment, l_linenumber::VARCHAR AS slice, avg(l_discount) AS coef, avg(l_tax) AS p_val FROM lineitem GROUP BY ALL) SELECT outcome, round(avg((p_val < 0.04)::INT), 6) AS share_clear, count(*) AS n FROM f GROUP BY outcome""",
)
def report_tables(spark: SparkSession, d: str) -> DataFrame:
    fits = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("outcome"), F.col("l_linestatus").alias("treatment"), F.col("l_linenumber").cast("string").alias("slice")).agg(F.avg("l_discount").alias("coef"), F.avg("l_tax").alias("p_val"), F.avg("l_quantity").alias("t_stat"))
    return St.report_tables(fits, 0.04)["share"].withColumn("share_clear", F.round("share_clear", 6))
