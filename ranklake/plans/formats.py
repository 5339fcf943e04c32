"""Sources and sinks: tables are written in a format, read back by the library's reader, and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources import files as S
from ..sources.scratch import folder
from .registry import query, table

_LINES = "l_orderkey, l_linenumber, l_suppkey, l_quantity"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as result pages: an order is a keyword, a flag the engine, a status the pool."""
    lines = table(spark, d, "lineitem")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("keyword"),
        F.col("l_linenumber").cast("int").alias("position"),
        F.concat(F.lit("item "), "l_partkey").alias("title"),
        F.concat(F.lit("https://s"), "l_suppkey", F.lit(".example.com/p")).alias("url"),
        F.lit(None).cast("string").alias("snippet"),
        F.lit("a|b").alias("engines"),
        F.col("l_quantity").cast("double").alias("score"),
        F.lower("l_returnflag").alias("engine"),
        F.when(F.col("l_linestatus") == "F", 10).otherwise(20).alias("pool"),
    )


def _written_pages(spark: SparkSession, d: str) -> str:
    path = folder(spark, "pages")
    S.write_partitioned(_pages(spark, d).repartition("engine", "pool"), path, ["engine", "pool"])
    return path


@query(
    "s1_s22_partitioned_pages",
    """SELECT lower(l_returnflag) AS engine, CASE WHEN l_linestatus = 'F' THEN 10 ELSE 20 END AS pool, count(*) AS n, count(DISTINCT l_orderkey) AS keywords, round(sum(l_quantity), 2) AS score
 FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL""",
)
def partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Pages below engine=/pool= folders; the engine's filter reads its folders alone."""
    rows = S.read_serp(spark, _written_pages(spark, d), engine="a")
    sums = [F.count("*").alias("n"), F.countDistinct("keyword").alias("keywords"), F.round(F.sum("score"), 2).alias("score")]
    return rows.groupBy("engine", F.col("pool").cast("int").alias("pool")).agg(*sums)


@query("s2_s21_main_table", "SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS places FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL")
def main_table(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "main")
    S.write_parquet(_pages(spark, d), path)
    rows = spark.read.parquet(path).where("pool = 10")
    return rows.groupBy(F.col("keyword").cast("long").alias("l_orderkey")).agg(F.count("*").alias("n"), F.sum("position").alias("places"))


@query(
    "s6_r19_rerank_records",
    """WITH f AS (SELECT o_orderkey, o_custkey FROM orders) SELECT 'run-' || (o_custkey % 3) AS run_id, o_orderkey::VARCHAR AS keyword, 'd' || o_custkey AS domain, 2 AS pre_rank, 1 AS post_rank, 1 AS rank_delta FROM f""",
)
def rerank_records(spark: SparkSession, d: str) -> DataFrame:
    """Rerank records as JSON lines, among them broken and blank ones, which the tolerant reader leaves out."""
    path = folder(spark, "rerank")
    domain = F.concat(F.lit("d"), "o_custkey")
    change = F.struct(domain.alias("domain"), F.lit(2).alias("pre_rank"), F.lit(1).alias("post_rank"), F.lit(1).alias("rank_delta"))
    record = F.struct(F.concat(F.lit("run-"), F.col("o_custkey") % 3).alias("run_id"), F.col("o_orderkey").cast("string").alias("keyword"), F.array(change).alias("rank_changes"))
    line = F.explode(F.array(F.to_json(record), F.lit(""), F.lit('{"run_id": "broken')))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return S.rank_change_rows(S.read_rerank(spark, path).where("run_id is not null and size(rank_changes) > 0"))


@query("s7_strict_objects", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def strict_objects(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "objects")
    S.append_jsonl(table(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return S.read_strict_objects(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s10_csv_inferred", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'say \"' || n_name || '\", twice' AS quoted, n_regionkey::BIGINT AS n_regionkey FROM nation")
def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "csv")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit('say "'), "n_name", F.lit('", twice')).alias("quoted"), "n_regionkey")
    rows.write.option("header", True).option("escape", '"').csv(path)
    out = S.read_csv(spark, path)
    return out.select(F.col("n_nationkey").cast("long"), "n_name", "quoted", F.col("n_regionkey").cast("long"))


@query("s11_csv_to_parquet", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY ALL")
def csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    source, target = folder(spark, "csv"), folder(spark, "parquet")
    table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.option("header", True).csv(source)
    S.csv_to_parquet(spark, source, target, "s_suppkey long, s_nationkey long, s_acctbal double")
    return spark.read.parquet(target).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("s12_pages_from_files", "SELECT n_nationkey, 'https://n.example/' || n_name AS url, CASE WHEN n_regionkey <> 0 THEN '<p>' || n_name || '</p>' END AS html FROM nation")
def pages_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Page files found by the digest of their address; nations of one region have none."""
    root = folder(spark, "html")
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("https://n.example/"), "n_name").alias("url"), F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("value"))
    nations.where("n_regionkey <> 0").select(U.page_key(F.col("url")).alias("key"), "value").write.partitionBy("key").option("lineSep", "\u0000").text(root)
    found = S.html_from_files(spark, root, nations.select("n_nationkey", "url"), name=r"key=([^/]+)/")
    return found.select("n_nationkey", "url", F.rtrim(F.replace("html", F.lit("\u0000"), F.lit(""))).alias("html"))


@query("s14_aligned_matrix", "SELECT n_nationkey, (n_nationkey * 2)::DOUBLE AS x, (n_nationkey * 2 + 1)::DOUBLE AS y FROM nation")
def aligned_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A matrix file whose rows belong to keys by place."""
    import io

    import numpy as np

    out = io.BytesIO()
    np.save(out, np.arange(50.0).reshape(25, 2))
    rows = S.aligned_matrix(table(spark, d, "nation").select("n_nationkey"), out.getvalue(), "n_nationkey")
    return rows.select("n_nationkey", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))


@query(
    "s15_s16_s23_vector_shards",
    "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings",
)
def vector_shards(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as compressed NumPy archives in four shards, loaded only if all are there."""
    from ..functions.arrays import norm

    path = folder(spark, "shards")
    S.write_parquet(S.pack_shards(table(spark, d, "embeddings"), "vec_id", "embedding", 4), path)
    rows = S.unpack_shards(S.complete_shards(spark.read.parquet(path), 4))
    return rows.select(F.col("key").alias("vec_id"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(norm(F.col("vector")), 6).alias("length"))


@query("s18_instructions", "SELECT category AS source_category, count(*) AS n, count(*) FILTER (WHERE context) AS with_context FROM (SELECT lang AS category, doc_id % 3 = 0 AS context FROM documents) GROUP BY ALL")
def instructions(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "instructions")
    rows = table(spark, d, "documents").select(F.substring("text", 1, 60).alias("instruction"), F.when(F.col("doc_id") % 3 == 0, "see").otherwise(" ").alias("context"), F.col("lang").alias("category"))
    rows.write.json(path)
    out = S.read_instructions(spark, path)
    flag = next(c for c in out.columns if "context" in c)
    return out.groupBy("source_category").agg(F.count("*").alias("n"), F.count_if(flag).alias("with_context"))


@query("s19_snapshot_sources", "SELECT r_regionkey AS key, r_name AS name, 'json' AS kind FROM region UNION ALL SELECT n_nationkey, n_name, 'tsv' FROM nation")
def snapshot_sources(spark: SparkSession, d: str) -> DataFrame:
    a, b = folder(spark, "json"), folder(spark, "tsv")
    table(spark, d, "region").selectExpr("r_regionkey AS key", "r_name AS name", "'json' AS kind").write.json(a)
    table(spark, d, "nation").selectExpr("n_nationkey AS key", "n_name AS name", "'tsv' AS kind").write.option("sep", "\t").option("header", True).csv(b)
    return S.read_snapshots(spark, a, b, "key long, name string, kind string")


@query("s20_c46_questions", "SELECT n_nationkey AS question_id, n_name || ' & \"co\" <3' AS title FROM nation WHERE n_regionkey <> 0")
def questions(spark: SparkSession, d: str) -> DataFrame:
    """A payload of questions with escaped titles; those without a link are left out."""
    path = folder(spark, "questions")
    title = F.concat("n_name", F.lit(" &amp; &quot;co&quot; &lt;3"))
    item = F.struct(F.col("n_nationkey").alias("question_id"), title.alias("title"), F.when(F.col("n_regionkey") != 0, "https://q").alias("link"))
    nations = table(spark, d, "nation")
    nations.select(item.alias("i")).groupBy().agg(F.collect_list("i").alias("items")).coalesce(1).write.json(path)  # 25 nations
    return S.read_questions(spark, path, "p").select("question_id", "title")


@query("s24_s25_appended", f"SELECT {_LINES}, kind FROM lineitem, (VALUES ('csv'), ('json')) AS k(kind)")
def appended(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to a CSV folder and two to JSON lines; both hold all rows after them."""
    a, b = folder(spark, "csv"), folder(spark, "json")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    for status in ("l_linenumber <= 3", "l_linenumber > 3"):
        S.append_csv(lines.where(status), a)
        S.append_jsonl(lines.where(status), b)
    schema = lines.schema
    rows = S.read_csv(spark, a, schema).withColumn("kind", F.lit("csv"))
    return rows.unionByName(spark.read.schema(schema).json(b).withColumn("kind", F.lit("json")))


@query("s26_atomic_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def atomic(spark: SparkSession, d: str) -> DataFrame:
    """A table that is written twice: the second commit replaces the first as a whole."""
    path = folder(spark, "atomic")
    orders = table(spark, d, "orders")
    S.write_parquet(orders.limit(1), path)
    S.write_parquet(orders.select("o_orderkey", "o_orderstatus"), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "s27_component_files",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'serp' WHEN 2 THEN 'rag' END AS component FROM part""",
)
def component_files(spark: SparkSession, d: str) -> DataFrame:
    """The component that each file of a listing belongs to."""
    key = F.col("p_partkey")
    path = F.when(key % 4 == 0, F.concat(F.lit("main/"), key, F.lit(".parquet"))).when(key % 4 == 1, F.concat(F.lit("serp/e/p/"), key, F.lit(".parquet")))
    path = path.when(key % 4 == 2, F.concat(F.lit("rag/chunks/"), key, F.lit(".parquet"))).otherwise(F.concat(F.lit("docs/"), key, F.lit(".md")))
    return table(spark, d, "part").select("p_partkey", S.component_of(path).alias("component"))


@query(
    "s30_table_dictionary",
    "SELECT c.col AS \"column\", c.type AS type, count(x) AS n, count(DISTINCT x) AS n_distinct FROM (SELECT unnest(['l_returnflag', 'l_linestatus']) AS col, unnest([l_returnflag, l_linestatus]) AS x, 'string' AS type FROM lineitem) c GROUP BY ALL",
)
def table_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of documented columns with what the table holds of each."""
    lines = table(spark, d, "lineitem")
    said = S.dictionary(spark, [("l_returnflag", "string", "cell", "flag"), ("l_linestatus", "string", "cell", "status")])
    held = lines.select(F.explode(F.map_from_arrays(F.array(F.lit("l_returnflag"), F.lit("l_linestatus")), F.array("l_returnflag", "l_linestatus"))).alias("column", "x"))
    counts = held.groupBy("column").agg(F.count("x").alias("n"), F.countDistinct("x").alias("n_distinct"))
    return said.join(counts, "column").select("column", "type", "n", "n_distinct")


@query(
    "u4_c6_run_folders",
    "SELECT 'ddg_m' || (l_linenumber % 2) || '_pool10_top3' AS run_id, 'ddg' AS engine, 10 AS pool, 3 AS top_n, count(*) AS n FROM lineitem GROUP BY ALL",
)
def run_folders(spark: SparkSession, d: str) -> DataFrame:
    """CSV files below folders named by their run; the folder's name gives run, engine, pool and size."""
    root = folder(spark, "runs")
    lines = table(spark, d, "lineitem")
    for i in (0, 1):
        lines.where(F.col("l_linenumber") % 2 == i).select("l_orderkey", "l_linenumber").write.option("header", True).csv(f"{root}/ddg_m{i}_pool10_top3")
    rows = S.read_run_folders(spark, root, "l_orderkey long, l_linenumber int")
    return rows.groupBy("run_id", "engine", "pool", "top_n").agg(F.count("*").alias("n"))
