"""Address, text, date, array and vector expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import measures as M
from ..functions import texts as T
from ..functions import urls as U
from .registry import query, table

_HOST = "regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\\.', '')"


@query(
    "c1_c5_domains",
    f"""SELECT page_id, {_HOST} AS domain, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS registrable, string_split({_HOST}, '.')[-1] AS suffix, regexp_replace(regexp_extract(url, '^(?:[a-z]+://)?([^/]+)', 1), '^[w.]+', '') AS stripped FROM pages""",
)
def domains(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    host = U.domain_of(url)
    return table(spark, d, "pages").select("page_id", host.alias("domain"), U.registrable(host).alias("registrable"), U.link_suffix(U.link_host(url)).alias("suffix"), U.stripped_host(url).alias("stripped"))


@query("s13_c16_page_key", "SELECT page_id, left(sha256(url), 16) || '.html' AS key, 'p:' || left(sha256(page_id::VARCHAR || ':' || url), 24) AS id FROM pages")
def page_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.page_key(F.col("url")).alias("key"), T.sha(F.col("page_id"), F.col("url"), length=24, prefix="p:").alias("id"))


_RUN = "lower(l_returnflag) || 'ddg_org/Model-' || l_linestatus || '_pool' || (l_linenumber * 10) || '_top' || l_linenumber || CASE WHEN l_linenumber > 3 THEN '_biased_rag' ELSE '' END"


@query(
    "c6_c8_run_parts",
    f"""SELECT DISTINCT run_id, regexp_extract(run_id, '^([a-z0-9]+)_', 1) AS engine, regexp_extract(run_id, '_(org/Model-.)_', 1) AS model, regexp_extract(run_id, '_pool(\\d+)_', 1)::INT AS pool, regexp_extract(run_id, '_top(\\d+)', 1)::INT AS top_n, nullif(regexp_extract(run_id, '_top\\d+_(.+)$', 1), '') AS variant, regexp_extract(run_id, '/(Model-.)_', 1) AS short FROM (SELECT {_RUN} AS run_id FROM lineitem)""",
)
def run_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    run = F.concat(F.lower("l_returnflag"), F.lit("ddg_org/Model-"), F.col("l_linestatus"), F.lit("_pool"), (F.col("l_linenumber") * 10).cast("string"), F.lit("_top"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") > 3, "_biased_rag").otherwise(""))
    rows = lines.select(run.alias("run_id")).distinct()
    parts = U.run_parts(F.col("run_id"))
    return rows.select("run_id", *[c.alias(n) for n, c in parts.items()], U.short_model(parts["model"]).alias("short"))


@query(
    "c9_c11_c15_normalise",
    """SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 40) AS short, translate(left(text, 60), '[]', '()') AS neutral FROM conversations""",
)
def normalise(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.collapse(text).alias("clean"), T.truncate(T.collapse(text), 40).alias("short"), T.neutral_brackets(T.truncate(text, 60)).alias("neutral"))


@query(
    "c12_ranked_lines",
    """SELECT l_orderkey, list_filter(list_transform(string_split(out, chr(10)), lambda x: lower(trim(regexp_replace(x, '^\\s*(?:[-*•]|\\d+[.):])\\s*', '')))), lambda x: x <> '') AS items FROM (SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || '. Supplier#' || l_suppkey ELSE '- S' || l_suppkey END, chr(10) ORDER BY l_linenumber, l_suppkey, l_partkey) AS out FROM lineitem GROUP BY ALL)""",
)
def ranked_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit(". Supplier#"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("- S"), F.col("l_suppkey").cast("string")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", line.alias("line")))).alias("rows"))
    answer = F.concat(F.lit("<think>\n1. nothing\n</think>"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return rows.select("l_orderkey", T.ranked_lines(answer).alias("items"))


@query(
    "c14_permutation",
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'C002 C001 C003' WHEN 1 THEN 'C001, C001, C002' WHEN 2 THEN 'C003>C001>C002' ELSE 'C004 C001 C002' END AS out FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 2) THEN regexp_extract_all(out, 'C\\d{3}') END AS tokens FROM o""",
)
def permutation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    out = F.when(k == 0, "C002 C001 C003").when(k == 1, "C001, C001, C002").when(k == 2, "C003>C001>C002").otherwise("C004 C001 C002")
    return table(spark, d, "orders").select("o_orderkey", T.permutation(out, F.lit(3)).alias("tokens"))


@query("c25_c27_map_lookup", "SELECT c_custkey, coalesce(n_name, '') AS nation, c_name || ' --- ' || coalesce(n_name, '') AS joined FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    """A map of the nation table, a fixed table of 25 rows."""
    pairs = table(spark, d, "nation").where("n_nationkey < 20").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")))).alias("pairs"))
    m = pairs.select(A.first_wins_map(F.col("pairs")).alias("m"))
    out = table(spark, d, "customer").crossJoin(F.broadcast(m)).withColumn("nation", A.lookup(F.col("m"), F.col("c_nationkey"), F.lit("")))
    return out.select("c_custkey", "nation", F.array_join(F.array("c_name", "nation"), " --- ").alias("joined"))


@query(
    "c28_c30_dates",
    """WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS t, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS days FROM orders)
SELECT o_orderkey, t::DATE::VARCHAR AS day, CASE WHEN days <= 180 THEN 4 WHEN days <= 365 THEN 3 WHEN days <= 730 THEN 2 WHEN days <= 1825 THEN 1 ELSE 0 END AS bucket, round((epoch(TIMESTAMP '1998-08-02') - epoch(t)) / 86400.0, 6) AS age_days FROM o""",
)
def dates(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("text", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    t, now = M.parse_date(F.col("text")), F.lit("1998-08-02").cast("timestamp")
    return orders.select("o_orderkey", F.to_date(t).cast("string").alias("day"), M.age_bucket(t, now).alias("bucket"), F.round((F.unix_timestamp(now) - F.unix_timestamp(t)) / 86400.0, 6).alias("age_days"))


@query(
    "c31_c34_numbers",
    "SELECT c_custkey, round(log10(greatest(c_acctbal, 0) + 1), 6) AS authority, (c_acctbal >= 100000 OR c_custkey >= 500)::INT AS brand, least(round(c_acctbal / 5000, 6), 1.0) AS clipped, round_even(c_custkey / 8.0, 1) AS even FROM customer",
)
def numbers(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(M.authority_log(F.greatest(balance, F.lit(0.0))), 6).alias("authority"), M.brand_proxy(balance, F.col("c_custkey")).alias("brand"), F.least(F.round(balance / 5000, 6), F.lit(1.0)).alias("clipped"), F.bround((F.col("c_custkey") / 8.0).cast("decimal(20,4)"), 1).cast("double").alias("even"))


@query(
    "c35_c39_labels",
    """SELECT s_suppkey, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS dotted,
 CASE WHEN s_suppkey % 3 = 0 THEN 'api' WHEN s_suppkey % 3 = 1 THEN 'bf16' ELSE 'int4' END AS precision, (s_nationkey = 3)::INT::DOUBLE AS intent_3, (s_nationkey = 7)::INT::DOUBLE AS intent_7 FROM (SELECT *, s_suppkey / 1000.0 AS p FROM supplier)""",
)
def labels(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("s_suppkey") / 1000.0, F.col("s_suppkey") % 3
    backend = F.when(k == 0, "api").otherwise("local")
    precision = F.when(k == 1, "bfloat16").otherwise("nf4")
    return table(spark, d, "supplier").select("s_suppkey", M.stars(p).alias("stars"), M.stars(p, "dotted").alias("dotted"), M.precision_label(backend, precision).alias("precision"), *M.one_hot(F.col("s_nationkey").cast("string"), ("3", "7"), "intent_"))


_ERF = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x))"


@query(
    "c44_c45_p_values",
    f"""WITH z AS (SELECT c_custkey, c_acctbal / 2000.0 AS z FROM customer), x AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z)
SELECT c_custkey, round({_ERF}, 6) AS p, round(z - 1.96 * 0.5, 6) AS low, round(z + 1.96 * 0.5, 6) AS high FROM x""",
)
def p_values(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("c_acctbal") / 2000.0
    low, high = M.interval(z, F.lit(0.5))
    return table(spark, d, "customer").select("c_custkey", F.round(M.normal_tail(z), 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "c40_c43_vectors",
    """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM a WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS cosine, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(1 / (1 + exp(-e[1])), 6) AS squashed, round(e[2] / sqrt(list_dot_product(e, e)), 6) AS unit_2 FROM a, q""",
)
def vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    e = F.col("embedding")
    return rows.crossJoin(F.broadcast(q)).select("vec_id", F.round(A.cosine(e, F.col("q")), 6).alias("cosine"), F.round(A.norm(e), 6).alias("norm"), F.round(A.sigmoid(F.get("embedding", F.lit(0)).cast("double")), 6).alias("squashed"), F.round(F.get(A.unit(e), F.lit(1)), 6).alias("unit_2"))


@query("c17_sorted_json", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS digest FROM nation")
def sorted_json(spark: SparkSession, d: str) -> DataFrame:
    """The canonical text of an object is written with its keys in order and without spaces."""
    text = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    return table(spark, d, "nation").select("n_nationkey", F.sha2(text, 256).alias("digest"))


@query("c50_token_tags", "SELECT token, list_filter([CASE WHEN regexp_matches(token, '^\\d[\\d,.]*$') THEN 'number' END, CASE WHEN regexp_matches(token, '^\\d+(?:\\.\\d+)?%$') THEN 'percent' END, CASE WHEN regexp_matches(token, '^(?:19|20)\\d{2}$') THEN 'year' END, CASE WHEN regexp_matches(token, '^[$€£]\\d') THEN 'money' END], lambda x: x IS NOT NULL) AS tags, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM conversations) GROUP BY token)")
def token_tags(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", T.token_tags(F.col("token")).alias("tags"), "n")
