"""Retrieval, chunking and page features over documents, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import html_features as H
from ..operators import retrieval as R
from .registry import query, table

_TERMS = ("the", "and", "of", "ingn")


@query(
    "h22_bm25",
    f"""WITH t AS (SELECT source, doc_id, string_split(lower(coalesce(text, '')), ' ')[1:5000] AS t FROM documents), s AS (SELECT source, count(*) AS docs, avg(len(t)) AS av FROM t GROUP BY source),
 f AS (SELECT source, term, count(*) AS df FROM (SELECT source, doc_id, unnest(list_distinct(t)) AS term FROM t) GROUP BY ALL), i AS (SELECT f.source, term, ln(docs - df + 0.5) - ln(df + 0.5) AS idf FROM f JOIN s USING (source)),
 m AS (SELECT source, avg(idf) AS mean FROM i GROUP BY source), w AS (SELECT i.source, term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS w FROM i JOIN m USING (source) WHERE term IN {_TERMS}),
 c AS (SELECT t.source, doc_id, w.w, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf, len(t) AS n, av FROM t JOIN s USING (source) JOIN w USING (source))
SELECT t.source, t.doc_id, round(coalesce(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))), 0), 5) AS bm25 FROM t LEFT JOIN c USING (doc_id) GROUP BY ALL""",
)
def bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    queries = docs.select("source").distinct().withColumn("terms", F.array(*[F.lit(t) for t in _TERMS]))
    return R.bm25(docs, queries, "source", "doc_id", "text", "terms").withColumn("bm25", F.round("bm25", 5))


@query(
    "t4_r1_retrieve",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS q_id, label, e AS q FROM e WHERE vec_id % 20 = 0),
 s AS (SELECT q_id, q.label, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) DESC, vec_id) AS n FROM q JOIN e USING (label))
SELECT q_id, label, string_agg('v' || vec_id, ' --- ' ORDER BY n) AS passage FROM s WHERE n <= 3 GROUP BY ALL""",
)
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all vectors of their label."""
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "label", F.col("embedding").alias("q"))
    chunks = rows.select("label", "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), "vec_id")
    return R.retrieve(queries, chunks, ["label"], "q", "embedding", "text", "vec_id")


@query(
    "r1_nearest",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS item, list_dot_product(e.e, q.e) / (sqrt(list_dot_product(e.e, e.e)) * sqrt(list_dot_product(q.e, q.e))) AS c FROM e q, e WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, item) AS place FROM s) SELECT query, item, round(c, 6) AS similarity, place FROM r WHERE place <= 5""",
)
def nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return R.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 6))


@query("h35_h36_chunks")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    return R.chunks(table(spark, d, "documents"), "doc_id", "text")


@query(
    "r2_r3_result_spans",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linenumber || '. ' || l_suppkey || ' | ' || l_partkey AS line FROM lineitem),
 e AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey::VARCHAR, l_partkey::VARCHAR ROWS UNBOUNDED PRECEDING) - 1 AS e FROM r) SELECT l_orderkey, line, e::BIGINT AS "end", (e - length(line))::BIGINT AS start FROM e""",
)
def spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b"))
    return R.result_spans(rows, ["l_orderkey"], "l_linenumber", ["a", "b"]).select("l_orderkey", "line", "start", "end")


@query(
    "r4_r5_rerank",
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_suppkey) AS n FROM f),
 s AS (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY m) AS spare FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_suppkey) AS m FROM f WHERE l_suppkey NOT IN (1, 2)) WHERE m <= 3) GROUP BY ALL),
 a AS (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY l_linenumber DESC, l_suppkey DESC) AS items, count(*) AS size FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN size % 4 = 0 THEN spare ELSE items[1:3] END AS ranked, size % 4 = 0 AS used_fallback FROM a LEFT JOIN s USING (l_orderkey)""",
)
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """A mock ranker turns the list around, and fails on lists whose length divides by four."""

    def mock(prompts):
        lists = prompts.str.split("\n")
        return lists.map(lambda x: "<think>hm</think>" if len(x) % 4 == 0 else "\n".join(f"{i + 1}. {v}" for i, v in enumerate(reversed(x))))

    return R.rerank(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber", 3, mock, "biased", [1, 2])


@query("h1_h21_page_features")
def features(spark: SparkSession, d: str) -> DataFrame:
    return H.page_features(table(spark, d, "pages"), "page_id", "url", "html").drop("body_text", "digest")


@query(
    "h17_h19_link_counts",
    "SELECT page_id, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links, len(regexp_extract_all(html, '<a href=\"/'))::BIGINT AS internal_links, 0::BIGINT AS outbound_links, len(regexp_extract_all(html, '<img'))::BIGINT AS n_images FROM pages",
)
def links(spark: SparkSession, d: str) -> DataFrame:
    return H.page_features(table(spark, d, "pages"), "page_id", "url", "html").select("page_id", "n_links", "internal_links", "outbound_links", "n_images")


@query(
    "h28_h31_mentions",
    """WITH n AS (SELECT n_nationkey, n_name FROM nation WHERE length(n_name) > 3), m AS (SELECT c_custkey, c_name || ' of ' || nn.n_name AS text FROM customer JOIN nation nn ON c_nationkey = nn.n_nationkey)
SELECT c_custkey, n_nationkey FROM m JOIN n ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || lower(n_name) || '($|[^a-z0-9_])')""",
)
def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names of a fixed list, matched in one pass over the texts: tokens join the names, so no pair table arises."""
    nation = table(spark, d, "nation")
    names = nation.where(F.char_length("n_name") > 3).select("n_nationkey", F.lower("n_name").alias("token"))
    customers = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(" ", "c_name", F.lit("of"), "n_name").alias("text"))
    tokens = customers.select("c_custkey", F.explode(F.array_distinct(_grams(F.lower("text")))).alias("token"))
    return tokens.join(F.broadcast(names), "token").select("c_custkey", "n_nationkey").distinct()


def _grams(text):
    """All runs of one to three words."""
    words = F.split(text, r"[^a-z0-9_]+")

    def runs(n: int):
        return F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))

    return F.concat(*[runs(n) for n in (1, 2, 3)])


@query(
    "h29_h30_halo",
    """WITH e AS (SELECT l_orderkey, l_suppkey, max((l_returnflag = 'R')::INT) AS earned, max(l_discount) AS x FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey, sum(earned)::BIGINT AS n_earned FROM e GROUP BY ALL)
SELECT l_orderkey, l_suppkey, (n_earned > 0)::INT AS has_earned, n_earned, CASE WHEN earned = 1 OR n_earned = 0 THEN NULL ELSE (x > 0.05)::INT END AS mentioned FROM e JOIN k USING (l_orderkey)""",
)
def halo(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("earned"), F.max("l_discount").alias("x"))
    e = e.withColumn("n_earned", F.sum("earned").over(Window.partitionBy("l_orderkey")))
    mentioned = F.when((F.col("earned") == 0) & (F.col("n_earned") > 0), (F.col("x") > 0.05).cast("int"))
    return e.select("l_orderkey", "l_suppkey", (F.col("n_earned") > 0).cast("int").alias("has_earned"), "n_earned", mentioned.alias("mentioned"))


@query("h12_h32_source_class", "SELECT page_id, CASE WHEN suffix(host, '.example.com') THEN 'brand' WHEN suffix(host, '.example.net') THEN 'earned' ELSE 'other' END AS source_type FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)")
def source_class(spark: SparkSession, d: str) -> DataFrame:
    """A host's class is that of its first listed parent domain; the list is a small table."""
    listed = spark.createDataFrame([("example.com", "brand"), ("example.net", "earned")], "parent string, kind string")
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    pages = table(spark, d, "pages").select("page_id", F.split(host, r"\.").alias("labels"))
    parents = pages.select("page_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, 99), "."))).alias("place", "parent"))
    hit = parents.join(F.broadcast(listed), "parent", "left").groupBy("page_id").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("place"))).alias("kind"))
    return hit.select("page_id", F.coalesce("kind", F.lit("other")).alias("source_type"))
