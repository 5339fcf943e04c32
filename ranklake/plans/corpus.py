"""Text operators over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as T
from .registry import query, table

_CLEAN = "trim(regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_WORDS = "len(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'))"


@query("u11_normalised_dedup", "SELECT key_sha, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key_sha FROM documents) GROUP BY key_sha")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(T.dedup_key(F.col("text")), 256)
    return table(spark, d, "documents").select("doc_id", key.alias("key_sha")).groupBy("key_sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("f18_eligible", f"SELECT doc_id, {_WORDS.format(c='text')}::BIGINT AS n_words, {_WORDS.format(c='text')} BETWEEN 3 AND 100 AS eligible FROM documents")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.regex_words(F.col("text")).cast("long").alias("n_words"), T.eligible(F.col("text")).alias("eligible"))


@query(
    "f19_rejection_reason",
    f"""WITH t AS (SELECT conv_id, turn, {_CLEAN.format(c='text')} AS t FROM conversations), m AS (SELECT *, {_WORDS.format(c='t')} AS n, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM t)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN n < 3 THEN 'too-short' WHEN n > 100 THEN 'too-long' WHEN regexp_matches(t, 'https?://|www\\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]') THEN 'external-identifier'
 WHEN regexp_matches(t, '```|</\\w+>|\\bdef \\w+\\(|\\bfunction\\s*\\(|\\{{\\s*"|;\\s*$') THEN 'code' WHEN letters = 0 OR latin / letters < 0.8 THEN 'non-english' END AS reason FROM m""",
)
def rejection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.rejection_reason(F.col("text")).alias("reason"))


@query("f20_year_share", "SELECT toxic, " + ", ".join(f"round(avg(contains(text, '{y}')::INT), 6) AS y{y}" for y in (2019, 2020, 2021)) + " FROM documents JOIN labels USING (doc_id) GROUP BY toxic")
def years(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("toxic").agg(*[F.round(F.avg(F.col("text").contains(str(y)).cast("int")), 6).alias(f"y{y}") for y in (2019, 2020, 2021)])


_STATS = [p.replace("'", "''") for p in T.STAT_PATTERNS]


@query(
    "h4_h5_h15_stats",
    f"""WITH t AS (SELECT doc_id, text, {_CLEAN.format(c='text')} AS c FROM documents), w AS (SELECT *, CASE WHEN c <> '' THEN len(string_split(c, ' ')) END AS n FROM t)
SELECT doc_id, n::BIGINT AS n_words, {" OR ".join(f"regexp_matches(text, '{p}')" for p in _STATS)} AS has_stats,
 round(len(list_distinct({" || ".join(f"regexp_extract_all(text, '{p}')" for p in _STATS)})) / (n / 500.0) + 1e-9, 2) AS density FROM w""",
)
def stats(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    found = T.stats_density(text)
    return table(spark, d, "documents").select("doc_id", T.word_count(text).cast("long").alias("n_words"), T.has_stats(text).alias("has_stats"), found.alias("density"))


@query(
    "h13_h14_h20_page_flags",
    """WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(split_part(url, '://', 2), '.', 1) AS host FROM pages)
SELECT page_id, starts_with(lower(url), 'https://') AS is_https, title, length(host) >= 3 AND contains(lower(title), host) AS title_has_host FROM p""",
)
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    host = F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("."), F.lit(1))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.lower(url).startswith("https://").alias("is_https"), title.alias("title"), T.title_has_keyword(title, host).alias("title_has_host"))


@query(
    "h33_surface_features",
    f"""WITH t AS (SELECT conv_id, turn, {_CLEAN.format(c='text')} AS t FROM conversations), f AS (SELECT *, regexp_extract(lower(t), '^[^a-z]*([a-z]+)', 1) AS opening, {_WORDS.format(c='t')} AS n, len(regexp_extract_all(t, '[,;:]')) + 1 AS c FROM t)
SELECT conv_id, turn, opening, CASE WHEN suffix(t, '?') OR opening IN ({", ".join(f"'{w}'" for w in T.QUESTION_WORDS)}) THEN 'question' WHEN opening IN ('write', 'give', 'list', 'make', 'explain', 'describe', 'tell', 'find', 'show') THEN 'command' ELSE 'statement' END AS form,
 CASE WHEN n <= 12 THEN 'short' WHEN n <= 30 THEN 'medium' ELSE 'long' END AS length_band, CASE WHEN c <= 1 THEN 'one' WHEN c <= 3 THEN 'few' ELSE 'many' END AS clause_band FROM f""",
)
def surface(spark: SparkSession, d: str) -> DataFrame:
    s = T.surface(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", *[s[c].alias(c) for c in ("opening", "form", "length_band", "clause_band")])


@query("c47_c49_ablation", "SELECT page_id, trim(regexp_replace(regexp_replace(title, '\\d+', ' ', 'g'), '\\s+', ' ', 'g')) AS without_numbers FROM (SELECT page_id, url AS title FROM pages)")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.ablate(F.col("url"), r"\d+").alias("without_numbers"))


@query("c49_keyword_strip", "SELECT n_nationkey, trim(regexp_replace(regexp_replace('offers from ' || n_name || ' and more', '(?i)\\b' || n_name || '\\b', '', 'g'), '\\s+', ' ', 'g')) AS text FROM nation")
def strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.strip_keyword(F.concat(F.lit("offers from "), F.col("n_name"), F.lit(" and more")), F.col("n_name")).alias("text"))


@query("s17_human_turns", "SELECT conv_id, text, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id, text")
def human_turns(spark: SparkSession, d: str) -> DataFrame:
    """Different user turns of each dialogue with their first place."""
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))


@query("p19_keyword_filter", "SELECT DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS keyword FROM conversations WHERE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) BETWEEN 2 AND 8 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 80")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    t = T.collapse(F.col("text"))
    return table(spark, d, "conversations").where(T.word_count(F.col("text")).between(2, 8) & (F.char_length(t) < 80)).select(F.lower(t).alias("keyword")).distinct()
