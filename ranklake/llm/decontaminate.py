"""Benchmark decontamination by winnowing (operator 4), in DataFrame functions only.

Words are runs of letters, digits and all characters beyond ASCII, with A-Z in
lower case. A window is ``SPAN`` consecutive words of an item; an item of fewer
words is one window. A document word inside any occurrence of a window is hit.

Plan: each run of ``REACH`` consecutive ``GRAM``-word hashes gives its minimum, so
every span of SPAN words has one fingerprint, the same wherever the span stands.
Document fingerprints (one for each run of windows with one minimum) join those of
the benchmark; the words of the few runs that hit go on in the same stage, their
windows are compared as text, and only hits move, grouped by their text's 128-bit
digest. Items under SPAN words are found at the places of their first words.

The benchmark's tables are broadcast only if their counted bytes are within
``broadcast_bytes``. Beyond that, fingerprints meet in shuffled joins, and only texts
with a hit move to be extended. The same bound holds for the table of hit texts that
is joined back; texts themselves never move for it unless that bound is passed.

Defined cases: null texts have no words; null and repeated doc_ids keep their own
rows; an item without words has no window; a null item_id counts as the text "";
empty tables give no hits or no rows; other columns pass through untouched, but for
those named like a result column, which the result replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import BROADCAST_BYTES, sized, small, written

SPAN, GRAM = 13, 5
REACH = SPAN - GRAM + 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "n_hit", "item_ids", "n_items", "contaminated")


def word_list(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def text_key(text: Column) -> Column:
    """The 128-bit digest by which rows of one text share their hits."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _at(array: str, place: Column, offset: int) -> Column:
    return F.get(F.col(array), place + offset)


def _places(size: Column, span: Column | int) -> Column:
    """0 .. size - span, or none."""
    return F.when(size >= span, F.sequence(F.lit(0), F.greatest(size - span, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _runs(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, words, start, stop, mark): the runs start .. stop - 1 of windows that share one minimum."""
    size = F.size("words")
    df = df.withColumn("grams", F.transform(_places(size, GRAM), lambda i: F.xxhash64(*[_at("words", i, j) for j in range(GRAM)])))
    df = df.withColumn("marks", F.transform(_places(size, SPAN), lambda i: F.least(*[_at("grams", i, j) for j in range(REACH)])))
    first = F.filter(_places(size, SPAN), lambda i: (i == 0) | (_at("marks", i, 0) != _at("marks", i, -1)))
    df = df.withColumn("firsts", first)
    # a run goes on while the minimum stays the same
    run = F.transform("firsts", lambda i, k: F.struct(i.alias("start"), F.coalesce(F.get("firsts", k + 1), size - SPAN + 1).alias("stop"), _at("marks", i, 0).alias("mark")))
    return df.select(*keep, "words", F.explode(run).alias("run")).select(*keep, "words", "run.*")


def _windows(runs: DataFrame) -> DataFrame:
    """(key, n_words, start, window) of all windows of the runs, from the words ``piece`` that they span."""
    text = lambda i: F.array_join(F.slice("piece", i + 1, SPAN), " ")
    within = F.transform(_places(F.col("stop") - F.col("start"), 1), lambda i: F.struct((F.col("start") + i).alias("start"), text(i).alias("window")))
    return runs.select("key", "n_words", F.explode(within).alias("w")).select("key", "n_words", "w.start", "w.window")


def _piece(runs: DataFrame) -> DataFrame:
    piece = F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start") + SPAN - 1)
    return runs.select("key", F.size("words").alias("n_words"), "start", "stop", piece.alias("piece"))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, n_words, start, span, item): every occurrence of a benchmark window in a text of docs (key, text)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_list(F.col("text")).alias("words"))
    items = written(items.withColumn("n", F.size("words")).where("n > 0"), "items")
    long_items, short_items = items.where(F.col("n") >= SPAN), items.where(F.col("n") < SPAN)
    worded = docs.select("key", word_list(F.col("text")).alias("words"))
    width = F.octet_length("window") + F.octet_length("item") + 64

    marks = written(_runs(long_items).select("mark").distinct(), "marks")
    if small(marks, 64, broadcast_bytes):
        found = _piece(_runs(worded, "key").join(F.broadcast(marks), "mark", "left_semi"))
    else:
        # fingerprints alone move, then the texts that have one of the benchmark's
        some = _runs(worded, "key").select("key", "mark").join(marks, "mark", "left_semi").select("key").distinct()
        some = written(some, "marked")
        again = docs.join(sized(some, 64, broadcast_bytes), "key", "left_semi").select("key", word_list(F.col("text")).alias("words"))
        found = _piece(_runs(again, "key"))
    whole = F.transform(_places(F.col("n"), SPAN), lambda i: F.array_join(F.slice("words", i + 1, SPAN), " "))
    whole = written(long_items.select("item", F.explode(whole).alias("window")).distinct(), "windows")
    out = [_windows(found).join(sized(whole, width, broadcast_bytes), "window").select("key", "n_words", "start", F.lit(SPAN).alias("span"), "item")]

    lengths = [r["n"] for r in short_items.select("n").distinct().orderBy("n").collect()]  # at most SPAN - 1
    if lengths:
        short = short_items.select("item", "n", F.get("words", F.lit(0)).alias("word"), F.array_join("words", " ").alias("window")).distinct()
        firsts = short.select("word").distinct()
        spot = F.transform(_places(F.size("words"), 1), lambda i: F.struct(i.alias("start"), _at("words", i, 0).alias("word")))
        spots = worded.select("key", "words", F.explode(spot).alias("at")).select("key", "words", "at.start", "at.word")
        if small(firsts, F.octet_length("word") + 64, broadcast_bytes):
            spots = spots.join(F.broadcast(firsts), "word", "left_semi")
        span = F.explode(F.array(*[F.lit(n) for n in lengths])).alias("span")
        spots = spots.select("key", "words", "start", span).where(F.col("start") + F.col("span") <= F.size("words"))
        spots = spots.select("key", F.size("words").alias("n_words"), "start", "span", F.array_join(F.slice("words", F.col("start") + 1, F.col("span")), " ").alias("window"))
        same = short.select("item", F.col("n").alias("span"), "window")
        out.append(spots.join(sized(same, width, broadcast_bytes), ["span", "window"]).select("key", "n_words", "start", "span", "item"))
    return reduce(DataFrame.unionByName, out)


def hit_texts(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, n_words, n_hit, item_ids, contaminated) of each different text with a hit, as a table of its own."""
    keyed = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    per_text = hits(keyed, benchmark, broadcast_bytes).groupBy("key").agg(
        F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("stop")))).alias("spots"),
        F.array_sort(F.collect_set("item")).alias("item_ids"),
    )
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spots",
        state,
        lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n")),
        lambda s: s["n"],
    )
    return written(per_text.select("key", "n_words", covered.alias("n_hit"), "item_ids").withColumn("contaminated", F.col("n_hit") * 20 >= F.col("n_words")), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of docs with n_words, n_hit, item_ids (array), n_items and contaminated."""
    found = hit_texts(docs, benchmark, broadcast_bytes)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    own = docs.select(F.struct(*kept).alias("row"), text_key(F.col("text")).alias("key"), F.size(word_list(F.col("text"))).cast("long").alias("words_here"))
    found = sized(found, F.expr("aggregate(item_ids, 96L, (n, x) -> n + octet_length(x) + 16)"), broadcast_bytes)
    out = own.join(found, "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "row.*",
        F.col("words_here").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        ids.alias("item_ids"),
        F.size(ids).cast("long").alias("n_items"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that the contamination rule leaves alone, all columns as they are."""
    found = hit_texts(docs, benchmark, broadcast_bytes).where("contaminated").select("key")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("key"))
    return own.join(sized(found, 96, broadcast_bytes), "key", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's contamination."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: The same rows by brute force over all windows.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(ws)) AS span, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
spans AS (SELECT DISTINCT span FROM bw),
dw AS (SELECT doc_id, span, i, array_to_string(ws[i:i + span - 1], ' ') AS win
       FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM w, spans WHERE len(ws) >= span)),
h AS (SELECT doc_id, dw.span, i, item FROM dw JOIN bw USING (span, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
