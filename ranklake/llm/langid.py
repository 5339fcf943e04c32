"""Language of web pages by Bayesian evidence fusion (operator 5).

Four pieces of evidence meet in one posterior for each page:

- text: byte trigrams of the main text under smoothed multinomials for each language, tempered
  by ``TEMPER`` because neighbouring trigrams are not independent;
- markup: the declared language, through P(declared | language), counted over all pages;
- address suffix and host: priors smoothed in a hierarchy, host towards suffix, suffix
  towards all pages, with ``STRENGTH`` pseudo-counts at each step.

Counts are sums of text posteriors from grouped aggregation over all pages, so a host
with a third of the rows is pre-aggregated in its map tasks; the join back is one
that Spark can split. Trigram models are fitted on at most ``TRAIN_ROWS`` labelled
documents (those of the smallest hash of doc_id), in one streaming task.

Defined cases: null or empty html gives the prior and the address alone; a missing or
unknown declaration is its own value "" and says what its counts say; addresses
without a host use the suffix ""; null urls likewise; repeated rows give repeated
rows and count repeatedly; labels that are null or empty don't train; without any
training language the answer is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_text
from . import spans as S
from .exchange import sized, tidy, written

U64 = np.uint64
BITS, TRAIN_ROWS, TEMPER, STRENGTH = 16, 4_000, 0.2, 5.0
SLICE = 1 << 20


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, text) of all byte trigrams of lower-cased texts."""
    data, offsets = S.text_buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(U64)
    h = S.mix((x[:-2] << U64(16)) | (x[1:-1] << U64(8)) | x[2:]) >> U64(64 - BITS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = owner[:-2] == owner[2:]
    return h[same].astype(np.int64), owner[:-2][same]


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages, and log-probabilities (language, trigram), from columns doc_id, text, lang."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            ids, owner = trigrams(b.column("text"))
            langs = b.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own = np.array([x == lang for x in langs])
                counts.setdefault(lang, np.zeros(1 << BITS))
                counts[lang] += np.bincount(ids[own[owner]], minlength=1 << BITS)
        for lang, n in counts.items():
            logs = np.log((n + 0.5) / (n.sum() + 0.5 * len(n))).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([logs.tobytes()], pa.binary())], names=["lang", "logs"])

    usable = labelled.where("text is not null and lang != ''").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = usable.join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("doc_id")
    found = sorted(sample.select("text", "lang").mapInArrow(tidy(fit), "lang string, logs binary").collect())  # a row for each language of the bounded sample
    return [r.lang for r in found], np.array([np.frombuffer(r.logs, "<f4") for r in found]).reshape(len(found), 1 << BITS)


def _address(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", "")
    first = F.regexp_extract(plain, r"(?i)<html\b([^>]*)", 1)
    declared = F.lower(F.regexp_extract(first, r"(?i)(?<![\w:-])lang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return pages.withColumn("host", host).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1)).withColumn("declared", declared)


def text_scores(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """page_id, url, host, suffix, declared and logs: the tempered log-likelihood of each language."""
    languages, logs = model
    node, pair = (np.array(x) for x in html_text.trained())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(logs.T.astype(np.float64))
        for b in (part for batch in batches for part in S.slices(batch, "html", SLICE)):
            texts = pa.array([html_text.main_text(x, node, pair) for x in b.column("html").to_pylist()], pa.large_string())
            ids, owner = trigrams(texts)
            out = np.zeros((b.num_rows, len(languages)))
            for k in range(len(languages)):
                out[:, k] = np.bincount(owner, weights=table[ids, k], minlength=b.num_rows)
            out = TEMPER * (out - out.max(axis=1, keepdims=True, initial=-np.inf)) if len(languages) else out
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(languages)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "suffix", "declared")), lists], names=["page_id", "url", "host", "suffix", "declared", "logs"])

    own = _address(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    return own.select("page_id", "url", "host", "suffix", "declared", "html").mapInArrow(tidy(rows), "page_id long, url string, host string, suffix string, declared string, logs array<double>")


def _softmax(logs):
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """page_id, url, host, suffix, declared, lang and its posterior."""
    languages = model[0]
    n = len(languages)
    scored = text_scores(pages, model)
    if not n:
        return scored.drop("logs").withColumn("lang", F.lit(None).cast("string")).withColumn("posterior", F.lit(None).cast("double"))
    scored = written(scored.withColumn("text_p", _softmax(F.col("logs"))), "language")
    sums = lambda *by: scored.groupBy(*by).agg(F.array(*[F.sum(F.round(F.get("text_p", F.lit(k)), 6).cast("decimal(20,6)")).cast("double") for k in range(n)]).alias("n"))
    smooth = lambda own, above: F.transform(own, lambda x, i: (x + STRENGTH * F.get(above, i)) / (F.aggregate(own, F.lit(0.0), lambda a, y: a + y) + STRENGTH))
    base = sums().select(smooth(F.col("n"), F.array(*[F.lit(1.0 / n)] * n)).alias("p_all"))
    suffix = sums("suffix").crossJoin(F.broadcast(base)).select("suffix", smooth(F.col("n"), F.col("p_all")).alias("p_suffix"))
    host = sums("host", "suffix").join(suffix, "suffix").select("host", "suffix", smooth(F.col("n"), F.col("p_suffix")).alias("p_host"))
    # a table of its own, so that a host with many pages can be split in the join
    host = written(host, "hosts")
    # P(declared | language), smoothed towards P(declared)
    says = sums("declared").withColumn("m", F.aggregate("n", F.lit(0.0), lambda a, x: a + x))
    totals = says.agg(F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(n)]).alias("t"), F.sum("m").alias("all"))
    says = says.crossJoin(F.broadcast(totals)).select("declared", F.transform("n", lambda x, i: (x + STRENGTH * F.col("m") / F.col("all")) / (F.get("t", i) + STRENGTH)).alias("p_declared"))
    # a handful of declarations, but nothing bounds them: both small tables are measured
    says = written(says, "declared")
    row = F.lit(64 + 8 * n)
    fused = scored.join(sized(says, F.octet_length("declared") + row), "declared").join(sized(host, F.octet_length("host") + F.octet_length("suffix") + row), ["host", "suffix"])
    logs = F.transform("logs", lambda x, i: x + F.log(F.get("p_declared", i)) + F.log(F.get("p_host", i)))
    fused = fused.withColumn("p", _softmax(logs)).withColumn("best", F.array_max("p"))
    names = F.array(*[F.lit(x) for x in languages])
    return fused.select("page_id", "url", "host", "suffix", "declared", F.get(names, (F.array_position("p", F.col("best")) - 1).cast("int")).alias("lang"), F.round("best", 6).alias("posterior"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the language of every page."""
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(spark.read.parquet(f"{sf_dir}/documents.parquet")))
