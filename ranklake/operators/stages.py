"""Stage drivers: whole jobs made of the operators, from tables to tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import urls as U
from . import aggregates, html_features, relational, retrieval


def feature_stage(serp: DataFrame, pages: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """One row for each (keyword, url) of the pool with page and text features and the BM25 score in its keyword.

    Pages without source keep their row with ``html_present`` false. Brands (domain, source_type) is a list.
    """
    page = html_features.page_features(pages.where("html is not null").dropDuplicates(["url"]), "url", "url", "html").withColumnsRenamed({"title": "page_title"})
    rows = serp.where("position is not null and coalesce(url, '') != ''").join(page, "url", "left").withColumn("html_present", F.col("body_text").isNotNull())
    body = F.col("body_text")
    rows = rows.withColumns(
        {
            "domain": U.domain_of(F.col("url")),
            "conf_title_kw": T.title_has_keyword(F.col("title"), F.col("keyword")).cast("int"),
            "treat_stats_present": T.has_stats(body).cast("int"),
            "treat_stats_density": T.stats_density(body),
            "conf_word_count": T.word_count(body),
            "conf_https": F.lower("url").startswith("https://").cast("int"),
        }
    )
    queries = rows.select("keyword").distinct().withColumn("terms", F.split(F.lower("keyword"), " "))
    scores = retrieval.bm25(rows.dropDuplicates(["keyword", "url"]), queries, "keyword", "url", "body_text", "terms")
    rows = rows.join(scores, ["keyword", "url"], "left").drop("body_text", "digest", "headings", "dates")
    if brands is not None:
        rows = rows.join(brands, "domain", "left").withColumn("source_type", F.coalesce("source_type", F.lit("other")))
    return rows


def merge_stage(records: DataFrame, features: DataFrame, attributes: Sequence[str], order: str = "position") -> DataFrame:
    """(run, keyword, domain) rows of rerank records with ranks and the features of their url, else of their domain."""
    ranks = records.where("error is null").select("run_id", "keyword", "used_fallback", F.explode("rank_changes").alias("c"), "ranked_results")
    url = F.element_at(F.filter("ranked_results", lambda r: r["domain"] == F.col("c.domain")), 1)
    first = F.when(F.size(F.filter("ranked_results", lambda r: r["domain"] == F.col("c.domain"))) > 0, url["url"]).otherwise("")
    rows = ranks.select("run_id", "keyword", "used_fallback", F.col("c.domain").alias("domain"), first.alias("url"), "c.pre_rank", "c.post_rank", "c.rank_delta")
    return relational.fallback_join(rows, features.where("url != ''"), ["keyword", "url"], ["keyword", "domain"], list(attributes), order)


def index_stage(pages: DataFrame, embed: Callable[[Column], Column], least: int = 100, most: int = 8000) -> DataFrame:
    """(url, chunk_idx, text, embedding) of all pages with enough text; ``embed`` maps a text column to a vector column."""
    text = html_features.page_features(pages.dropDuplicates(["url"]), "url", "url", "html").where(F.char_length("digest") >= least).select("url", F.substring("digest", 1, most).alias("digest"))
    return retrieval.chunks(text, "url", "digest", least=least).withColumn("embedding", embed(F.col("text")))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows and columns of each table, one count a table."""
    parts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")) for n, df in tables.items()]
    return relational.union_all(parts)


def union_stage(runs: dict[str, DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The union of run tables tagged by variant, and each key's coverage over the variants."""
    whole = relational.union_all([df.withColumn("variant", F.lit(v)) for v, df in runs.items()])
    return whole, relational.presence(whole, list(keys), "variant", list(runs))


def report_tables(fits: DataFrame, level: float = 0.05) -> dict[str, DataFrame]:
    """The tables of a results summary: effects by slice, the share of clear effects, and the largest ones."""
    from ..functions.measures import stars

    shown = fits.withColumns({"stars": stars(F.col("p_val")), "cell": F.concat(F.format_number("coef", 4), stars(F.col("p_val")))})
    by_slice = shown.groupBy("outcome", "treatment").pivot("slice").agg(F.first("cell")).na.fill("")
    share = fits.groupBy("outcome").agg(F.avg((F.col("p_val") < level).cast("double")).alias("share_clear"), F.count(F.lit(1)).alias("n"))
    return {"by_slice": by_slice, "share": share, "largest": fits.withColumn("abs_t", F.abs("t_stat")).orderBy(F.desc("abs_t"), "outcome", "treatment").limit(10)}


def dictionary_stage(runs: dict[str, DataFrame], features: DataFrame, on: list[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All runs under one run_id with their features joined, and a dictionary: each column's type, values and share known."""
    whole = relational.union_all([df.withColumn("run_id", F.lit(n)) for n, df in runs.items()])
    whole = whole.join(features, on, "left")
    types = dict(whole.dtypes)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.count(c).alias("n"), F.round(F.count(c) / F.count(F.lit(1)), 6).alias("share")) for c in columns]
    return whole, whole.agg(F.array(*cells).alias("__d")).select(F.explode("__d").alias("d")).select("d.*")


def metric_stage(rows: DataFrame, by_key: DataFrame, by_pair: DataFrame, by_domain: DataFrame, key: str, domain: str) -> DataFrame:
    """Metrics of a keyword, of a (keyword, domain) pair and of a domain beside each row; a row without any stays."""
    out = rows.join(by_key, key, "left").join(by_pair, [key, domain], "left")
    return out.join(by_domain, domain, "left")


def variant_report(df: DataFrame, variant: str, a, b, keys: list[str], groups: dict[str, Sequence[str]], measure: str) -> DataFrame:
    """Sections of a comparison of two variants as one table (section, value, n_a, n_b, mean_a, mean_b, delta): overall, by
    each group, and over the keys that both variants hold."""
    parts = aggregates.sliced(df, {"all": [], **groups})
    both = df.groupBy(*keys).agg(F.countDistinct(F.when(F.col(variant).isin(a, b), F.col(variant))).alias("__v")).where("__v = 2").drop("__v")
    shared = df.join(both, keys, "left_semi").withColumns({"slice": F.lit("shared keys"), "value": F.lit("")})
    rows = parts.unionByName(shared)
    of = lambda v, x: F.when(F.col(variant) == v, x)
    m = F.col(measure)
    out = rows.groupBy("slice", "value").agg(F.count(of(a, m)).alias("n_a"), F.count(of(b, m)).alias("n_b"), F.avg(of(a, m)).alias("mean_a"), F.avg(of(b, m)).alias("mean_b"))
    return out.withColumn("delta", F.col("mean_a") - F.col("mean_b")).withColumnRenamed("slice", "section")


def analysis_report(df: DataFrame, outcomes: Sequence[str], cells: list[str], confounders: Sequence[str]) -> DataFrame:
    """An analysis as one long table (section, name, value): sizes, coverage, moments, correlations with the outcomes, and
    the spread of each outcome's means over the cells. One pass for the columns, one for the cells."""
    from ..functions.measures import safe_corr

    cols = [*outcomes, *confounders]
    entry = lambda s, n, v: F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.cast("double").alias("value"))
    said = [entry("size", "rows", F.count(F.lit(1)))] + [entry("coverage", c, F.count(c) / F.count(F.lit(1))) for c in cols]
    said += [entry("mean", c, F.avg(c)) for c in cols] + [entry("deviation", c, F.stddev_samp(c)) for c in cols]
    said += [entry("correlation", f"{y}~{x}", safe_corr(F.col(y).cast("double"), F.col(x).cast("double"))) for y in outcomes for x in confounders]
    wide = df.agg(F.array(*said).alias("r"))
    means = df.groupBy(*cells).agg(*[F.avg(y).alias(y) for y in outcomes])
    spread = means.agg(F.array(entry("size", "cells", F.count(F.lit(1))), *[entry("spread", y, F.max(y) - F.min(y)) for y in outcomes]).alias("r"))
    return wide.unionAll(spread).select(F.explode("r").alias("r")).select("r.*")


def reviewer_tables(df: DataFrame, cells: list[str], measure: str, digits: int = 3) -> DataFrame:
    """A condensed table: mean (deviation) and n of each cell as the text that a page prints."""
    out = df.groupBy(*cells).agg(F.avg(measure).alias("__m"), F.stddev_samp(measure).alias("__s"), F.count(measure).alias("n"))
    text = F.concat(F.format_string(f"%.{digits}f", F.col("__m")), F.lit(" ("), F.coalesce(F.format_string(f"%.{digits}f", F.col("__s")), F.lit("-")), F.lit(")"))
    return out.select(*cells, text.alias("shown"), "n")


def consolidated(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Copies tables below one folder and returns the manifest: table, rows, columns, and a digest of the sorted column names
    and types. A table that is there already is kept and counted."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        path = f"{root}/{name}"
        try:
            kept = spark.read.parquet(path)
        except (AnalysisException, Py4JJavaError):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            kept = spark.read.parquet(path)
        shape = ",".join(sorted(f"{c}:{t}" for c, t in kept.dtypes))
        parts.append(kept.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(kept.columns)).alias("columns"), F.sha2(F.lit(shape), 256).alias("shape")))
    return relational.union_all(parts)


def robustness_battery(df: DataFrame, key: str, group: str, vector: str, target: str, penalty: float = 1.0, draws: int = 50) -> DataFrame:
    """Checks of a ridge map as one table (check, value): error with each group left out against that of the mean, a
    bootstrap band of the absolute error, and the correlation under shuffled targets."""
    from . import latent

    out = latent.leave_one_group_out(df, group, vector, target, penalty).withColumn("miss", F.abs(F.col(target) - F.col("p")))
    whole = latent.metrics(out, target, "p").select("mae", "baseline_mae", "spearman", "gain")
    band = latent.bootstrap_mean(out, key, "miss", [], draws).select("low", "high")
    null = latent.permutation_control(out, key, target, "p", draws).select("null_95", F.col("p").alias("permutation_p"))
    wide = whole.crossJoin(F.broadcast(band)).crossJoin(F.broadcast(null))  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value")) for c in wide.columns])).alias("r")).select("r.*")
