"""Grouped summaries beyond single built-in functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(column: str, order: str) -> Column:
    """The first value that is not null, in order; columns may come from different rows."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def _run_of(x: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted edges are under x, by halves."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= edges[mid], among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(edges))


def exact_percentiles(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float], runs: int = 64) -> dict[str, list[float | None]]:
    """Interpolated percentiles of each column, exact at any size: approximate edges cut the values into ``runs`` runs, the
    runs are counted, and values are ordered only within the few runs that hold a wanted rank. Equal values are counted
    before they move. ``runs`` values a column and the answers reach the driver."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / runs for i in range(1, runs)]).alias(c) for c in columns]).first()
    edges = {c: sorted(set(row[c] or [])) for c in columns}
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), _run_of(F.col(c).cast("double"), edges[c]).alias("run")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("v")).select("v.*").where("x is not null")
    counts: dict[str, dict[int, int]] = {c: {} for c in columns}
    for r in long.groupBy("column", "run").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["column"]][r["run"]] = r["n"]
    wanted: dict[tuple[str, int], tuple[int, int]] = {}  # (column, rank from 0) -> (run, rank in it)
    places = {c: [(sum(counts[c].values()) - 1) * p for p in percentiles] for c in columns}
    for c in columns:
        for place in places[c] if counts[c] else []:
            for rank in {math.floor(place), math.ceil(place)}:
                left = rank
                for run in sorted(counts[c]):
                    if left < counts[c][run]:
                        wanted[c, rank] = run, left
                        break
                    left -= counts[c][run]
    if not wanted:
        return {c: [None] * len(percentiles) for c in columns}
    spark = df.sparkSession
    asked = spark.createDataFrame([(c, run, rank, left) for (c, rank), (run, left) in wanted.items()], "column string, run int, rank long, left long")
    some = long.join(F.broadcast(asked.select("column", "run").distinct()), ["column", "run"], "left_semi")
    values = some.groupBy("column", "run", "x").agg(F.count(F.lit(1)).alias("n"))
    through = F.sum("n").over(Window.partitionBy("column", "run").orderBy("x"))
    found = values.withColumn("through", through).join(F.broadcast(asked), ["column", "run"]).where("left < through and left >= through - n")
    at = {(r["column"], r["rank"]): r["x"] for r in found.select("column", "rank", "x").collect()}

    def between(c: str, place: float) -> float:
        low, high = at[c, math.floor(place)], at[c, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {c: [between(c, place) for place in places[c]] if counts[c] else [None] * len(percentiles) for c in columns}


def describe(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """One row for each column: count, missing, mean, sample and population deviation, extremes, exact percentiles."""
    measures = {
        "n": lambda x: F.count(x),
        "missing": lambda x: F.count(F.lit(1)) - F.count(x),
        "mean": lambda x: F.round(F.avg(x), 6),
        "std": lambda x: F.round(F.stddev_samp(x), 6),
        "std_pop": lambda x: F.round(F.stddev_pop(x), 6),
        "min": F.min,
        "max": F.max,
    }
    found = exact_percentiles(df, columns, percentiles)
    names = [f"p{int(p * 100):02d}" for p in percentiles]
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        said = [F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in zip(names, found[c], strict=True)]
        cells.append(F.struct(F.lit(c).alias("column"), *[f(x).alias(m) for m, f in measures.items()], *said))
    return df.agg(F.array(*cells).alias("__rows")).select(F.explode("__rows").alias("v")).select("v.*")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: values, share and a report text."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("x")) for c in columns])).alias("v")).select("v.*")
    out = long.groupBy("column").agg(F.count_if("x").alias("n"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("share", F.round(F.col("n") / F.col("total"), 6)).withColumn("report", F.concat((F.col("total") - F.col("n")).cast("string"), F.lit("/"), F.col("total").cast("string")))


def pivot_unique(df: DataFrame, keys: list[str], column: str, values: Sequence[str], measure: str) -> DataFrame:
    """A column for each value; raises where a cell has several rows."""
    cells = [F.when(F.count_if(F.col(column) == v) > 1, F.raise_error(F.lit(f"several rows for {v}")).cast("double")).otherwise(F.max(F.when(F.col(column) == v, F.col(measure)))).alias(str(v)) for v in values]
    return df.groupBy(*keys).agg(*cells)


def pair_delta(df: DataFrame, keys: list[str], variant: str, a, b, measures: Sequence[str]) -> DataFrame:
    """Means under two variants and their difference a - b, in one pass."""
    aggs = []
    for m in measures:
        aggs += [F.avg(F.when(F.col(variant) == v, F.col(m))).alias(f"{m}_{s}") for v, s in ((a, "a"), (b, "b"))]
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"{m}_delta": F.col(f"{m}_a") - F.col(f"{m}_b") for m in measures})


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """Counts of a by the given values of b, zero where none."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in values])


def high_variance_keys(df: DataFrame, key: str, x: str, least: int = 5, quantile: float = 0.75) -> DataFrame:
    """Keys of at least ``least`` rows whose variance reaches the quantile of all such variances."""
    per = df.groupBy(key).agg(F.count(x).alias("n"), F.var_samp(x).alias("var")).where(F.col("n") >= least)
    limit = per.agg(F.percentile("var", F.lit(quantile)).alias("__limit"))
    return per.crossJoin(F.broadcast(limit)).where(F.col("var") >= F.col("__limit")).drop("__limit")


def consensus(df: DataFrame, item: str, score: str, kind: str | None = None, confidence: str | None = None, least: int = 2, most_mad: float = 15.0, least_confidence: float = 0.5) -> DataFrame:
    """Median, mean, median absolute deviation and number of ratings of each item, and whether it is usable.

    Rows whose ``kind`` is not "rating" abstain: they count for the panel and not for the scores.
    """
    rated = F.col(kind) == "rating" if kind else F.col(score).isNotNull()
    value = F.when(rated, F.col(score).cast("double"))
    middle = df.groupBy(item).agg(F.median(value).alias("__m"))
    joined = df.withColumn("__v", value).join(middle, item)
    sure = F.avg(confidence) if confidence else F.lit(1.0)
    out = joined.groupBy(item).agg(F.first("__m").alias("median"), F.avg("__v").alias("mean"), F.median(F.abs(F.col("__v") - F.col("__m"))).alias("mad"), F.count("__v").alias("n_ratings"), F.count(F.lit(1)).alias("n_judges"), sure.alias("confidence"))
    usable = (F.col("n_ratings") >= least) & (F.coalesce("mad", F.lit(float("inf"))) <= most_mad) & (F.col("confidence") >= least_confidence)
    return out.withColumn("abstained", 1 - F.col("n_ratings") / F.col("n_judges")).withColumn("usable", usable)


def judge_pairs(df: DataFrame, item: str, judge: str, score: str, category: str | None = None, near: float = 10.0) -> DataFrame:
    """Agreement of each pair of judges on the items that both rated. A panel is small, so an item has few pairs."""
    from ..functions.measures import safe_corr
    from .ranks import average_rank

    cols = [score, *([category] if category else [])]
    left = df.select(item, F.col(judge).alias("judge_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = df.select(item, F.col(judge).alias("judge_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = left.join(right, item).where("judge_a < judge_b").where(f"{score}_a is not null and {score}_b is not null")
    pairs = pairs.withColumns({"__ra": average_rank(f"{score}_a", "judge_a", "judge_b"), "__rb": average_rank(f"{score}_b", "judge_a", "judge_b")})
    gap = F.abs(F.col(f"{score}_a") - F.col(f"{score}_b"))
    extra = [F.avg((F.col(f"{category}_a") == F.col(f"{category}_b")).cast("double")).alias("same_category")] if category else []
    return pairs.groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(f"{score}_a").cast("double"), F.col(f"{score}_b").cast("double")).alias("pearson"), safe_corr(F.col("__ra"), F.col("__rb")).alias("spearman"), F.avg(gap).alias("mean_gap"), F.avg((gap <= near).cast("double")).alias("within"), *extra)


def merged_arrays(df: DataFrame, keys: list[str], arrays: Sequence[str], single: str | None = None) -> DataFrame:
    """Sorted distinct unions of array columns; raises where ``single`` has several values for a key."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays]
    if single:
        aggs.append(F.when(F.countDistinct(single) > 1, F.raise_error(F.lit(f"several values of {single}")).cast("string")).otherwise(F.min(single)).alias(single))
    return df.groupBy(*keys).agg(*aggs)


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def best_row(df: DataFrame, keys: list[str], by: str, tie: str, values: Sequence[str]) -> DataFrame:
    """The row of the largest ``by`` of each key; ties by the smallest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.col(tie))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, by, *values)


def sliced(df: DataFrame, slices: dict[str, Sequence[str]]) -> DataFrame:
    """Every row once for each slice it stands in: ``slice`` names the kind, ``value`` the member. One grouping then serves all slices."""
    parts = [F.struct(F.lit(name).alias("slice"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("value")) for name, cols in slices.items()]
    return df.withColumn("__s", F.explode(F.array(*parts))).withColumns({"slice": F.col("__s.slice"), "value": F.col("__s.value")}).drop("__s")


def saliency_ratio(df: DataFrame, tags: str, score: str, labels: Sequence[str]) -> DataFrame:
    """For each label the mean score of tagged tokens over the mean of the others."""
    rows = [F.struct(F.lit(l).alias("label"), F.array_contains(tags, l).alias("hit")) for l in labels]
    long = df.select(score, F.explode(F.array(*rows)).alias("t")).select(score, "t.*")
    out = long.groupBy("label").agg(F.avg(F.when(F.col("hit"), F.col(score))).alias("tagged"), F.avg(F.when(~F.col("hit"), F.col(score))).alias("other"))
    return out.withColumn("ratio", F.col("tagged") / F.greatest("other", F.lit(1e-12)))


def counts_of_counts(df: DataFrame, item: str) -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_items"))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
