"""Ranks, rank movement and agreement of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen_rank(df: DataFrame, keys: list[str], item: str, position: str, out: str = "rank", ascending: bool = True) -> DataFrame:
    """One row for each key and item with its 1-based rank by best position; ties by item."""
    best = (F.min if ascending else F.max)(position).alias("__p")
    order = [F.col("__p").asc_nulls_last() if ascending else F.col("__p").desc_nulls_last(), F.col(item)]
    return df.groupBy(*keys, item).agg(best).withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop("__p")


def rank_changes(before: DataFrame, after: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items of ``after`` with pre_rank, post_rank and delta = pre - post; a new item has null pre_rank and delta."""
    pre = before.select(*keys, item, F.col("rank").alias("pre_rank"))
    out = after.select(*keys, item, F.col("rank").alias("post_rank")).join(pre, [*keys, item], "left")
    return out.withColumn("rank_delta", F.col("pre_rank") - F.col("post_rank"))


def movement(df: DataFrame, delta: str, cells: list[str]) -> DataFrame:
    """n, median and mean of |delta| and the shares of at least 1 and 3, overall and for each cell."""
    size = F.abs(delta)
    measures = [
        F.count(delta).alias("n"),
        F.median(size).alias("median_abs"),
        F.round(F.avg(size), 6).alias("mean_abs"),
        F.round(F.avg((size >= 1).cast("double")), 6).alias("share_1"),
        F.round(F.avg((size >= 3).cast("double")), 6).alias("share_3"),
    ]
    return df.groupingSets([[], [F.col(c) for c in cells]], *cells).agg(*measures)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def average_rank(x: str | Column, *partition: str) -> Column:
    """1-based rank; ties get the mean of their places."""
    w = Window.partitionBy(*partition)
    col = F.col(x) if isinstance(x, str) else x
    ties = Window.partitionBy(*partition, col)
    return F.rank().over(w.orderBy(col)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def ordinal_rank(x: str, tie: str, *partition: str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.col(x), F.col(tie)))


def spearman_ordinal(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """1 - 6 * sum(d^2) / (n (n^2 - 1)) from two rank columns; null under two rows."""
    n = F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys).agg(n.cast("long").alias("n"), F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).cast("double").alias("__d")).withColumn("spearman", F.when(F.col("n") > 1, 1 - 6 * F.col("__d") / (F.col("n") * (F.col("n") * F.col("n") - 1)))).drop("__d")


def kendall(df: DataFrame, keys: list[str], item: str, a: str, b: str, ties: str = "none") -> DataFrame:
    """(concordant - discordant) over all pairs, or with ties="b" over the root of the untied pairs of each side.

    Pairs form within one key only, by an equi join with an ordered residual; a key is a ranked list, whose length is bounded by its top k.
    """
    left = df.select(*keys, F.col(item).alias("__i"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    right = left.select(*keys, F.col("__i").alias("__j"), F.col("__a").alias("__c"), F.col("__b").alias("__d"))
    pairs = left.join(right, keys).where("__i < __j").withColumn("__x", F.signum(F.col("__a") - F.col("__c")).cast("int")).withColumn("__y", F.signum(F.col("__b") - F.col("__d")).cast("int"))
    agg = pairs.groupBy(*keys).agg(F.sum(F.col("__x") * F.col("__y")).alias("__s"), F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("__x") != 0).alias("__nx"), F.count_if(F.col("__y") != 0).alias("__ny"))
    below = F.col("n_pairs").cast("double") if ties == "none" else F.sqrt(F.col("__nx").cast("double") * F.col("__ny"))
    return agg.select(*keys, "n_pairs", F.try_divide(F.col("__s").cast("double"), below).alias("kendall"))


def neighbour_accuracy(df: DataFrame, truth: str, predicted: str, *partition: str) -> DataFrame:
    """Share of neighbours in true order, with different truth, whose predictions are ordered alike."""
    w = Window.partitionBy(*partition).orderBy(F.col(truth), F.col(predicted))
    pairs = df.select(*partition, truth, predicted, F.lead(truth).over(w).alias("__t"), F.lead(predicted).over(w).alias("__p")).where(F.col("__t") > F.col(truth))
    right = F.avg((F.col("__p") > F.col(predicted)).cast("double"))
    return pairs.groupBy(*partition).agg(F.count(F.lit(1)).alias("n_pairs"), right.alias("accuracy"))


def assign_urls(ranked: DataFrame, pool: DataFrame, keys: list[str], domain: str, url: str) -> DataFrame:
    """Gives each mention of a domain its next unused url; ranks count only the mentions that got one."""
    n = Window.partitionBy(*keys, domain)
    a = ranked.withColumn("__n", F.row_number().over(n.orderBy("place")))
    b = pool.withColumn("__n", F.row_number().over(n.orderBy("position", url)))
    hit = a.select(*keys, domain, "place", "__n").join(b.select(*keys, domain, "__n", url), [*keys, domain, "__n"])
    return hit.withColumn("url_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place", domain))).drop("__n")
