"""Resumable and incremental processing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(work: DataFrame, done: DataFrame, keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Work without the keys of the output, and of a checkpoint where one is given."""
    out = work.join(done.select(*keys).distinct(), keys, "left_anti")
    return out if seen is None else out.join(seen.select(*keys).distinct(), keys, "left_anti")


def plan(target: DataFrame, actual: DataFrame, cell: list[str], key: str, quarantine: float = 0.5) -> DataFrame:
    """For each cell the target, what is done and missing, and whether it is whole, open or to be looked at."""
    t = target.select(*cell, key).distinct().groupBy(*cell).agg(F.count(F.lit(1)).alias("n_target"))
    a = actual.select(*cell, key).distinct().join(target.select(*cell, key).distinct(), [*cell, key], "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("n_done"))
    out = t.join(a, cell, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0))).withColumn("n_missing", F.col("n_target") - F.col("n_done"))
    return out.withColumn("state", F.when(F.col("n_missing") == 0, "whole").when(F.col("n_done") < quarantine * F.col("n_target"), "quarantine").otherwise("open"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts of each key before and after, and the change."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    out = b.join(a, keys, "full_outer").na.fill(0, ["n_before", "n_after"])
    return out.withColumn("change", F.col("n_after") - F.col("n_before"))


def scrub(df: DataFrame, column: str, wanted: str) -> DataFrame:
    return df.where(F.col(column).eqNullSafe(F.lit(wanted)))


def backfill_field(df: DataFrame, struct: str, values: dict[str, object]) -> DataFrame:
    """Sets fields of a struct where they are null."""
    out = F.col(struct)
    for f, v in values.items():
        out = out.withField(f, F.coalesce(F.col(f"{struct}.{f}"), F.lit(v)))
    return df.withColumn(struct, out)


def last_by_order(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of repeated keys the row that was written last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
