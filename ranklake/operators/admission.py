"""Which pool rows a re-ranker admits: the frame that the estimators work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import first_known
from .relational import member_flag


def frame(pool: DataFrame, output: DataFrame, features: DataFrame, design: DataFrame, keys: list[str], cells: list[str], attributes: Sequence[str], order: str, grounded: str = "_rag") -> DataFrame:
    """Pool rows for each cell of the design, flagged by membership in the output, with first known features.

    Rows of grounded variants stay only where their keyword has any output under that variant. The design has few
    rows and is the one side that is broadcast.
    """
    rows = pool.select(*keys).distinct().crossJoin(F.broadcast(design.select(*cells)))
    rows = member_flag(rows, output, [*keys, *cells])
    seen = output.select("variant", keys[0]).distinct()
    has = rows.where(F.col("variant").endswith(grounded)).join(seen, ["variant", keys[0]], "left_semi")
    rows = rows.where(~F.col("variant").endswith(grounded)).unionByName(has.select(*rows.columns))
    known = features.groupBy(*keys).agg(*[first_known(a, order).alias(a) for a in attributes])
    return rows.join(known, keys, "left")


def rates(frame_: DataFrame, cells: list[str]) -> DataFrame:
    return frame_.groupBy(*cells).agg(F.round(F.avg("selected"), 6).alias("rate"), F.sum("selected").cast("long").alias("n_selected"), F.count(F.lit(1)).alias("n_pool"))
