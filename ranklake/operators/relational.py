"""Joins with fallback and backfill, unions, set comparisons and column housekeeping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROLES = {"id": (), "axis": ("axis_",), "treatment": ("treat_",), "confounder": ("conf_", "dfs_"), "cell": ("cell_",)}


def ensure_columns(df: DataFrame, schema: StructType, default: object = None) -> DataFrame:
    """Adds the schema's missing columns as typed nulls or a constant."""
    missing = [f for f in schema if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(default).cast(f.dataType) for f in missing}) if missing else df


def unique_columns(columns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(columns))


def by_role(df: DataFrame, ids: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Identity, axis, outcome, treatment, confounder columns, then the rest."""
    prefixed = [[c for c in df.columns if c.startswith(p)] for p in (ROLES["axis"], ROLES["treatment"], ROLES["confounder"])]
    order = unique_columns([*(c for c in ids if c in df.columns), *prefixed[0], *(c for c in outcomes if c in df.columns), *prefixed[1], *prefixed[2], *df.columns])
    return df.select(*order)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def usable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with a value and at least two different ones, in one pass."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] >= 2]


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers, or null where the text is none."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def fallback_join(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], values: list[str], order: str) -> DataFrame:
    """Values by the exact key (its last row in order), else by the loose key (its first row); how tells which."""
    last = Window.partitionBy(*exact).orderBy(F.col(order).desc())
    first = Window.partitionBy(*loose).orderBy(F.col(order).asc())
    pick = lambda w, keys, name: right.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, F.struct(*values).alias(name))
    out = left.join(pick(last, exact, "__exact"), exact, "left").join(pick(first, loose, "__loose"), loose, "left")
    got = F.coalesce("__exact", "__loose")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "loose").otherwise("none")
    return out.withColumns({v: got[v] for v in values}).withColumn("how", how).drop("__exact", "__loose")


def join_available(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_ext") -> DataFrame:
    """Left join on the keys that the right table has; its other clashing columns get a suffix."""
    on = [k for k in keys if k in right.columns]
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in on})
    return left.join(renamed, on, "left")


def replace_columns(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Drops the columns and joins the right table's."""
    return left.drop(*columns).join(right.select(*on, *columns), on, "left")


def backfilled(frames: Sequence[DataFrame], on: list[str], value: str) -> DataFrame:
    """Full outer join; the first table in order that has a value gives it."""
    named = [f.select(*on, F.col(value).alias(f"__{i}")) for i, f in enumerate(frames)]
    out = reduce(lambda a, b: a.join(b, on, "full_outer"), named)
    return out.select(*on, F.coalesce(*[F.col(f"__{i}") for i in range(len(frames))]).alias(value))


def fill_join(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """The left value where there is one, else the right's."""
    other = right.select(*on, *[F.col(c).alias(f"{c}__fill") for c in columns])
    out = left.join(other, on, "left")
    return out.withColumns({c: F.coalesce(c, f"{c}__fill") for c in columns}).drop(*[f"{c}__fill" for c in columns])


def member_flag(left: DataFrame, keys: DataFrame, on: list[str], flag: str = "selected") -> DataFrame:
    """1 where the key occurs in the other table, else 0."""
    marked = keys.select(*on).distinct().withColumn(flag, F.lit(1))
    return left.join(marked, on, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def robust_keys(df: DataFrame, keys: list[str], pool: str, pools: Sequence) -> DataFrame:
    """Keys that occur in every one of the pools."""
    return df.where(F.col(pool).isin(*pools)).groupBy(*keys).agg(F.countDistinct(pool).alias("__n")).where(F.col("__n") == len(pools)).drop("__n")


def variant_pairs(df: DataFrame, on: list[str], variant: str, a, b, values: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two variants of one table. With keys short of the grain rows multiply, as archived tables do."""
    side = lambda v, s: df.where(F.col(variant) == v).select(*on, *[F.col(c).alias(c + s) for c in values])
    return side(a, suffixes[0]).join(side(b, suffixes[1]), on)


def checked_one_to_one(left: DataFrame, right: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """Full outer join with the reason of each row that breaks a 1:1 match, null where it holds."""
    l = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__nl"), *[F.first(c).alias(f"{c}__l") for c in same])
    r = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__nr"), *[F.first(c).alias(f"{c}__r") for c in same])
    differs = reduce(lambda a, b: a | b, [~F.col(f"{c}__l").eqNullSafe(F.col(f"{c}__r")) for c in same], F.lit(False))
    reason = F.when(F.col("__nl").isNull(), "missing-left").when(F.col("__nr").isNull(), "missing-right").when((F.col("__nl") > 1) | (F.col("__nr") > 1), "repeated").when(differs, "differs")
    return l.join(r, on, "full_outer").select(*on, reason.alias("problem"))


def in_key_order(keys: DataFrame, df: DataFrame, on: list[str]) -> DataFrame:
    """A row for every key; absent ones are null."""
    return keys.join(df, on, "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of the columns that all frames have, in name order."""
    common = sorted(set.intersection(*[set(f.columns) for f in frames]))
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def set_sizes(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: sizes of a, b, their intersection and both differences."""
    both = a.select(*on).distinct().withColumn("__a", F.lit(1)).join(b.select(*on).distinct().withColumn("__b", F.lit(1)), on, "full_outer")
    ina, inb = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(F.count_if(ina).alias("n_a"), F.count_if(inb).alias("n_b"), F.count_if(ina & inb).alias("n_both"), F.count_if(ina & ~inb).alias("n_a_only"), F.count_if(inb & ~ina).alias("n_b_only"))


def gaps(target: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    return target.select(*on).distinct().join(actual.select(*on), on, "left_anti")


def gap_summary(missing: DataFrame, cell: list[str], key: str, shown: int = 5) -> DataFrame:
    """Missing keys of each cell: their count and the first few in order. The few are found by rank, not from a whole list."""
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(key))
    ranked = missing.withColumn("__n", place)
    few = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__n") <= shown, F.col(key).cast("string")))), ",")
    return ranked.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_missing"), few.alias("sample"))


def presence(df: DataFrame, keys: list[str], variant: str, variants: Sequence[str]) -> DataFrame:
    """Rows and a 0/1 flag of each variant for every key, and a coverage class."""
    counts = [F.count_if(F.col(variant) == v).alias(f"n_{v}") for v in variants]
    out = df.groupBy(*keys).agg(*counts)
    n = reduce(lambda a, b: a + b, [(F.col(f"n_{v}") > 0).cast("int") for v in variants])
    return out.withColumns({f"has_{v}": (F.col(f"n_{v}") > 0).cast("int") for v in variants}).withColumn("coverage", F.when(n == len(variants), "all").when(n == 1, "single").otherwise("some"))


def dedup_by_hash(df: DataFrame, text: Column, *priority: str) -> DataFrame:
    """One row for each digest of the text: the first in priority order. Only the key and the priority are compared before the rows."""
    w = Window.partitionBy("__h").orderBy(*priority)
    return df.withColumn("__h", F.sha2(text, 256)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__h", "__n")


def extend_unseen(base: DataFrame, extra: DataFrame, text: str, *priority: str) -> DataFrame:
    """The base rows and those extra rows whose text it has not."""
    fresh = dedup_by_hash(extra, F.col(text), *priority).withColumn("__h", F.sha2(text, 256))
    seen = base.select(F.sha2(text, 256).alias("__h")).distinct()
    return base.unionByName(fresh.join(seen, "__h", "left_anti").drop("__h"), allowMissingColumns=True)


def carry_over(new: DataFrame, old: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """New rows with the old rows' bookkeeping columns, or defaults."""
    out = new.join(old.select(*on, *defaults), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
