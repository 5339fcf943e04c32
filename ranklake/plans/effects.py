"""Variants of the partially linear model: other samples, controls, treatments and audits, each with its closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as Adm
from ..operators import causal as C
from . import crossfit as X
from .estimators import CONTROLS, fitted, panel
from .registry import query, table


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def wide(spark: SparkSession, d: str) -> DataFrame:
    """The panel with indicators."""
    one = lambda c: c.cast("int").cast("double")
    return panel(spark, d).withColumns({"is_a": one(F.col("l_returnflag") == "A"), "is_f": one(F.col("l_linestatus") == "F"), "high": one(F.col("l_quantity") > 25)})


@query("d8_three_folds", X.union([X.plr("price", "l_discount", CONTROLS, k=3)]))
def three_folds(spark: SparkSession, d: str) -> DataFrame:
    """Three folds on complete rows, with both nuisance shares of variance."""
    return fitted(spark, [C.plr(panel(spark, d), "key", "price", "l_discount", CONTROLS, k=3)])


@query("d15_mutual", X.union([X.plr("price", t, [*CONTROLS, o], extra=f"'{t}' AS treatment, ") for t, o in (("l_quantity", "l_discount"), ("l_discount", "l_quantity"))]))
def mutual(spark: SparkSession, d: str) -> DataFrame:
    rows = C.grid(panel(spark, d), "key", {"all": None}, ["l_quantity", "l_discount"], ["price"], CONTROLS, mutual=True)
    return fitted(spark, rows, ("treatment",))


_BOTH = "l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R', 'N') GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) = 3)"
_ROBUST = X.PANEL.replace("FROM lineitem)", f"FROM lineitem WHERE {_BOTH})")


@query("d16_j15_robust_sample", X.union([X.plr("price", t, ["l_tax"], panel=_ROBUST, extra=f"'{t}' AS treatment, ") for t in ("l_quantity", "l_discount")]))
def robust_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fits on the rows of suppliers that stand under every flag."""
    lines = C.robust_sample(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "R", "N"])
    rows = lines.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"))
    return fitted(spark, C.grid(rows, "key", {"all": None}, ["l_quantity", "l_discount"], ["price"], ["l_tax"]), ("treatment",))


@query("d17_run_dummies", X.union([X.plr("price", "l_quantity", ["l_tax", "is_a", "is_f"])]))
def run_dummies(spark: SparkSession, d: str) -> DataFrame:
    """The runs' indicators join the controls."""
    rows, names = C.with_dummies(panel(spark, d), {"l_returnflag": ["-", "A"], "l_linestatus": ["O", "F"]})
    return fitted(spark, [C.plr(rows, "key", "price", "l_quantity", ["l_tax", *names])])


_NUISANCE = [("outcome", "price"), ("treatment", "l_quantity"), ("treatment", "high")]


@query("d19_d20_nuisance_r2", " UNION ALL ".join(f"SELECT '{s}' AS side, '{t}' AS target, round({X.r2(t, CONTROLS)}, 5) AS r2" for s, t in _NUISANCE))
def nuisance(spark: SparkSession, d: str) -> DataFrame:
    rows = C.nuisance_r2(wide(spark, d), "key", ["price"], ["l_quantity", "high"], CONTROLS)
    return _rows(spark, [(r["side"], r["target"], round(r["r2"], 5)) for r in rows], "side string, target string, r2 double")


_SETS = {"all": ["l_tax", "l_linenumber", "is_f"], "without place": ["l_tax", "is_f"], "without cell": ["l_tax", "l_linenumber"]}


@query("d25_drop_refits", X.union([X.plr("price", "l_quantity", c, extra=f"'{n}' AS controls, ") for n, c in _SETS.items()]))
def drop_refits(spark: SparkSession, d: str) -> DataFrame:
    rows = C.drop_refits(wide(spark, d), "key", "price", "l_quantity", {"place": ["l_linenumber"], "cell": ["is_f"]}, _SETS["all"])
    return fitted(spark, rows, ("controls",))


@query("d27_per_engine", X.union([X.plr("price", "l_quantity", ["l_tax", "l_discount"], f"l_returnflag = '{f}'", extra=f"'{f}' AS slice, ") for f in "ANR"]))
def per_engine(spark: SparkSession, d: str) -> DataFrame:
    """One engine at a time; its own indicator is constant there and no control."""
    slices = {f: F.col("l_returnflag") == f for f in "ANR"}
    return fitted(spark, C.grid(panel(spark, d), "key", slices, ["l_quantity"], ["price"], ["l_tax", "l_discount"]), ("slice",))


_AUDIT = [("l_quantity", CONTROLS), ("is_f", CONTROLS)]


@query(
    "d32_category_audit",
    "SELECT treatment, round(r2, 5) AS r2_controls, round(1 - r2, 5) AS left_over, CASE WHEN 1 - r2 < 0.02 THEN 'drop' WHEN r2 > 0.8 THEN 'move-to-controls' ELSE 'keep' END AS advice FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS treatment, {X.r2(t, c)} AS r2" for t, c in _AUDIT)
    + ")",
)
def category_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = C.category_audit(wide(spark, d), "key", [t for t, _ in _AUDIT], CONTROLS)
    return _rows(spark, [(r["treatment"], round(r["r2_controls"], 5), round(r["left_over"], 5), r["advice"]) for r in rows], "treatment string, r2_controls double, left_over double, advice string")


_HELD = f"""WITH p AS (SELECT *, ('0x' || substr(md5('42:' || key), 1, 8))::BIGINT % 10 AS fold FROM {X.PANEL}), w AS (SELECT regr_slope(high, l_tax) AS b, regr_intercept(high, l_tax) AS a FROM p WHERE fold >= 3),
 o AS (SELECT high AS t, round(a + b * l_tax, 9) AS s, a + b * l_tax AS e FROM p, w WHERE fold < 3), c AS (SELECT s, sum(t) AS ones, sum(1 - t) AS zeros FROM o GROUP BY s),
 q AS (SELECT ones, zeros, coalesce(sum(zeros) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT 'high' AS treatment, (SELECT count(*) FROM o) AS n_held_out, (SELECT round(1 - sum(pow(t - e, 2)) / (count(*) * var_pop(t)), 5) FROM o) AS r2, (SELECT round(sum(ones * (below + zeros / 2)) / (sum(ones) * sum(zeros)), 5) FROM q) AS auc"""


@query("d35_hold_out", _HELD)
def hold_out(spark: SparkSession, d: str) -> DataFrame:
    r = C.hold_out(wide(spark, d), "key", "high", ["l_tax"])
    return _rows(spark, [(r["treatment"], r["n_held_out"], round(r["r2"], 5), round(r["auc"], 5))], "treatment string, n_held_out long, r2 double, auc double")


@query(
    "d36_drop_a_treatment",
    X.union(
        [X.plr("price", t, ["l_tax"], extra=f"'{t}' AS treatment, 'A' AS spec, ") for t in ("l_quantity", "l_discount", "high")]
        + [X.plr("price", t, ["l_tax", o], extra=f"'{t}' AS treatment, 'B without high' AS spec, ") for t, o in (("l_quantity", "l_discount"), ("l_discount", "l_quantity"))]
    ),
)
def drop_a_treatment(spark: SparkSession, d: str) -> DataFrame:
    """Single fits of all treatments, and mutually controlled ones of those that stay when one is removed."""
    rows = wide(spark, d)
    single = [r | {"spec": "A"} for r in C.grid(rows, "key", {"all": None}, ["l_quantity", "l_discount", "high"], ["price"], ["l_tax"])]
    both = [r | {"spec": "B without high"} for r in C.grid(rows, "key", {"all": None}, ["l_quantity", "l_discount"], ["price"], ["l_tax"], mutual=True)]
    return fitted(spark, single + both, ("treatment", "spec"))


@query("d37_paired_specs", X.union([X.plr("price", t, CONTROLS, extra=f"'{n}' AS spec, ") for n, t in (("code", "l_quantity"), ("judged", "high"))]))
def paired_specs(spark: SparkSession, d: str) -> DataFrame:
    """The same model with a treatment measured in two ways."""
    rows = wide(spark, d)
    return fitted(spark, [{"spec": n} | C.plr(rows, "key", "price", t, CONTROLS) for n, t in (("code", "l_quantity"), ("judged", "high"))], ("spec",))


@query(
    "d38_data_set_grid",
    X.union([X.plr(y, t, ["l_tax"], f"l_linestatus = '{s}'", extra=f"'{s}' AS slice, '{y}' AS outcome, '{t}' AS treatment, ") for s in "FO" for y in ("price", "l_discount") for t in ("l_quantity", "high")]),
)
def data_set_grid(spark: SparkSession, d: str) -> DataFrame:
    """Data sets x outcomes x treatments."""
    slices = {s: F.col("l_linestatus") == s for s in "FO"}
    rows = C.grid(wide(spark, d), "key", slices, ["l_quantity", "high"], ["price", "l_discount"], ["l_tax"])
    return fitted(spark, rows, ("slice", "outcome", "treatment"))


_HALO = X.PANEL.replace("AS high FROM lineitem)", "AS high, (count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey) > 0)::INT::DOUBLE AS earned FROM lineitem)")


@query("d39_halo_effect", X.union([X.plr("price", "earned", CONTROLS, panel=_HALO)]))
def halo(spark: SparkSession, d: str) -> DataFrame:
    """An order's earned co-appearance as the treatment of its lines."""
    lines = table(spark, d, "lineitem")
    has = lines.groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).cast("double").alias("earned"))
    rows = panel(spark, d).withColumn("l_orderkey", F.split_part("key", F.lit(":"), F.lit(1)).cast("long")).join(has, "l_orderkey")
    return fitted(spark, [C.plr(rows, "key", "price", "earned", CONTROLS)])


@query(
    "d10_admitted_sample",
    """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey, variant FROM lineitem, (VALUES ('biased'), ('neutral')) AS g(variant) WHERE (variant = 'biased' AND l_linenumber <= 2) OR (variant = 'neutral' AND l_discount > 0.05)),
 k AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY ALL) SELECT variant, count(*) AS n, sum(line)::BIGINT AS lines FROM o JOIN k USING (l_orderkey, l_suppkey) GROUP BY ALL""",
)
def admitted(spark: SparkSession, d: str) -> DataFrame:
    """The admitted rows of all variants with their first known features."""
    lines = table(spark, d, "lineitem")
    design = spark.createDataFrame([("biased",), ("neutral",)], "variant string")
    hits = F.array_compact(F.array(F.when(F.col("l_linenumber") <= 2, F.lit("biased")), F.when(F.col("l_discount") > 0.05, F.lit("neutral"))))
    out = lines.select("l_orderkey", "l_suppkey", F.explode(hits).alias("variant")).distinct()
    rows = Adm.frame(lines, out, lines.withColumn("line", F.col("l_linenumber").cast("long")), design, ["l_orderkey", "l_suppkey"], ["variant"], ["line"], "line")
    return rows.where("selected = 1").groupBy("variant").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))
