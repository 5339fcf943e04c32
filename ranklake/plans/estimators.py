"""Regressions and partially linear models on the order lines, and the admission frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import admission as Adm
from ..operators import causal as C
from . import crossfit as X
from .registry import query, table

CONTROLS = ["l_tax", "l_linenumber"]


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with a key, a price per unit as outcome and two treatments."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_extendedprice") / 1000).alias("price"))


def _rounded(spark: SparkSession, rows: list[dict], text: tuple[str, ...]) -> DataFrame:
    numbers = [c for c in rows[0] if c not in text]
    schema = ", ".join([f"{c} string" for c in text] + [f"{c} double" for c in numbers])
    clean = [tuple([r.get(c) for c in text] + [None if r.get(c) is None or r[c] != r[c] else round(float(r[c]), 6) for c in numbers]) for r in rows]
    return spark.createDataFrame(clean, schema)


@query(
    "d1_impute_scale",
    "WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars::DOUBLE END AS x FROM documents), f AS (SELECT doc_id, coalesce(x, (SELECT median(x) FROM x)) AS x FROM x) SELECT doc_id, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) AS z FROM f",
)
def impute(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("double")).alias("x"))
    return C.standardise(C.impute(rows, ["x"]), ["x"]).select("doc_id", F.round("x", 6).alias("z"))


_OLS = "regr_slope(l_extendedprice / 1000, l_quantity)"
_SSE = "(regr_syy(l_extendedprice / 1000, l_quantity) - regr_slope(l_extendedprice / 1000, l_quantity) * regr_sxy(l_extendedprice / 1000, l_quantity))"


@query(
    "d4_ols",
    f"""SELECT round({_OLS}, 6) AS coef, round(sqrt({_SSE} / (count(*) - 2) / regr_sxx(l_extendedprice / 1000, l_quantity)), 6) AS se, round(regr_r2(l_extendedprice / 1000, l_quantity), 6) AS r2, count(*)::DOUBLE AS n_obs FROM lineitem""",
)
def ols(spark: SparkSession, d: str) -> DataFrame:
    r = C.ols(panel(spark, d), "price", "l_quantity", [])
    return _rounded(spark, [{k: r[k] for k in ("coef", "se", "r2", "n_obs")}], ())


@query("d23_d24_robust_ols", X.union([X.ols("price", "l_quantity", "l_tax", kind) for kind in ("none", "hc1", "hc3")]))
def robust(spark: SparkSession, d: str) -> DataFrame:
    rows = [{"errors": e} | C.ols(panel(spark, d), "price", "l_quantity", ["l_tax"], e) for e in ("none", "hc1", "hc3")]
    return _rounded(spark, [{c: r[c] for c in ("errors", "coef", "se", "n_obs")} for r in rows], ("errors",))


#: What the estimates' oracles hold.
FIT = ("n_obs", "coef", "se", "ci_lower", "ci_upper", "r2_outcome", "r2_treatment")


def fitted(spark: SparkSession, rows: list[dict], text: tuple[str, ...] = ()) -> DataFrame:
    """The rows' text columns and FIT, rounded as in the oracles."""
    out = spark.createDataFrame([tuple([r[c] for c in text] + [float(r[c]) for c in FIT]) for r in rows], ", ".join([f"{c} string" for c in text] + [f"{c} double" for c in FIT]))
    return out.select(*text, "n_obs", F.round("coef", 5).alias("coef"), F.round("se", 6).alias("se"), *[F.round(c, 5).alias(c) for c in FIT[3:]])


@query("d2_d6_d7_plr", X.union([X.plr("price", "l_quantity", CONTROLS)]))
def plr(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, [C.plr(panel(spark, d), "key", "price", "l_quantity", CONTROLS)])


@query("d2_plr_trees")
def plr_trees(spark: SparkSession, d: str) -> DataFrame:
    """Two folds of short boosted trees on one cell."""
    r = C.plr(panel(spark, d).where("l_returnflag = 'A' and l_linestatus = 'F'"), "key", "price", "l_quantity", CONTROLS, k=2, learner="trees")
    return _rounded(spark, [{k: v for k, v in r.items() if k != "error"}], ())


@query("d3_irm")
def irm(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).withColumn("high", (F.col("l_quantity") > 25).cast("double"))
    return _rounded(spark, [C.irm(rows, "key", "price", "high", CONTROLS, k=2)], ())


def _grid_sql() -> str:
    rows = []
    for spec, mutual in (("A", False), ("B", True)):
        for name, where in (("pooled", "true"), ("engine=A", "l_returnflag = 'A'")):
            for t, other in (("l_quantity", "l_discount"), ("l_discount", "l_quantity")):
                rows.append(X.plr("price", t, CONTROLS + [other] * mutual, where, extra=f"'{name}' AS slice, 'price' AS outcome, '{t}' AS treatment, '{spec}' AS spec, "))
    return X.union(rows)


@query("d5_d12_d40_grid", _grid_sql())
def fits(spark: SparkSession, d: str) -> DataFrame:
    """Pooled and per-engine fits of two treatments, alone and mutually controlled."""
    rows = panel(spark, d)
    slices = {"pooled": None, "engine=A": F.col("l_returnflag") == "A"}
    found = [r | {"spec": s} for s, m in (("A", False), ("B", True)) for r in C.grid(rows, "key", slices, ["l_quantity", "l_discount"], ["price"], CONTROLS, mutual=m)]
    return fitted(spark, found, ("slice", "outcome", "treatment", "spec"))


@query(
    "d13_bonferroni",
    """WITH z AS (SELECT c_nationkey % 5 AS g, c_custkey, least(abs(c_acctbal) / 100000, 1.0) AS p FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n_tests FROM z)
SELECT g, c_custkey, n_tests, round(least(p * n_tests, 1.0), 6) AS p_bonferroni, p < 0.05 / n_tests AS passes FROM n""",
)
def corrected(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("g"), "c_custkey", F.least(F.abs("c_acctbal") / 100000, F.lit(1.0)).alias("p_val"))
    return C.bonferroni(rows, ["g"]).select("g", "c_custkey", "n_tests", F.round("p_bonferroni", 6).alias("p_bonferroni"), "passes")


_JOINT = f"""WITH {X.residuals(["price", "l_quantity", "l_discount"], CONTROLS)}, s AS (SELECT sum(r_l_quantity * r_l_quantity) AS s11, sum(r_l_quantity * r_l_discount) AS s12, sum(r_l_discount * r_l_discount) AS s22,
 sum(r_l_quantity * r_price) AS s1, sum(r_l_discount * r_price) AS s2, s11 * s22 - s12 * s12 AS dt, (s1 * s22 - s2 * s12) / dt AS b1, (s2 * s11 - s1 * s12) / dt AS b2 FROM r),
 e AS (SELECT r_price - b1 * r_l_quantity - b2 * r_l_discount AS e, (s22 * r_l_quantity - s12 * r_l_discount) / dt AS u1, (s11 * r_l_discount - s12 * r_l_quantity) / dt AS u2, b1, b2 FROM r, s)
SELECT 'l_quantity' AS treatment, round(any_value(b1), 5) AS coef, round(sqrt(sum(u1 * u1 * e * e)), 5) AS se FROM e UNION ALL SELECT 'l_discount', round(any_value(b2), 5), round(sqrt(sum(u2 * u2 * e * e)), 5) FROM e"""


@query("d14_joint", _JOINT)
def joint(spark: SparkSession, d: str) -> DataFrame:
    """Both treatments at once; the joint intervals, which are drawn, are left to the tests."""
    rows = C.joint_plr(panel(spark, d), "key", "price", ["l_quantity", "l_discount"], CONTROLS)
    return spark.createDataFrame([(r["treatment"], round(r["coef"], 5), round(r["se"], 5)) for r in rows], "treatment string, coef double, se double")


_LOSSES = f"""WITH v AS (SELECT {X.r2("price", ["l_quantity", "l_discount", "l_tax"])} AS r2, {X.r2("price", ["l_discount", "l_tax"])} AS q, {X.r2("price", ["l_quantity", "l_tax"])} AS d, {X.r2("price", ["l_quantity", "l_discount"])} AS t),
 u AS (SELECT r2, unnest(['l_quantity', 'l_discount', 'l_tax']) AS control, unnest([q, d, t]) AS w FROM v) SELECT control, round(r2, 5) AS r2, round(w, 5) AS r2_without, round(r2 - w, 5) AS loss FROM u"""


@query("d18_d22_r2_losses", _LOSSES)
def losses(spark: SparkSession, d: str) -> DataFrame:
    rows = C.leave_one_out(panel(spark, d), "key", "price", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(r["control"], *(round(r[c], 5) for c in ("r2", "r2_without", "loss"))) for r in rows], "control string, r2 double, r2_without double, loss double")


@query("d21_importance")
def importance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(spark, C.importance(panel(spark, d), "price", ["l_quantity", "l_discount", "l_tax"], 3), ("control",))


_SENSITIVITY = f"""WITH f AS (WITH {X.residuals(["price", "l_quantity"], CONTROLS)}, t AS (SELECT sum(r_l_quantity * r_price) / sum(r_l_quantity * r_l_quantity) AS theta FROM r)
 SELECT any_value(theta) AS coef, sqrt(sum(pow(r_l_quantity * (r_price - theta * r_l_quantity), 2))) / sum(r_l_quantity * r_l_quantity) AS se, sum(r_price * r_price) / count(*) AS sigma, count(*) / sum(r_l_quantity * r_l_quantity) AS nu, count(*)::DOUBLE AS n_obs FROM r, t),
 b AS (SELECT *, sqrt(sigma * nu) AS scale, sqrt(0.03 * 0.03 / 0.97) * scale AS bias, pow(abs(coef) / scale, 2) AS q, pow((abs(coef) - 1.645 * se) / scale, 2) AS qa FROM f)
SELECT n_obs, round(coef - bias, 5) AS lower, round(coef + bias, 5) AS upper, round(bias, 5) AS bias, round(0.5 * (sqrt(q * q + 4 * q) - q), 5) AS rv, CASE WHEN abs(coef) <= 1.645 * se THEN 0.0 ELSE round(0.5 * (sqrt(qa * qa + 4 * qa) - qa), 5) END AS rva FROM b"""


@query("d26_sensitivity", _SENSITIVITY)
def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    r = C.plr(rows, "key", "price", "l_quantity", CONTROLS)
    v = rows.agg(F.var_pop("price"), F.var_pop("l_quantity")).first()
    s = C.sensitivity(r["coef"], r["se"], r["n_obs"], r["r2_outcome"], r["r2_treatment"], v[0], v[1])
    names = ("lower", "upper", "bias", "rv", "rva")
    return spark.createDataFrame([(float(s["n_obs"]), *(round(float(s[c]), 5) for c in names))], "n_obs double, " + ", ".join(f"{c} double" for c in names))


@query("d28_reproduction_gate", "SELECT count(*) AS n, 0.0::DOUBLE AS worst, true AS signs_hold FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def gate(spark: SparkSession, d: str) -> DataFrame:
    fits_ = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("coef"), F.round(F.stddev("l_quantity"), 6).alias("se"))
    return C.reproduced(fits_, fits_, ["l_returnflag"])


_ERF = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x))"


@query(
    "d29_paired_t",
    f"""WITH d AS (SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem), s AS (SELECT l_returnflag, count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY ALL)
SELECT l_returnflag, n, round(m, 6) AS mean_diff, round(m / (sd / sqrt(n)), 5) AS t_stat FROM s""",
)
def paired(spark: SparkSession, d: str) -> DataFrame:
    return C.paired_t(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax").select("l_returnflag", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t_stat", 5).alias("t_stat"))


@query(
    "d30_coefficient_difference",
    """WITH s AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, stddev_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS sa, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b, stddev_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') AS sb FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round((a - b) / sqrt(sa * sa + sb * sb), 6) AS z FROM s""",
)
def difference(spark: SparkSession, d: str) -> DataFrame:
    q = lambda f, v: f(F.when(F.col("l_returnflag") == v, F.col("l_quantity")))
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(q(F.avg, "A").alias("a"), q(F.stddev_samp, "A").alias("sa"), q(F.avg, "R").alias("b"), q(F.stddev_samp, "R").alias("sb"))
    z, _ = C.coefficient_difference(F.col("a"), F.col("sa"), F.col("b"), F.col("sb"))
    return s.select("l_suppkey", F.round(z, 6).alias("z"))


_CORR = ("l_quantity", "l_discount"), ("l_tax", "l_extendedprice")


@query("d31_correlations", " UNION ALL ".join(f"SELECT '{r}' AS \"row\", '{c}' AS \"column\", round(corr({r}, {c}), 6) AS r FROM lineitem" for r in _CORR[0] for c in _CORR[1]))
def correlations(spark: SparkSession, d: str) -> DataFrame:
    return C.correlations(table(spark, d, "lineitem"), *_CORR).withColumn("r", F.round("r", 6))


@query("d33_effect_sizes", "SELECT l_returnflag, round(0.5 / avg(l_quantity), 6) AS of_base, round(0.5 * stddev_samp(l_discount) / avg(l_quantity), 6) AS of_sd FROM lineitem GROUP BY ALL")
def effects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(0.5 / F.avg("l_quantity"), 6).alias("of_base"), F.round(0.5 * F.stddev_samp("l_discount") / F.avg("l_quantity"), 6).alias("of_sd"))


_DESIGN = "(VALUES ('biased', 'm1'), ('biased_rag', 'm1'), ('neutral', 'm2')) AS g(variant, model)"


@query(
    "d9_admission_frame",
    f"""WITH pool AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), out AS (SELECT DISTINCT l_orderkey, l_suppkey, variant, model FROM lineitem, {_DESIGN} WHERE (variant = 'biased' AND l_linenumber <= 2) OR (variant = 'biased_rag' AND l_linenumber = 1 AND l_quantity > 40) OR (variant = 'neutral' AND l_discount > 0.05)),
 f AS (SELECT p.l_orderkey, p.l_suppkey, g.variant, g.model, (o.l_orderkey IS NOT NULL)::INT AS selected FROM pool p CROSS JOIN {_DESIGN} LEFT JOIN out o ON p.l_orderkey = o.l_orderkey AND p.l_suppkey = o.l_suppkey AND g.variant = o.variant AND g.model = o.model
 WHERE g.variant <> 'biased_rag' OR p.l_orderkey IN (SELECT l_orderkey FROM out WHERE variant = 'biased_rag'))
SELECT variant, model, round(avg(selected), 6) AS rate, sum(selected)::BIGINT AS n_selected, count(*) AS n_pool FROM f GROUP BY ALL""",
)
def admission(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    design = spark.createDataFrame([("biased", "m1"), ("biased_rag", "m1"), ("neutral", "m2")], "variant string, model string")
    kinds = {"biased": F.col("l_linenumber") <= 2, "biased_rag": (F.col("l_linenumber") == 1) & (F.col("l_quantity") > 40), "neutral": F.col("l_discount") > 0.05}
    hits = F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in kinds.items()]))
    out = lines.select("l_orderkey", "l_suppkey", F.explode(hits).alias("variant")).distinct().join(F.broadcast(design), "variant")
    rows = Adm.frame(lines, out, lines, design, ["l_orderkey", "l_suppkey"], ["variant", "model"], ["l_quantity"], "l_linenumber")
    return Adm.rates(rows, ["variant", "model"])


@query(
    "c36_effect_sentences",
    "SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN 'x raises y by 0.5000' WHEN l_returnflag = 'N' THEN 'x lowers y by 0.2500' ELSE 'x has no clear effect on y' END AS said FROM (SELECT DISTINCT l_returnflag FROM lineitem)",
)
def sentences(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    coef = F.when(flag == "A", 0.5).otherwise(-0.25)
    p = F.when(flag == "R", 0.4).otherwise(0.01)
    return table(spark, d, "lineitem").select(flag).distinct().select(flag, M.effect_sentence(F.lit("x"), coef, p, F.lit("y")).alias("said"))
