"""Regressions and partially linear models by distributed sums; only K x K algebra runs on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import normal_tail


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs of columns, in one pass, and the row count."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count(F.lit(1)), *[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])) for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


def impute(df: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """Fills nulls by the exact median or zero, or drops incomplete rows."""
    if how == "complete":
        return df.na.drop(subset=list(columns))
    if how == "zero":
        return df.na.fill(0.0, subset=list(columns))
    row = df.agg(*[F.median(c).alias(c) for c in columns]).first()
    return df.fillna({c: float(row[c]) for c in columns if row[c] is not None})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minus the mean, over the population deviation; constant columns become 0."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"] if row[f"s_{c}"] else F.lit(0.0) for c in columns})


def _solved(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.linalg.pinv(g[:k, :k])
    return inverse @ g[:k, k], inverse


def student_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def ols(df: DataFrame, outcome: str, treatment: str, controls: Sequence[str], robust: str = "none") -> dict:
    """Least squares with an intercept; errors are classical, or robust as HC1 or HC3 from a second pass."""
    cols = [treatment, *controls]
    rows = df.select(F.lit(1.0).alias("__one"), *[F.col(c).cast("double") for c in [*cols, outcome]]).na.drop()
    g, n = gram(rows, [*cols, "__one", outcome])
    k = len(cols) + 1
    beta, inverse = _solved(g, k)
    sse = g[k, k] - beta @ g[:k, k]
    if robust == "none":
        variance = inverse * sse / max(n - k, 1)
    else:
        names = [*cols, "__one"]
        fit = sum((F.col(c) * float(b) for c, b in zip(names, beta, strict=True)), F.lit(0.0))
        e2 = F.pow(F.col(outcome) - fit, 2)
        if robust == "hc3":
            leverage = sum((F.col(names[i]) * F.col(names[j]) * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
            e2 = e2 / F.pow(1 - leverage, 2)
        weighted = rows.withColumn("__w", F.sqrt(e2))
        meat, _ = gram(weighted.select(*[(F.col(c) * F.col("__w")).alias(c) for c in names]), names)
        variance = inverse @ meat @ inverse * (n / (n - k) if robust == "hc1" else 1.0)
    se = math.sqrt(max(variance[0, 0], 0.0))
    t = beta[0] / se if se else float("nan")
    mean = g[len(cols), k] / n if n else float("nan")
    sst = g[k, k] - n * mean * mean
    return {"coef": float(beta[0]), "se": se, "t_stat": t, "p_val": student_tail(t, n - k), "ci_lower": beta[0] - 1.96 * se, "ci_upper": beta[0] + 1.96 * se, "n_obs": n, "r2": float(1 - sse / sst) if sst > 0 else float("nan")}


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` by a digest of the key: the first 32 bits of MD5("seed:key"), modulo k."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("fold", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def _linear_residuals(df: DataFrame, target: str, controls: Sequence[str], k: int) -> Column:
    """Out-of-fold residual of a linear fit: each fold's weights come from the sums of the others."""
    names = [*controls, "__one"]
    rows = df.withColumn("__one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy("fold").agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col(names[i]).cast("double") * F.col(target)).alias(f"b{i}") for i in range(len(names))]).collect()  # one row a fold
    per = {}
    for r in sums:
        g = np.zeros((len(names), len(names)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
        per[r["fold"]] = g, np.array([r[f"b{i}"] or 0.0 for i in range(len(names))])
    out = F.lit(None).cast("double")
    for f in per:
        rest = [per[o] for o in per if o != f]
        if not rest:
            rest = [per[f]]
        g, b = sum(x[0] for x in rest), sum(x[1] for x in rest)
        beta = np.linalg.pinv(g) @ b
        fit = sum((F.col(c).cast("double") * float(w) for c, w in zip(controls, beta, strict=False)), F.lit(float(beta[-1])))
        out = F.when(F.col("fold") == f, F.col(target).cast("double") - fit).otherwise(out)
    return out


def _tree_residuals(df: DataFrame, target: str, controls: Sequence[str], k: int, trees: int = 20, depth: int = 5) -> DataFrame:
    """Out-of-fold residuals of gradient-boosted trees, as column ``__r_target``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=list(controls), outputCol="__x").transform(df)
    parts = []
    for f in range(k):
        model = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="__p", maxIter=trees, maxDepth=depth, seed=42).fit(rows.where(F.col("fold") != f))
        parts.append(model.transform(rows.where(F.col("fold") == f)).withColumn(f"__r_{target}", F.col(target) - F.col("__p")).drop("__p", "__x"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def residuals(df: DataFrame, targets: Sequence[str], controls: Sequence[str], k: int = 5, learner: str = "linear") -> DataFrame:
    """df (with ``fold``) and the out-of-fold residuals __r_target of each target."""
    if learner == "linear":
        return df.withColumns({f"__r_{t}": _linear_residuals(df, t, controls, k) for t in targets})
    for t in targets:
        df = _tree_residuals(df, t, controls, k)
    return df


def plr(df: DataFrame, key: str, outcome: str, treatment: str, controls: Sequence[str], k: int = 5, learner: str = "linear", least: int = 200) -> dict:
    """Cross-fitted partially linear regression: theta = sum(d y) / sum(d d) on residuals, with the sandwich error."""
    cols = [outcome, treatment, *controls]
    rows = folds(df.select(key, *[F.col(c).cast("double") for c in cols]).na.drop(), key, k)
    r = residuals(rows, [outcome, treatment], controls, k, learner)
    d, y = F.col(f"__r_{treatment}"), F.col(f"__r_{outcome}")
    o, t = F.col(outcome), F.col(treatment)
    s = r.agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("dd"), F.sum(d * y).alias("dy"), F.sum(F.pow(d, 2) * y * y).alias("d2y2"), F.sum(F.pow(d, 3) * y).alias("d3y"), F.sum(F.pow(d, 4)).alias("d4"), F.sum(y * y).alias("yy"), F.var_pop(o).alias("vy"), F.var_pop(t).alias("vd")).first()
    out = {"n_obs": s["n"], "coef": float("nan"), "se": float("nan"), "t_stat": float("nan"), "p_val": float("nan"), "ci_lower": float("nan"), "ci_upper": float("nan")}
    if s["n"] < least or not s["dd"]:
        return out | {"error": "too few rows" if s["n"] < least else "constant treatment"}
    theta = s["dy"] / s["dd"]
    se = math.sqrt(max(s["d2y2"] - 2 * theta * s["d3y"] + theta * theta * s["d4"], 0.0)) / s["dd"]
    z = theta / se if se else float("nan")
    out |= {"coef": theta, "se": se, "t_stat": z, "p_val": math.erfc(abs(z) / math.sqrt(2)) if se else float("nan"), "ci_lower": theta - 1.96 * se, "ci_upper": theta + 1.96 * se}
    out |= {"r2_outcome": 1 - s["yy"] / (s["n"] * s["vy"]) if s["vy"] else float("nan"), "r2_treatment": 1 - s["dd"] / (s["n"] * s["vd"]) if s["vd"] else float("nan"), "error": None}
    return out


def irm(df: DataFrame, key: str, outcome: str, treatment: str, controls: Sequence[str], k: int = 5, clip: float = 0.01) -> dict:
    """Average effect of a binary treatment by the doubly robust score, with linear outcome and logistic propensity models."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    rows = df.select(key, *[F.col(c).cast("double") for c in (outcome, treatment, *controls)]).na.drop()
    rows = VectorAssembler(inputCols=list(controls), outputCol="__x").transform(folds(rows, key, k))
    parts = []
    for f in range(k):
        fit, own = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        m = LogisticRegression(featuresCol="__x", labelCol=treatment, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred").fit(fit)
        own = m.transform(own).withColumn("__p", vector_to_array("__p")[1]).drop("__raw", "__pred")
        for v in (0, 1):
            g = LinearRegression(featuresCol="__x", labelCol=outcome, predictionCol=f"__g{v}").fit(fit.where(F.col(treatment) == v))
            own = g.transform(own)
        parts.append(own)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    y, d, p, g0, g1 = F.col(outcome), F.col(treatment), F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("__p"))), F.col("__g0"), F.col("__g1")
    psi = g1 - g0 + d * (y - g1) / p - (1 - d) * (y - g0) / (1 - p)
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(psi).alias("m"), F.stddev_pop(psi).alias("s")).first()
    se = s["s"] / math.sqrt(s["n"])
    return {"coef": s["m"], "se": se, "t_stat": s["m"] / se, "n_obs": s["n"]}


def grid(df: DataFrame, key: str, slices: dict[str, Column | None], treatments: Sequence[str], outcomes: Sequence[str], controls: Sequence[str], least: int = 10, learner: str = "linear", mutual: bool = False) -> list[dict]:
    """One fit for each slice, outcome and treatment; failures are rows with an error. With ``mutual`` the other
    treatments join the controls."""
    out = []
    for name, where in slices.items():
        part = df if where is None else df.where(where)
        for y in outcomes:
            for t in treatments:
                x = [c for c in controls if c != t] + ([o for o in treatments if o != t] if mutual else [])
                row = {"slice": name, "outcome": y, "treatment": t, "method": "plr", "learner": learner}
                try:
                    out.append(row | plr(part, key, y, t, x, learner=learner, least=least))
                except (ArithmeticError, np.linalg.LinAlgError) as e:  # the row keeps what went wrong
                    out.append(row | {"n_obs": 0, "coef": float("nan"), "se": float("nan"), "error": str(e)[:200]})
    return out


def bonferroni(df: DataFrame, groups: list[str], p: str = "p_val", level: float = 0.05) -> DataFrame:
    """p times the number of tests of the group, at most 1, and whether it stays under the level."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    return df.withColumn("n_tests", n).withColumn("p_bonferroni", F.least(F.col(p) * F.col("n_tests"), F.lit(1.0))).withColumn("passes", F.col(p) < level / F.col("n_tests"))


def paired_t(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    out = df.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    t = F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))
    return out.withColumn("t_stat", t).withColumn("p_val", normal_tail(t))


def coefficient_difference(a: Column, se_a: Column, b: Column, se_b: Column) -> tuple[Column, Column]:
    """z and p of a - b with independent errors."""
    z = F.try_divide(a - b, F.sqrt(se_a * se_a + se_b * se_b))
    return z, normal_tail(z)


def correlations(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair on complete rows, one row a pair."""
    from ..functions.measures import safe_corr

    pairs = [(r, c) for r in rows for c in columns]
    part = df.select(*[F.col(c).cast("double") for c in dict.fromkeys([*rows, *columns])]).na.drop()
    wide = part.agg(*[safe_corr(F.col(r), F.col(c)).alias(f"{i}") for i, (r, c) in enumerate(pairs)])
    cells = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.col(f"{i}").alias("r")) for i, (r, c) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def cross_fit_r2(df: DataFrame, key: str, target: str, controls: Sequence[str], k: int = 5, learner: str = "linear") -> float:
    rows = folds(df.select(key, *[F.col(c).cast("double") for c in (target, *controls)]).na.drop(), key, k)
    r = residuals(rows, [target], controls, k, learner)
    s = r.agg(F.sum(F.pow(F.col(f"__r_{target}"), 2)).alias("sse"), F.var_pop(target).alias("v"), F.count(F.lit(1)).alias("n")).first()
    return 1 - s["sse"] / (s["n"] * s["v"]) if s["v"] else float("nan")


def leave_one_out(df: DataFrame, key: str, target: str, controls: Sequence[str], k: int = 5) -> list[dict]:
    """Loss of cross-fitted R2 without each control."""
    whole = cross_fit_r2(df, key, target, controls, k)
    return [{"control": c, "r2": whole, "r2_without": (w := cross_fit_r2(df, key, target, [x for x in controls if x != c], k)), "loss": whole - w} for c in controls]


def importance(df: DataFrame, target: str, controls: Sequence[str], trees: int = 10) -> list[dict]:
    """Share of split gain of each control in boosted trees, with its rank."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=list(controls), outputCol="__x").transform(df.select(*[F.col(c).cast("double") for c in (target, *controls)]).na.drop())
    values = GBTRegressor(featuresCol="__x", labelCol=target, maxIter=trees, seed=42).fit(rows).featureImportances.toArray()
    order = np.argsort(np.argsort(-values, kind="stable"), kind="stable")
    return [{"control": c, "share": float(v), "rank": int(r) + 1} for c, v, r in zip(controls, values, order, strict=True)]


def joint_plr(df: DataFrame, key: str, outcome: str, treatments: Sequence[str], controls: Sequence[str], draws: int = 500, seed: int = 42, k: int = 5) -> list[dict]:
    """All treatments at once on residuals, with joint intervals by a Gaussian multiplier bootstrap and step-down p-values.

    Only K x K sums leave the cluster; the multiplier draws use the asymptotic normal law of the scores.
    """
    rows = folds(df.select(key, *[F.col(c).cast("double") for c in (outcome, *treatments, *controls)]).na.drop(), key, k)
    r = residuals(rows, [outcome, *treatments], controls, k)
    names = [f"__r_{t}" for t in treatments]
    g, n = gram(r, [*names, f"__r_{outcome}"])
    m = len(names)
    theta, inverse = _solved(g, m)
    e = F.col(f"__r_{outcome}") - sum((F.col(c) * float(b) for c, b in zip(names, theta, strict=True)), F.lit(0.0))
    meat, _ = gram(r.withColumn("__e", e).select(*[(F.col(c) * F.col("__e")).alias(c) for c in names]), names)
    cov = inverse @ meat @ inverse
    se = np.sqrt(np.diag(cov))
    t = np.abs(theta / se)
    z = np.abs(np.random.default_rng(seed).multivariate_normal(np.zeros(m), cov / np.outer(se, se), draws, method="eigh"))
    limit = float(np.quantile(z.max(axis=1), 0.95))
    p, seen = np.zeros(m), 0.0
    order = np.argsort(-t)
    for i, j in enumerate(order):
        seen = max(seen, float((z[:, order[i:]].max(axis=1) >= t[j]).mean()))
        p[j] = seen
    return [{"treatment": c, "coef": float(theta[i]), "se": float(se[i]), "joint_lower": float(theta[i] - limit * se[i]), "joint_upper": float(theta[i] + limit * se[i]), "p_stepdown": float(p[i]), "p_bonferroni": float(min(1.0, m * math.erfc(t[i] / math.sqrt(2)))), "n_obs": n} for i, c in enumerate(treatments)]


def sensitivity(coef: float, se: float, n: int, r2_outcome: float, r2_treatment: float, var_y: float, var_d: float, cf_y: float = 0.03, cf_d: float = 0.03, level: float = 0.05) -> dict:
    """Bias bounds of an omitted variable of given strengths, and the robustness values (point and interval)."""
    sigma = var_y * max(1 - r2_outcome, 0.0)
    nu = 1 / (var_d * max(1 - r2_treatment, 1e-300))
    scale = math.sqrt(sigma * nu)
    bias = math.sqrt(cf_y * cf_d / (1 - cf_d)) * scale

    def value(gap: float) -> float:
        if gap <= 0 or scale == 0:
            return 0.0
        q = (gap / scale) ** 2
        return 0.5 * (math.sqrt(q * q + 4 * q) - q)

    return {"lower": coef - bias, "upper": coef + bias, "rv": value(abs(coef)), "rva": value(abs(coef) - 1.645 * se), "bias": bias, "n_obs": n, "level": level}


def reproduced(new: DataFrame, old: DataFrame, on: list[str]) -> DataFrame:
    """Deviation of re-run coefficients in published errors, and whether every sign holds."""
    both = new.select(*on, "coef").join(old.select(*on, F.col("coef").alias("old"), F.col("se").alias("old_se")), on)
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("coef") - F.col("old")) / F.col("old_se")).alias("worst"), F.bool_and(F.signum("coef") == F.signum("old")).alias("signs_hold"))


def category_audit(df: DataFrame, key: str, treatments: Sequence[str], controls: Sequence[str], high: float = 0.8, k: int = 5) -> list[dict]:
    """For each treatment how well the controls predict it, how far that attenuates an effect, and what to do."""
    out = []
    for t in treatments:
        r2 = cross_fit_r2(df, key, t, controls, k)
        left = 1 - r2
        out.append({"treatment": t, "r2_controls": r2, "left_over": left, "advice": "drop" if left < 0.02 else "move-to-controls" if r2 > high else "keep"})
    return out


def drop_refits(df: DataFrame, key: str, outcome: str, treatment: str, blocks: dict[str, Sequence[str]], controls: Sequence[str], k: int = 5) -> list[dict]:
    """The estimate with all controls and without each named block."""
    sets = {"all": list(controls)} | {f"without {n}": [c for c in controls if c not in b] for n, b in blocks.items()}
    return [{"controls": n, **plr(df, key, outcome, treatment, c, k)} for n, c in sets.items()]


def nuisance_r2(df: DataFrame, key: str, outcomes: Sequence[str], treatments: Sequence[str], controls: Sequence[str], k: int = 5) -> list[dict]:
    """How well the controls predict each outcome and each treatment, out of fold."""
    return [{"side": side, "target": t, "r2": cross_fit_r2(df, key, t, controls, k)} for side, names in (("outcome", outcomes), ("treatment", treatments)) for t in names]


def with_dummies(df: DataFrame, columns: dict[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Indicator columns of the given values (the first one of each column is the base), and their names."""
    names = {f"{c}_{v}": (F.col(c) == v).cast("double") for c, values in columns.items() for v in values[1:]}
    return df.withColumns(names), list(names)


def robust_sample(df: DataFrame, keys: Sequence[str], part: str, parts: Sequence[str]) -> DataFrame:
    """Rows of keys that stand in every one of the parts."""
    held = df.where(F.col(part).isin(*parts)).groupBy(*keys).agg(F.countDistinct(part).alias("__n")).where(F.col("__n") == len(parts))
    return df.join(held.select(*keys), list(keys), "left_semi")


def hold_out(df: DataFrame, key: str, treatment: str, controls: Sequence[str], share: float = 0.3, seed: int = 42) -> dict:
    """R2 and AUC on a held-out share (by digest) of a linear fit on the rest; AUC of a binary treatment by ranks."""
    rows = folds(df.select(key, *[F.col(c).cast("double") for c in (treatment, *controls)]).na.drop(), key, 10, seed)
    cut = int(round(10 * share))
    names = [*controls, "__one"]
    fit = rows.where(F.col("fold") >= cut).withColumn("__one", F.lit(1.0))
    g, _ = gram(fit.select(*names, treatment), [*names, treatment])
    beta, _ = _solved(g, len(names))
    score = sum((F.col(c) * float(b) for c, b in zip(controls, beta, strict=False)), F.lit(float(beta[-1])))
    own = rows.where(F.col("fold") < cut).select(F.col(treatment).alias("t"), score.alias("s"))
    r = own.agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(F.pow(F.col("t") - F.col("s"), 2)), F.count(F.lit(1)) * F.var_pop("t"))).alias("r2")).first()
    return {"treatment": treatment, "n_held_out": r["n"], "r2": r["r2"], "auc": auc(own, "t", "s")}


def auc(df: DataFrame, label: str, score: str, runs: int = 64) -> float | None:
    """The share of (1, 0) pairs in order, ties counting one half, from counts by score (9 digits): no pair is built.
    Runs of scores between approximate quantiles are ordered by themselves, and the zeros of earlier runs are added."""
    from .aggregates import _run_of

    per = df.groupBy(F.round(score, 9).alias("s")).agg(F.sum(label).alias("ones"), F.sum(1 - F.col(label)).alias("zeros"))
    edges = sorted(set(per.agg(F.percentile_approx("s", [i / runs for i in range(1, runs)]).alias("e")).first()["e"] or []))
    per = per.withColumn("run", _run_of(F.col("s"), edges))
    within = F.coalesce(F.sum("zeros").over(Window.partitionBy("run").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = per.withColumn("below", within).groupBy("run").agg(F.sum(F.col("ones") * (F.col("below") + F.col("zeros") / 2)).alias("p"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).collect()
    total = before = ones = 0.0
    for r in sorted(sums, key=lambda x: x["run"]):  # at most ``runs`` rows
        total += r["p"] + r["ones"] * before
        before += r["zeros"]
        ones += r["ones"]
    return total / (ones * before) if ones and before else None
