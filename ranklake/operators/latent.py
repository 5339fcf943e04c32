"""Embedding-space operators: projections, axes, ridge maps, alignments, comparison models.

Vectors stay in arrays; sums over rows are distributed, and only matrices of the size of the vector meet on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import safe_corr
from .ranks import average_rank

#: Items up to which a Bradley-Terry step uses a matrix.
DENSE = 512


def centroid(df: DataFrame, groups: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector of each group: one partial sum a dimension, no vectors gathered."""
    long = df.select(*groups, F.posexplode(vector).alias("__i", "__x"))
    mean = long.groupBy(*groups, "__i").agg(F.avg("__x").alias("__m"))
    return mean.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(out))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def project(df: DataFrame, vector: str, axes: dict[str, Sequence[float]]) -> DataFrame:
    """The coordinate on each unit axis."""
    return df.withColumns({n: A.dot(F.col(vector), literal(np.asarray(a) / np.linalg.norm(a))) for n, a in axes.items()})


def moments(df: DataFrame, vector: str, targets: Sequence[str] = ()) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, and the sums of x'x and x'y with a leading one in x, added up by partition."""

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.array([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)], float).T.reshape(len(x), -1)
            m = x.T @ np.hstack([x, y])
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    cells = df.select(vector, *[F.col(t).cast("double") for t in targets]).na.drop().mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    k = len(targets)
    v = cells.column("v").to_numpy()
    d = int((-k + np.sqrt(k * k + 4 * len(v))) / 2) if len(v) else 0
    m = v.reshape(d, d + k)
    return int(round(m[0, 0])) if d else 0, m[:, :d], m[:, d:]


def ridge(df: DataFrame, vector: str, targets: Sequence[str], penalty: float = 1.0) -> np.ndarray:
    """(1 + dimensions, targets) weights with an unpenalised intercept."""
    _, xx, xy = moments(df, vector, targets)
    p = np.eye(len(xx)) * penalty
    p[0, 0] = 0
    return np.linalg.solve(xx + p, xy)


def leave_one_group_out(df: DataFrame, group: str, vector: str, target: str, penalty: float = 1.0) -> DataFrame:
    """df with ``p``, predicted by a ridge map fitted on all other groups. One pass sums each group's products, the sums
    of the others are the total less its own, and each group's weights are solved in its own task and joined back."""
    import pyarrow as pa

    kind = df.schema[group].dataType.simpleString()

    def sums(batches: Iterator) -> Iterator:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            z = np.hstack([np.ones((len(x), 1)), x, b.column(2).to_numpy(zero_copy_only=False)[:, None]])
            keys = b.column(0).to_pylist()
            for k in dict.fromkeys(keys):
                own = z[[v == k for v in keys]]
                held[k] = held.get(k, 0) + own.T @ own
        for k, m in held.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, group_type), pa.array(range(n), pa.int32()), pa.array(m.ravel())], names=["g", "i", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    group_type = to_arrow_type(df.schema[group].dataType)
    rows = df.select(F.col(group).alias("g"), vector, F.col(target).cast("double")).na.drop()
    per = rows.mapInArrow(sums, f"g {kind}, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v"))
    whole = per.groupBy("i").agg(F.sum("v").alias("t"))
    rest = per.join(whole, "i").select("g", "i", (F.col("t") - F.col("v")).alias("v"))

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        d = int(round(t.num_rows**0.5))
        m = t.column("v").to_numpy().reshape(d, d)
        p = np.eye(d - 1) * penalty
        p[0, 0] = 0
        w = np.linalg.lstsq(m[:-1, :-1] + p, m[:-1, -1], rcond=None)[0]
        return pa.table({"g": t.column("g")[:1], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    weights = rest.groupBy("g").applyInArrow(solve, f"g {kind}, w array<double>").withColumnRenamed("g", group)
    out = df.join(weights, group)
    fit = A.dot(F.transform(F.col(vector), lambda x: x.cast("double")), F.slice("w", 2, F.size("w") - 1)) + F.get("w", F.lit(0))
    return out.withColumn("p", fit).drop("w")


def predict(df: DataFrame, vector: str, weights: np.ndarray, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: A.dot(F.col(vector), literal(weights[1:, i])) + float(weights[0, i]) for i, n in enumerate(names)})


def principal_axes(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, dimensions) axes and their shares of variance; each axis's largest entry is positive."""
    n, xx, _ = moments(df, vector)
    mean = xx[0, 1:] / n
    cov = xx[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return axes * signs[:, None], values[order] / values.sum()


def metrics(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Spearman, Pearson, R2, mean error, that of the mean, and the gain over it, per group."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    ranked = df.withColumns({"__rt": average_rank(t, *groups), "__rp": average_rank(p, *groups)}).withColumn("__m", F.avg(t).over(Window.partitionBy(*groups)))
    mae, base = F.avg(F.abs(t - p)), F.avg(F.abs(t - F.col("__m")))
    out = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("__rt"), F.col("__rp")).alias("spearman"), safe_corr(t, p).alias("pearson"), F.try_divide(F.var_pop(t) - F.avg((t - p) * (t - p)), F.var_pop(t)).alias("r2"), mae.alias("mae"), base.alias("baseline_mae"))
    return out.where(F.col("n") >= least).withColumn("gain", 1 - F.try_divide(F.col("mae"), F.col("baseline_mae")))


def procrustes(df: DataFrame, source: Sequence[str], target: Sequence[str]) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Rotation, scale and both means that bring the source columns nearest to the target columns."""
    s, t = list(source), list(target)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in [*s, *t]], *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(s) for j, b in enumerate(t)], *[F.var_pop(a).alias(f"v_{i}") for i, a in enumerate(s)]).first()
    cross = np.array([[row[f"c_{i}_{j}"] for j in range(len(t))] for i in range(len(s))])
    u, w, v = np.linalg.svd(cross)
    scale = w.sum() / max(sum(row[f"v_{i}"] for i in range(len(s))), 1e-300)
    return u @ v, float(scale), np.array([row[f"m_{c}"] for c in s]), np.array([row[f"m_{c}"] for c in t])


def aligned(df: DataFrame, source: Sequence[str], fit: tuple[np.ndarray, float, np.ndarray, np.ndarray], names: Sequence[str]) -> DataFrame:
    r, scale, ms, mt = fit
    return df.withColumns({n: sum(((F.col(c) - float(ms[i])) * float(scale * r[i, j]) for i, c in enumerate(source)), F.lit(float(mt[j]))) for j, n in enumerate(names)})


def paired_axis(df: DataFrame, pair: str, end: str, vector: str) -> DataFrame:
    """The unit mean of high minus low over all pairs, with the length of the mean before."""
    low = df.where(F.col(end) == 0).select(pair, F.col(vector).alias("__a"))
    high = df.where(F.col(end) == 1).select(pair, F.col(vector).alias("__b"))
    diffs = low.join(high, pair).select(F.lit(0).alias("g"), A.minus(F.transform("__b", lambda x: x.cast("double")), F.transform("__a", lambda x: x.cast("double"))).alias("__d"))
    return centroid(diffs, ["g"], "__d", "mean").select(A.unit(F.col("mean")).alias("axis"), A.norm(F.col("mean")).alias("length"))


def block_slopes(df: DataFrame, block: str, level: str, vector: str) -> DataFrame:
    """For each dimension the slope of the vector on the level, both centred within blocks."""
    w = Window.partitionBy(block)
    long = df.withColumn("__a", F.col(level) - F.avg(level).over(w)).select(block, "__a", F.posexplode(vector).alias("dimension", "__x"))
    wd = Window.partitionBy(block, "dimension")
    centred = long.withColumn("__z", F.col("__x") - F.avg("__x").over(wd))
    return centred.groupBy("dimension").agg(F.try_divide(F.sum(F.col("__a") * F.col("__z")), F.sum(F.col("__a") * F.col("__a"))).alias("slope"))


def comparisons(df: DataFrame, cell: list[str], item: str, level: str, distant: int = 3) -> DataFrame:
    """Neighbouring and distant pairs on a level grid of each cell, in both orders."""
    # an item meets only the levels it is compared with: the join is on cell and level
    steps = F.explode(F.array(F.struct(F.lit("neighbour").alias("kind"), (F.col(level) + 1).alias("__l")), F.struct(F.lit("distant").alias("kind"), (F.col(level) + distant).alias("__l"))))
    a = df.select(*cell, F.col(item).alias("left_id"), steps.alias("__s")).select(*cell, "left_id", "__s.*")
    b = df.select(*cell, F.col(item).alias("right_id"), F.col(level).alias("__l"))
    pairs = a.join(b, [*cell, "__l"]).select(*cell, "left_id", "right_id", "kind")
    turned = pairs.select(*cell, F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "kind", F.lit(True).alias("swapped"))
    return pairs.withColumn("swapped", F.lit(False)).unionByName(turned)


def _step(i: np.ndarray, j: np.ndarray, v: np.ndarray, g: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's step for pairs (i, j) of curvature v; beyond ``DENSE`` items by conjugate gradients, without a matrix."""
    n = len(g)
    if n <= DENSE:
        h = penalty * np.eye(n)
        np.add.at(h, (i, i), v)
        np.add.at(h, (j, j), v)
        np.add.at(h, (i, j), -v)
        np.add.at(h, (j, i), -v)
        return np.linalg.solve(h, g)
    scale = 1 / (np.bincount(i, v, n) + np.bincount(j, v, n) + penalty)
    x, r = np.zeros(n), g.copy()
    d = z = scale * r
    rz, end = r @ z, 1e-24 * max(g @ (scale * g), 1e-300)
    for _ in range(2 * n):
        if rz <= end:
            break
        flow = v * (d[i] - d[j])
        h = np.bincount(i, flow, n) - np.bincount(j, flow, n) + penalty * d
        a = rz / (d @ h)
        x, r = x + a * d, r - a * h
        z = scale * r
        rz, last = r @ z, rz
        d = z + rz / last * d
    return x


def bradley_terry(df: DataFrame, slices: list[str], left: str, right: str, score: str, penalty: float = 0.1, rounds: int = 200) -> DataFrame:
    """(slices, item, strength): ridge-penalised strengths of each slice, mean 0; score is 1, 0.5 or 0 for the left.

    Judgments are first added up by pair; a slice's table of items is what its fit holds.
    """
    sums = df.groupBy(*slices, left, right).agg(F.sum(score).alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def fit(key, rows):
        import pandas as pd

        items = sorted(set(rows[left]) | set(rows[right]))
        at = {x: i for i, x in enumerate(items)}
        i, j = rows[left].map(at).to_numpy(), rows[right].map(at).to_numpy()
        w, n = rows["w"].to_numpy(), rows["n"].to_numpy()
        b = np.zeros(len(items))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(b[i] - b[j])))
            g = np.bincount(i, w - n * p, len(b)) - np.bincount(j, w - n * p, len(b)) - penalty * b
            step = _step(i, j, n * p * (1 - p), g, penalty)
            b += step
            if np.abs(step).max() < 1e-10:
                break
        out = {s: [k] * len(b) for s, k in zip(slices, key, strict=True)}
        return pd.DataFrame(out | {"item": items, "strength": b - b.mean()})

    return sums.groupBy(*slices).applyInPandas(fit, ", ".join(f"{s} {kinds[s]}" for s in slices) + f", item {kinds[left]}, strength double")


def calibrated(df: DataFrame, slices: list[str], strength: str) -> DataFrame:
    """Strengths on [0, 1] between the ends of each slice."""
    w = Window.partitionBy(*slices)
    low, high = F.min(strength).over(w), F.max(strength).over(w)
    return df.withColumn("position", F.coalesce(F.try_divide(F.col(strength) - low, high - low), F.lit(0.5)))


def ordinal_fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Proportional odds: weights and ascending cuts by gradient descent with backtracking on a bounded sample, or on
    different rows with how many times each stands."""
    n = np.ones(len(y)) if times is None else times
    levels = np.unique(y)
    k = np.searchsorted(levels, y)
    share = np.clip(np.cumsum(np.bincount(k, n))[:-1] / n.sum(), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    d = x.shape[1]

    def unpack(p):
        return p[:d], np.concatenate([p[d : d + 1], p[d] + np.cumsum(np.exp(p[d + 1 :]))])

    def loss(p):
        w, c = unpack(p)
        s = 1 / (1 + np.exp(-np.clip(np.concatenate([[-35.0], c, [35.0]])[None, :] - (x @ w)[:, None], -35, 35)))
        prob = np.maximum(s[np.arange(len(k)), k + 1] - s[np.arange(len(k)), k], 1e-12)
        return -(n * np.log(prob)).sum() + penalty / 2 * w @ w

    step, value = 1.0, loss(params)
    for _ in range(rounds):
        g = np.array([(loss(params + e) - loss(params - e)) / 2e-5 for e in np.eye(len(params)) * 1e-5])
        while step > 1e-12:
            new = params - step * g
            if (v := loss(new)) < value:
                params, gain, value, step = new, value - v, v, step * 1.5
                break
            step /= 2
        else:
            break
        if gain < 1e-9:
            break
    return unpack(params)


def replicates(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Every row once for each replicate with a weight from a Poisson(1) law drawn by digest: a bootstrap without a shuffle."""
    digest = lambda r: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), r.cast("string")))
    u = lambda r: (F.conv(F.substring(digest(r), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = lambda x: sum(((x > c).cast("int") for c in cuts), F.lit(0))
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("weight", weight(u(F.col("replicate")))).where("weight > 0")


def bootstrap_mean(df: DataFrame, key: str, x: str, groups: list[str], n: int = 200, seed: int = 42) -> DataFrame:
    """Mean and its 95 % percentile band."""
    r = replicates(df.select(key, x, *groups), key, n, seed).groupBy(*groups, "replicate").agg(F.try_divide(F.sum(F.col(x) * F.col("weight")), F.sum("weight")).alias("__m"))
    band = r.groupBy(*groups).agg(F.percentile("__m", F.lit(0.025)).alias("low"), F.percentile("__m", F.lit(0.975)).alias("high"))
    return df.groupBy(*groups).agg(F.avg(x).alias("mean")).join(band, groups) if groups else df.agg(F.avg(x).alias("mean")).crossJoin(F.broadcast(band))


def permutation_control(df: DataFrame, key: str, x: str, y: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Correlation of x and y, the 95 % point of that under shuffled labels, and a one-sided p. A shuffle pairs the
    rows in key order with the labels in digest order, replicate by replicate."""
    rows = df.select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    many = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    w = Window.partitionBy("replicate")
    a = many.select("replicate", "__x", F.row_number().over(w.orderBy(key)).alias("__n"))
    b = many.select("replicate", "__y", F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("replicate").cast("string"))), key)).alias("__n"))
    null = a.join(b, ["replicate", "__n"]).groupBy("replicate").agg(safe_corr(F.col("__x"), F.col("__y")).alias("r"))
    true = rows.agg(safe_corr(F.col("__x"), F.col("__y")).alias("observed"))
    return null.crossJoin(F.broadcast(true)).agg(F.first("observed").alias("observed"), F.percentile("r", F.lit(0.95)).alias("null_95"), ((F.count_if(F.col("r") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def judgment_diagnostics(df: DataFrame, left: str, right: str, winner: str, judge: str) -> DataFrame:
    """For each judge: judgments, repeated pairs, share won by the left, and how often both orders of a pair agree."""
    low, high = F.least(left, right), F.greatest(left, right)
    rows = df.withColumns({"__a": low, "__b": high, "__first": (F.col(left) == low).cast("int"), "__low_won": (F.col(winner) == low).cast("double"), "__left_won": (F.col(winner) == F.col(left)).cast("double")})
    pairs = rows.groupBy(judge, "__a", "__b").agg(F.countDistinct("__first").alias("__orders"), F.avg("__low_won").alias("__share"), F.count(F.lit(1)).alias("__n"), F.sum("__left_won").alias("__left"))
    both = F.col("__orders") == 2
    agree = F.avg(F.when(both, F.col("__share").isin(0.0, 1.0).cast("double")))
    return pairs.groupBy(judge).agg(F.sum("__n").alias("n"), F.count_if(F.col("__n") > F.col("__orders")).alias("n_repeated"), (F.sum("__left") / F.sum("__n")).alias("left_share"), agree.alias("order_consistency"))


def axis_cosines(axes: dict[str, Sequence[float]]) -> list[tuple[str, str, float]]:
    """Cosine of each pair of axes."""
    names = sorted(axes)
    unit = {n: np.asarray(axes[n], float) / np.linalg.norm(axes[n]) for n in names}
    return [(a, b, float(unit[a] @ unit[b])) for i, a in enumerate(names) for b in names[i + 1 :]]


def plane(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    """An orthonormal basis of two directions, the first kept."""
    x = np.asarray(a, float) / np.linalg.norm(a)
    y = np.asarray(b, float) - (np.asarray(b, float) @ x) * x
    return np.stack([x, y / np.linalg.norm(y)])


def support_cells(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], n: int) -> DataFrame:
    """Rows by cell of an n x n grid over the bounds, and their share: where targets have support."""
    x0, x1, y0, y1 = bounds
    cell = lambda c, lo, hi: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - lo) / (hi - lo) * n).cast("int")))
    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    counts = inside.groupBy(cell(x, x0, x1).alias("column"), cell(y, y0, y1).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    total = inside.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def calibrated_levels(strengths: DataFrame, style: str, level: str, strength: str) -> DataFrame:
    """Strengths on the scale on which a style's mean at level 0 is 0 and at level 1 is 1; styles whose ends are reversed
    have null positions."""
    ends = strengths.groupBy(style).agg(F.avg(F.when(F.col(level) == 0, F.col(strength))).alias("__low"), F.avg(F.when(F.col(level) == 1, F.col(strength))).alias("__high"))
    gap = F.col("__high") - F.col("__low")
    out = strengths.join(ends, style).withColumn("realized", F.when(gap > 1e-9, (F.col(strength) - F.col("__low")) / gap))
    return out.drop("__low", "__high")


def measured_paths(df: DataFrame, style: str, level: str, realized: str, vector: str) -> DataFrame:
    """For each style's path in order of level: steps, reversals, whether it strictly rises, mean error, rank correlation,
    mean and relative deviation of the steps between unit vectors, and their sum over the direct way."""
    w = Window.partitionBy(style).orderBy(level)
    unit = A.unit(F.transform(F.col(vector), lambda x: x.cast("double")))
    rows = df.select(style, F.col(level).cast("double").alias("__a"), F.col(realized).cast("double").alias("__r"), unit.alias("__v"), level)
    rows = rows.withColumns({"__next": F.lead("__r").over(w), "__ahead": F.lead("__v").over(w), "__ra": average_rank("__a", style), "__rr": average_rank("__r", style)})
    step = F.when(F.col("__ahead").isNotNull(), A.norm(A.minus(F.col("__ahead"), F.col("__v"))))
    rows = rows.withColumns({"__step": step, "__back": F.when(F.col("__next").isNotNull(), (F.col("__next") <= F.col("__r")).cast("int"))})
    out = rows.groupBy(style).agg(
        F.count("__step").alias("n_steps"),
        F.sum("__back").alias("n_reversals"),
        F.avg(F.abs(F.col("__r") - F.col("__a"))).alias("mean_error"),
        safe_corr(F.col("__ra"), F.col("__rr")).alias("spearman"),
        F.avg("__step").alias("mean_step"),
        (F.stddev_pop("__step") / F.greatest(F.avg("__step"), F.lit(1e-12))).alias("step_cv"),
        F.sum("__step").alias("__way"),
        A.norm(A.minus(F.max_by("__v", "__a"), F.min_by("__v", "__a"))).alias("__direct"),
    )
    return out.withColumn("rises", F.col("n_reversals") == 0).withColumn("tortuosity", F.col("__way") / F.greatest("__direct", F.lit(1e-12))).drop("__way", "__direct")


def policy_axis(df: DataFrame, style: str, end: str, vector: str) -> dict:
    """The unit mean of high minus low over the styles' matched ends, its anchors, each style's cosine with it, how often a
    style left out still points its way, and the styles' midpoints. Two sums of vectors and one row a style reach the driver."""
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    low = df.where(F.col(end) == 0).select(style, wide(F.col(vector)).alias("__a"))
    high = df.where(F.col(end) == 1).select(style, wide(F.col(vector)).alias("__b"))
    pairs = low.join(high, style).orderBy(style).toArrow()  # one row a style, a short list
    a, b = (np.array(pairs.column(c).to_pylist(), float) for c in ("__a", "__b"))
    if len(a) < 2:
        raise ValueError("at least two matched styles are needed")
    diff = b - a
    mean = diff.mean(axis=0)
    direction = mean / np.linalg.norm(mean)
    rest = (diff.sum(axis=0) - diff) / (len(diff) - 1)
    return {
        "direction": direction,
        "low": float(a.mean(axis=0) @ direction),
        "high": float(b.mean(axis=0) @ direction),
        "cosines": dict(zip(pairs.column(style).to_pylist(), (diff @ direction / np.linalg.norm(diff, axis=1)).tolist(), strict=True)),
        "left_out_positive": float((np.einsum("ij,ij->i", diff, rest) > 0).mean()),
        "midpoints": dict(zip(pairs.column(style).to_pylist(), ((a + b) / 2).tolist(), strict=True)),
    }


def located(df: DataFrame, axis: dict, style: str, level: str, vector: str) -> DataFrame:
    """Adds coordinate (0 and 1 at the anchors), error against the level, and the distance off the axis from the style's
    midpoint, on the axis's scale."""
    spark = df.sparkSession
    kind = df.schema[style].dataType.simpleString()
    mids = spark.createDataFrame([(k, v) for k, v in axis["midpoints"].items()], f"{style} {kind}, __mid array<double>")  # one row a style
    scale = axis["high"] - axis["low"]
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    along = literal(axis["direction"])
    rows = df.join(F.broadcast(mids), style).withColumn("coordinate", (A.dot(v, along) - axis["low"]) / scale)
    offset = A.minus(v, F.col("__mid"))
    off = F.sqrt(F.greatest(A.dot(offset, offset) - F.pow(A.dot(offset, along), 2), F.lit(0.0))) / scale
    return rows.withColumns({"error": F.abs(F.col("coordinate") - F.col(level)), "off_axis": off}).drop("__mid")


def validated(locations: DataFrame, style: str, level: str, most_error: float, most_off: float, tolerance: float = 0.0) -> DataFrame:
    """For each style its points, those outside the thresholds, and whether its coordinates never fall by more than the
    tolerance from level to level."""
    w = Window.partitionBy(style).orderBy(level)
    rows = locations.withColumn("__next", F.lead("coordinate").over(w))
    outside = (F.col("error") > most_error) | (F.col("off_axis") > most_off)
    falls = F.coalesce(F.col("__next") + tolerance < F.col("coordinate"), F.lit(False))
    out = rows.groupBy(style).agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("n_rejected"), (F.count_if(falls) == 0).alias("monotone"))
    return out.withColumn("passed", (F.col("n_rejected") == 0) & F.col("monotone"))


def support_targets(points: DataFrame, key: str, x: str, y: str, keywords: DataFrame, keyword: str, per_keyword: int, n: int = 20, least: int = 3, seed: int | str = 42) -> DataFrame:
    """Targets of each keyword on an n x n grid over [0, 1]^2: cells with at least ``least`` points take turns, so that none
    is used twice before all are used once; a target lies between two points of its cell, chosen by digest, as is its place
    between them. (keyword, target, column, row, x, y)."""
    from .sampling import hash_order, placed_by_hash

    cell = lambda c: F.least(F.lit(n - 1), F.floor(F.col(c) * n)).cast("int")
    inside = points.where(F.col(x).between(0, 1) & F.col(y).between(0, 1)).select(key, F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x).alias("column"), cell(y).alias("row"))
    order = Window.partitionBy("column", "row").orderBy(hash_order(seed, key), key)
    inside = inside.withColumns({"__i": F.row_number().over(order) - 1, "__size": F.count(F.lit(1)).over(Window.partitionBy("column", "row"))}).where(F.col("__size") >= least)
    cells = inside.select("column", "row", "__size").distinct()  # at most n * n rows
    cells = cells.withColumn("__c", F.row_number().over(Window.orderBy(hash_order(seed, "column", "row"))) - 1)
    total = cells.agg(F.count(F.lit(1)).alias("__cells"))
    turn = placed_by_hash(keywords.select(keyword), seed, keyword)
    wanted = turn.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(per_keyword - 1)))).crossJoin(F.broadcast(total))
    wanted = wanted.withColumn("__c", F.pmod(F.col("place") * per_keyword + F.col("target"), F.col("__cells"))).join(F.broadcast(cells), "__c")
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col(keyword).cast("string"), F.col("target").cast("string"))), 1, 8), 16, 10).cast("long")
    wanted = wanted.withColumns({"__l": draw("left") % F.col("__size"), "__r": draw("right") % F.col("__size"), "__t": draw("between").cast("double") / float(1 << 32)})
    side = lambda s: inside.select("column", "row", F.col("__i").alias(f"__{s}"), F.col("__x").alias(f"__x{s}"), F.col("__y").alias(f"__y{s}"))
    out = wanted.join(side("l"), ["column", "row", "__l"]).join(side("r"), ["column", "row", "__r"])
    mix = lambda a: F.col("__t") * F.col(f"__{a}l") + (1 - F.col("__t")) * F.col(f"__{a}r")
    return out.select(keyword, "target", "column", "row", mix("x").alias("x"), mix("y").alias("y"))


def coordinate_bridge(df: DataFrame, states: Sequence[str], x: str, y: str, penalty: float = 1e-3, least: int = 10) -> dict:
    """How each state column changes with two coordinates, by ridge on centred sums (one row reaches the driver)."""
    from .causal import gram

    cols = [x, y, *states, "__one"]
    g, n = gram(df.select(*[F.col(c).cast("double") for c in (x, y, *states)], F.lit(1.0).alias("__one")).na.drop(), cols)
    if n < least:
        raise ValueError(f"at least {least} rows are needed")
    mean = g[-1, :-1] / n
    s = g[:-1, :-1] - n * np.outer(mean, mean)
    if np.linalg.matrix_rank(s[:2, :2], tol=1e-10) < 2:
        raise ValueError("the coordinates do not span two directions")
    directions = np.linalg.solve(s[:2, :2] + penalty * np.eye(2), s[:2, 2:])
    left = np.trace(s[2:, 2:]) - 2 * np.sum(directions * s[:2, 2:]) + np.sum(directions * (s[:2, :2] @ directions))
    return {"coordinate_mean": mean[:2], "state_mean": mean[2:], "directions": directions, "n": n, "rmse": float(np.sqrt(max(left, 0.0) / (n * len(states))))}


def feedback(start: Sequence[float], target: Sequence[float], bridge: dict, render, score, valid, rounds: int = 5, gain: float = 0.5, close: float = 0.05) -> list[dict]:
    """Bounded steering: a state is moved along the bridge's directions by the part ``gain`` of what its coordinates lack;
    ``render`` turns a state into a text, ``score`` a text into two coordinates, and ``valid`` may refuse a text, which halves
    the step. Every attempt is a row; the loop ends near the target or after ``rounds``."""
    state = np.array(bridge["state_mean"], float) + (np.asarray(start, float) - bridge["coordinate_mean"]) @ bridge["directions"]
    want = np.asarray(target, float)
    text = render(state)
    at = np.asarray(score(text), float)
    out = [{"round": 0, "text": text, "x": at[0], "y": at[1], "accepted": True, "distance": float(np.linalg.norm(want - at))}]
    for n in range(1, rounds + 1):
        if np.linalg.norm(want - at) <= close:
            break
        new = state + gain * (want - at) @ bridge["directions"]
        text = render(new)
        accepted = bool(valid(text))
        if accepted:
            state, at = new, np.asarray(score(text), float)
        else:
            gain /= 2
        out.append({"round": n, "text": text, "x": at[0], "y": at[1], "accepted": accepted, "distance": float(np.linalg.norm(want - at))})
    return out


def path_cycles(df: DataFrame, path: str, assigned: str, measured: Sequence[str]) -> DataFrame:
    """For each path and each measured coordinate: whether it strictly rises with the assigned one, and their rank correlation."""
    rows = df.select(path, F.col(assigned).cast("double").alias("__a"), *[F.col(m).cast("double") for m in measured])
    rows = rows.withColumns({f"__n_{m}": F.lead(m).over(Window.partitionBy(path).orderBy("__a")) for m in measured} | {f"__r_{m}": average_rank(m, path) for m in measured} | {"__ra": average_rank("__a", path)})
    aggs = []
    for m in measured:
        aggs += [(F.count_if(F.col(f"__n_{m}") <= F.col(m)) == 0).alias(f"{m}_rises"), safe_corr(F.col("__ra"), F.col(f"__r_{m}")).alias(f"{m}_spearman")]
    return rows.groupBy(path).agg(F.count(F.lit(1)).alias("n"), *aggs)
