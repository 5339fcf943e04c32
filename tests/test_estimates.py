"""Queries without SQL against NumPy: other formulas, plain loops, or all choices."""

from __future__ import annotations

import hashlib
from itertools import combinations, permutations, product

import numpy as np
import pytest

from ranklake.operators import aggregates as A
from ranklake.operators import causal as C
from ranklake.operators import latent as La
from ranklake.operators import sampling as S
from ranklake.plans import estimators, registry

Q = registry.queries()


@pytest.fixture(scope="module")
def embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)


def ridge(x, y, penalty=1.0):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + penalty * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(axis=0) @ w


def test_ridge_map(spark, sf, embeddings):
    ids, label, x = embeddings
    fit = ids % 5 != 0
    w, b = ridge(x[fit], label[fit].astype(float))
    got = {r.vec_id: r.predicted for r in Q["e1_e3_ridge_map"](spark, sf).collect()}
    assert got == pytest.approx({i: v for i, v in zip(ids[~fit].tolist(), (x[~fit] @ w + b).tolist(), strict=True)}, abs=1e-5)


def test_map_metrics(spark, sf, embeddings):
    ids, label, x = embeddings
    fit = ids % 5 != 0
    w, b = ridge(x[fit], label[fit].astype(float))
    t, p = label[~fit].astype(float), x[~fit] @ w + b
    r = Q["e2_e12_map_metrics"](spark, sf).first()
    assert r.n == len(t) and r.pearson == pytest.approx(np.corrcoef(t, p)[0, 1], abs=1e-5)
    assert r.mae == pytest.approx(np.abs(t - p).mean(), abs=1e-5) and r.r2 == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), abs=1e-5)


def test_principal_axes(spark, sf, embeddings):
    _, _, x = embeddings
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = np.zeros((3, x.shape[1]))
    for r in Q["e5_principal_axes"](spark, sf).collect():
        got[r.axis, r.dimension] = r.weight
        assert r.share == pytest.approx(s[r.axis] ** 2 / (s**2).sum(), abs=1e-5)
    assert np.abs(np.sum(got * v[:3], axis=1)) == pytest.approx(np.ones(3), abs=1e-4)


def test_procrustes(spark, sf, embeddings):
    """The alignment has the least error among the rotations and reflections of the plane and scales around it."""
    ids, _, x = embeddings
    even = ids % 2 == 0
    a, b = x[even, :2] - x[even, :2].mean(axis=0), x[even, 2:4] - x[even, 2:4].mean(axis=0)
    best = np.inf
    for angle in np.linspace(0, 2 * np.pi, 2881):
        c, s = np.cos(angle), np.sin(angle)
        for m in (np.array([[c, -s], [s, c]]), np.array([[c, s], [s, -c]])):
            turned = a @ m
            scale = max((turned * b).sum() / (a * a).sum(), 0)
            e = ((scale * turned - b) ** 2).sum()
            if e < best:
                best, fit = e, scale * m
    odd = ~even
    want = (x[odd, :2] - x[even, :2].mean(axis=0)) @ fit + x[even, 2:4].mean(axis=0)
    got = {r.vec_id: (r.y0, r.y1) for r in Q["e6_e7_procrustes"](spark, sf).collect()}
    assert np.array([got[i] for i in ids[odd].tolist()]) == pytest.approx(want, abs=2e-3)


def test_leave_one_label_out(spark, sf, embeddings):
    _, label, x = embeddings
    y = 10 * x[:, 0] * x[:, 1] + x[:, 2]
    for r in Q["e9_leave_one_label_out"](spark, sf).collect():
        own = label == r.label
        w, b = ridge(x[~own], y[~own])
        assert r.n == own.sum() and r.mae == pytest.approx(np.abs(x[own] @ w + b - y[own]).mean(), abs=1e-5)


def test_battery(spark, sf, embeddings):
    _, label, x = embeddings
    y = 10 * x[:, 0] * x[:, 1] + x[:, 2]
    miss = np.zeros(len(y))
    for v in set(label.tolist()):
        own = label == v
        w, b = ridge(x[~own], y[~own])
        miss[own] = np.abs(x[own] @ w + b - y[own])
    got = {r.check: r.value for r in Q["e8_e35_robustness_battery"](spark, sf).collect()}
    assert got["mae"] == pytest.approx(miss.mean(), abs=1e-5) and got["low"] <= miss.mean() <= got["high"]
    assert 0 < got["permutation_p"] <= 1 and set(got) == {"mae", "baseline_mae", "spearman", "gain", "low", "high", "null_95", "permutation_p"}


def test_ordinal_levels(spark, sf):
    """The log-likelihood at the fit is not below that of its neighbours."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").toPandas()
    x = np.stack([rows["l_linenumber"].astype(float), np.floor(rows["l_quantity"].astype(float) / 10)], axis=1)
    y = np.minimum(np.floor(rows["l_discount"].astype(float).to_numpy() * 100 / 4), 2).astype(int)
    got = {r.name: r.value for r in Q["e4_ordinal_levels"](spark, sf).collect()}
    w, cuts = np.array([got["weight a"], got["weight b"]]), np.array([got[f"cut {i}"] for i in range(len(set(y)) - 1)])

    def likelihood(w, cuts):
        s = 1 / (1 + np.exp(-(np.concatenate([[-50.0], cuts, [50.0]])[None, :] - (x @ w)[:, None])))
        return np.log(s[np.arange(len(y)), y + 1] - s[np.arange(len(y)), y]).sum() - w @ w / 2

    best = likelihood(w, cuts)
    for i in range(2):
        for step in (-0.05, 0.05):
            assert likelihood(w + step * np.eye(2)[i], cuts) <= best + 0.05
    for i in range(len(cuts)):
        for step in (-0.1, 0.1):
            assert likelihood(w, cuts + step * np.eye(len(cuts))[i]) <= best + 0.05


def panel(spark, sf, *columns):
    rows = estimators.panel(spark, sf).select("key", *columns).toPandas()
    fold = lambda k: np.array([int(hashlib.md5(f"42:{x}".encode()).hexdigest()[:8], 16) % k for x in rows["key"]])
    return [rows[c].astype(float).to_numpy() for c in columns], fold


def logit(x, y):
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return w


def test_doubly_robust_effect(spark, sf):
    (price, quantity, tax, line), fold = panel(spark, sf, "price", "l_quantity", "l_tax", "l_linenumber")
    high = (quantity > 25).astype(float)
    x = np.stack([np.ones(len(tax)), tax, line], axis=1)
    f, psi = fold(2), np.zeros(len(tax))
    for k in range(2):
        fit, own = f != k, f == k
        p = np.clip(1 / (1 + np.exp(-x[own] @ logit(x[fit], high[fit]))), 0.01, 0.99)
        g = [x[own] @ np.linalg.lstsq(x[fit & (high == v)], price[fit & (high == v)], rcond=None)[0] for v in (0, 1)]
        psi[own] = g[1] - g[0] + high[own] * (price[own] - g[1]) / p - (1 - high[own]) * (price[own] - g[0]) / (1 - p)
    r = Q["d3_irm"](spark, sf).first()
    assert r.n_obs == len(psi) and r.coef == pytest.approx(psi.mean(), rel=1e-3) and r.se == pytest.approx(psi.std() / len(psi) ** 0.5, rel=1e-3)


def test_boosted_nuisances(spark, sf):
    """Trees take out a bend that straight lines leave: the effect on data with a known one."""
    r = np.random.default_rng(5)
    x = r.uniform(-2, 2, 3000)
    d = x**2 + r.normal(0, 1, 3000)
    y = 1.5 * d + 4 * x**2 + r.normal(0, 1, 3000)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, d, y, strict=True))], "key long, x double, d double, y double").cache()
    trees = C.plr(df, "key", "y", "d", ["x"], k=2, learner="trees")
    line = C.plr(df, "key", "y", "d", ["x"], k=2)
    assert abs(trees["coef"] - 1.5) < 0.25 < abs(line["coef"] - 1.5)
    row = Q["d2_plr_trees"](spark, sf).first()
    assert row.n_obs > 0 and row.ci_lower < row.coef < row.ci_upper


def test_joint_intervals(spark, sf):
    rows = C.joint_plr(estimators.panel(spark, sf), "key", "price", ["l_quantity", "l_discount"], estimators.CONTROLS, draws=4000)
    for r in rows:
        width = (r["joint_upper"] - r["coef"]) / r["se"]
        # the 95 % point of the larger of two nearly independent normal sizes
        assert 2.1 < width < 2.36 and r["joint_lower"] + r["joint_upper"] == pytest.approx(2 * r["coef"])


def test_importance(spark, sf):
    """Shares follow what the controls explain, and add up to one."""
    rows = Q["d21_importance"](spark, sf).collect()
    assert sum(r.share for r in rows) == pytest.approx(1, abs=1e-3) and sorted(r.rank for r in rows) == [1, 2, 3]
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 3))
    y = 3 * x[:, 1] + 1.2 * x[:, 2] ** 2 + 0.1 * r.normal(size=800)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    found = {v["control"]: v for v in C.importance(df, "y", ["a", "b", "c"], 5)}
    assert [found[c]["rank"] for c in "bca"] == [1, 2, 3] and found["b"]["share"] > 0.5


def test_probe(spark, sf, embeddings):
    ids, _, x = embeddings
    y = 10 * x[:, 0] * x[:, 1] + x[:, 2]
    label = (y > np.median(y)).astype(float)
    fit = ids % 5 != 0
    mean, dev = x[fit].mean(axis=0), x[fit].std(axis=0, ddof=1)
    z = (x - mean) / dev  # the penalty holds for standardised features
    w, b = np.zeros(x.shape[1]), 0.0
    n = fit.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z[fit] @ w + b)))
        zz = np.hstack([z[fit], np.ones((n, 1))])
        h = (zz * (p * (1 - p))[:, None]).T @ zz / n + np.diag([0.1] * x.shape[1] + [1e-9])
        g = zz.T @ (label[fit] - p) / n - np.append(0.1 * w, 0)
        step = np.linalg.solve(h, g)
        w, b = w + step[:-1], b + step[-1]
    s = z[~fit] @ w + b
    r = Q["d34_logistic_probe"](spark, sf).first()
    assert r.n == (~fit).sum() and r.accuracy == pytest.approx(((s > 0) == label[~fit]).mean(), abs=0.03)
    one, zero = s[label[~fit] == 1], s[label[~fit] == 0]
    assert r.auc == pytest.approx((one[:, None] > zero[None, :]).mean(), abs=0.02)


# ---- selections --------------------------------------------------------------------


def test_diverse_selection(spark, sf, embeddings):
    ids, label, x = embeddings
    got: dict = {}
    for r in Q["t13_diverse_selection"](spark, sf).collect():
        got.setdefault(r.label, {})[r.place] = r.vec_id
    for v, places in got.items():
        own, xs = ids[label == v], x[label == v]
        score = np.linalg.norm(xs - xs.mean(axis=0), axis=1)
        unit = xs / np.linalg.norm(xs, axis=1, keepdims=True)
        picked: list[int] = []
        for _ in range(min(10, len(own))):
            cost = [np.inf if i in picked else score[i] + max([0.0, *(unit[i] @ unit[j] for j in picked)]) for i in range(len(own))]
            picked.append(int(np.argmin(cost)))
        assert [places[k] for k in range(len(picked))] == own[picked].tolist()


def test_matched_selection(spark, sf):
    lines: dict = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        lines.setdefault(r.l_suppkey, []).append((r.l_orderkey, float(r.l_quantity)))
    got: dict = {}
    for r in Q["t14_matched_selection"](spark, sf).collect():
        got.setdefault(r.l_suppkey, []).append((r.target, r.l_orderkey))
    for key, chosen in got.items():
        targets = [t for t, _ in chosen]
        # for each target the few nearest quantities hold a cheapest choice
        near = sorted({i for t in targets for i in sorted(range(len(lines[key])), key=lambda i: abs(lines[key][i][1] - t))[:4]})
        best = min(sum(abs(t - lines[key][i][1]) for t, i in zip(targets, p, strict=True)) for p in permutations(near, len(targets)))
        held = sum(min(abs(t - q) for o, q in lines[key] if o == order) for t, order in chosen)
        assert held <= best + 1e-9


def test_grid_selection_equals_all_choices():
    r = np.random.default_rng(8)
    for trial in range(60):
        rows, width = int(r.integers(1, 4)), int(r.integers(1, 4))
        grid = [[[{"x": float(r.integers(0, 4)), "y": float(r.integers(0, 4)), "cost": float(r.integers(0, 9)), "vector": r.normal(size=2).tolist(), "hash": int(r.integers(0, 99))} for _ in range(int(r.integers(1, 4)))] for _ in range(width)] for _ in range(rows)]
        most = None if trial % 2 else 2.0
        best = np.inf
        for choice in product(*[cell for row in grid for cell in row]):
            at = lambda i, j: choice[i * width + j]  # noqa: B023, E731
            far = lambda a, b: most is not None and np.linalg.norm(np.subtract(a["vector"], b["vector"])) > most  # noqa: B023, E731
            bad = any(at(i, j)["x"] < at(i, j - 1)["x"] or far(at(i, j), at(i, j - 1)) for i in range(rows) for j in range(1, width))
            bad |= any(at(i, j)["y"] < at(i - 1, j)["y"] or far(at(i, j), at(i - 1, j)) for i in range(1, rows) for j in range(width))
            if not bad:
                best = min(best, sum(c["cost"] for c in choice))
        got = S.grid_selection(grid, 0.0, most)
        assert (got is None) == np.isinf(best)
        if got is not None:
            assert sum(c["cost"] for c in got) == best


def test_grid_selection_of_large_cells_holds_no_cube():
    """1,700 candidates a cell: one array over three cells has 39 GB."""
    r = np.random.default_rng(12)
    draw = lambda: [{"x": float(x), "y": float(y), "cost": float(c), "hash": 0} for x, y, c in zip(r.normal(size=1700), r.normal(size=1700), r.uniform(size=1700), strict=True)]
    grid = [[draw(), draw()] for _ in range(3)]
    got = S.grid_selection(grid)
    assert all(got[2 * i]["x"] <= got[2 * i + 1]["x"] for i in range(3)) and all(got[k]["y"] <= got[k + 2]["y"] for k in range(4))
    few = [[sorted(cell, key=lambda c: c["cost"])[:20] for cell in row] for row in grid]
    assert sum(c["cost"] for c in got) <= sum(c["cost"] for c in S.grid_selection(few))


def test_grid_selection_takes_the_first_of_many_copies():
    copies = lambda x, y: [{"x": x, "y": y, "cost": 0.5, "hash": k} for k in range(20_000)]
    got = S.grid_selection([[copies(0.0, float(i)), copies(1.0, float(i))] for i in range(3)])
    assert [c["hash"] for c in got] == [0] * 6


def test_grid_selection_looks_at_dear_candidates_where_it_must():
    cheap = [{"x": 1.0, "y": 1.0, "cost": float(k), "hash": k} for k in range(200)]
    low = [{"x": 0.0, "y": 0.0, "cost": float(k), "hash": k} for k in range(200)]
    dear = {"x": 2.0, "y": 2.0, "cost": 500.0, "hash": -1}
    got = S.grid_selection([[cheap, [*low, dear]], [cheap, [*low, dear]]])
    assert [c["cost"] for c in got] == [0.0, 500.0, 0.0, 500.0]
    assert S.grid_selection([[cheap, low]]) is None and S.grid_selection([[[{**dear, "cost": float("nan")}]]]) is None


def test_population_paths_of_more_vectors(spark, sf, tmp_path):
    """Nine copies with other ids and slightly other entries, and rows without a vector: a label has 76 vectors a cell and
    more, and each path is the best of all choices that a loop over pairs finds."""
    r = np.random.default_rng(13)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    many = [(v.vec_id + 1000 * k, v.label, [float(e) for e in np.float32(np.array(v.embedding[:3]) + 0.1 * r.normal(size=3))] if v.vec_id % 97 else None) for k in range(9) for v in rows]
    spark.createDataFrame(many, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got: dict = {}
    for x in Q["t15_population_paths"](spark, str(tmp_path)).collect():
        got.setdefault(x.label, {})[x.place] = x
    for label, p in got.items():
        cells: list = [[] for _ in range(6)]
        for k, (i, _, e) in enumerate(sorted(v for v in many if v[1] == label)):
            if e:
                cells[k % 6].append((abs(e[0] - (k % 2 - 0.5)) + abs(e[1] - (k % 6 // 2 - 1) / 2), e[0], e[1], i))
        pairs = [[(a, b, a[0] + b[0]) for a in cells[2 * i] for b in cells[2 * i + 1] if a[1] <= b[1]] for i in range(3)]
        costs, ys, zs = zip(*[np.array([(c, a[2], b[2]) for a, b, c in row]).T for row in pairs], strict=True)
        total = costs[0]
        for i in (1, 2):
            total = costs[i] + np.array([np.min(total, where=(ys[i - 1] <= y) & (zs[i - 1] <= z), initial=np.inf) for y, z in zip(ys[i], zs[i], strict=True)])
        ids = {c[3] for c in sum(cells, [])}
        assert sorted(p) == list(range(6)) and {x.vec_id for x in p.values()} <= ids
        assert sum(x.cost for x in p.values()) == pytest.approx(total.min(), abs=1e-5)
    assert len(got) == len({v.label for v in rows})


def test_later_styles_take_other_texts():
    cell = [{"x": 0.0, "y": 0.0, "cost": float(i), "hash": i} for i in range(3)]
    got = S.population_paths({2: [[cell]], 1: [[cell]]})
    assert got[1][0]["hash"] == 0 and got[2][0]["hash"] == 1


def test_population_paths_rise(spark, sf, embeddings):
    ids, _, x = embeddings
    at = dict(zip(ids.tolist(), x, strict=True))
    got: dict = {}
    for r in Q["t15_population_paths"](spark, sf).collect():
        got.setdefault(r.label, {})[r.place] = at[r.vec_id]
    for p in got.values():
        assert all(p[2 * i][0] <= p[2 * i + 1][0] for i in range(3))
        assert all(p[2 * i + j][1] <= p[2 * i + 2 + j][1] for i in range(2) for j in range(2))


def test_increasing_selection_equals_all_choices():
    r = np.random.default_rng(9)
    for _ in range(80):
        x = r.integers(0, 12, int(r.integers(3, 8))).astype(float).tolist()
        targets = sorted(r.uniform(0, 12, 3).tolist())
        found = [sum(abs(x[i] - t) for i, t in zip(c, targets, strict=True)) for c in permutations(range(len(x)), 3) if x[c[0]] < x[c[1]] < x[c[2]]]
        if found:
            assert sum(abs(x[i] - t) for i, t in zip(S.increasing_selection(x, targets), targets, strict=True)) == pytest.approx(min(found))
        else:
            with pytest.raises(ValueError):
                S.increasing_selection(x, targets)


def test_percentiles_by_rank(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=5000), r.integers(0, 3, 5000).astype(float)
    df = spark.createDataFrame([(float(x) if i % 7 else None, float(y), None) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double")
    ps = (0.0, 0.01, 0.37, 0.5, 0.99, 1.0)
    got = A.exact_percentiles(df, ["a", "b", "c"], ps, runs=16)
    assert got["a"] == pytest.approx([np.quantile(a[np.arange(5000) % 7 != 0], p) for p in ps])
    assert got["b"] == pytest.approx([np.quantile(b, p) for p in ps]) and got["c"] == [None] * len(ps)


def test_places_by_hash(spark):
    rows = S.placed_by_hash(spark.range(3000).toDF("k"), 42, "k").collect()
    order = sorted(range(3000), key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())
    assert {r.k: r.place for r in rows} == {k: i for i, k in enumerate(order)}


def test_auc_counts_ties_half(spark):
    r = np.random.default_rng(2)
    t, s = r.integers(0, 2, 400), np.round(r.uniform(0, 1, 400), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, s, strict=True)], "t double, s double")
    one, zero = s[t == 1][:, None], s[t == 0][None, :]
    assert C.auc(df, "t", "s", 8) == pytest.approx(((one > zero) + 0.5 * (one == zero)).mean())
    assert C.auc(df.where("t = 1"), "t", "s") is None


def test_feedback_halves_the_way_and_the_step():
    bridge = {"coordinate_mean": np.zeros(2), "state_mean": np.zeros(2), "directions": np.eye(2)}
    say = lambda s: f"{s[0]} {s[1]}"
    read = lambda t: [float(x) for x in t.split()]
    steps = La.feedback([0, 0], [1, 0], bridge, say, read, lambda t: True, rounds=4, close=0.1)
    assert [round(s["x"], 4) for s in steps] == [0, 0.5, 0.75, 0.875, 0.9375]
    steps = La.feedback([0, 0], [1, 0], bridge, say, read, lambda t: read(t)[0] < 0.4, rounds=3, close=0.0)
    assert [(round(s["x"], 4), s["accepted"]) for s in steps] == [(0, True), (0, False), (0.25, True), (0.25, False)]


def test_policy_axis_needs_two_styles(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [1.0, 1.0])], "style int, end int, v array<double>")
    with pytest.raises(ValueError):
        La.policy_axis(df, "style", "end", "v")
    more = df.unionAll(spark.createDataFrame([(2, 0, [0.0, 3.0]), (2, 1, [1.0, 3.0])], df.schema))
    axis = La.policy_axis(more, "style", "end", "v")
    assert axis["direction"].tolist() == [1.0, 0.0] and (axis["low"], axis["high"], axis["left_out_positive"]) == (0.0, 1.0, 1.0)
    got = La.located(more, axis, "style", "end", "v").collect()
    assert all(r.error < 1e-12 and r.off_axis < 1e-9 for r in got)


def test_comparisons_equal_all_pairs(spark):
    rows = [(c, f"{c}{i}", i) for c in "ab" for i in range(6)]
    got = {(r.left_id, r.right_id, r.kind, r.swapped) for r in La.comparisons(spark.createDataFrame(rows, "cell string, id string, level int"), ["cell"], "id", "level").collect()}
    want = set()
    for (c, a, i), (e, b, j) in combinations(rows, 2):
        if c == e and j - i in (1, 3):
            kind = "neighbour" if j - i == 1 else "distant"
            want |= {(a, b, kind, False), (b, a, kind, True)}
    assert got == want
