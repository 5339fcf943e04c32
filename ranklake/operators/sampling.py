"""Deterministic samples, splits and orders. Every draw is an order by a digest of a seed and a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """The hex digest of "seed:key:..."; its text order equals the order of the 256-bit number."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)


def sample_per_group(df: DataFrame, groups: list[str], n: int, seed: int | str, *keys: str) -> DataFrame:
    """The n rows of the smallest digest of each group."""
    w = Window.partitionBy(*groups).orderBy(hash_order(seed, *keys), *keys)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def sample(df: DataFrame, n: int, seed: int | str, *keys: str) -> DataFrame:
    """The n rows of the smallest digest (a top-k, without a sort of all rows)."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def balanced(df: DataFrame, label: str, n: int, seed: int | str, *keys: str) -> DataFrame:
    """n / 2 rows of each of two classes."""
    return sample_per_group(df, [label], n // 2, seed, *keys)


def median_split(df: DataFrame, x: str, out: str = "label") -> DataFrame:
    """1 above the median, else 0."""
    middle = df.agg(F.median(x).alias("__m"))
    return df.crossJoin(F.broadcast(middle)).withColumn(out, (F.col(x) > F.col("__m")).cast("int")).drop("__m")


def interleaved(df: DataFrame, strata: list[str], limit: int, seed: int | str, key: str) -> DataFrame:
    """One row of each stratum in turn, strata in order, up to the limit; ``turn`` is its place."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)
    ranked = df.withColumn("round", F.row_number().over(w))
    first = ranked.orderBy("round", *strata).limit(limit)
    return first.withColumn("turn", F.row_number().over(Window.orderBy("round", *strata)))


def assigned_cycle(df: DataFrame, key: str, styles: Sequence[str], seed: int | str) -> DataFrame:
    """Styles in turn over the keys in digest order."""
    names = F.array(*[F.lit(s) for s in styles])
    return placed_by_hash(df, seed, key).withColumn("style", F.get(names, (F.col("place") % len(styles)).cast("int")))


def placed_by_hash(df: DataFrame, seed: int | str, key: str) -> DataFrame:
    """Adds ``place``, from 0, in digest order. The digest's first 12 bits part the rows into 4096 even runs; each is
    ordered by itself, and the runs before it are counted, so no task sees all rows."""
    rows = df.withColumn("__d", hash_order(seed, key)).withColumn("__run", F.substring("__d", 1, 3))
    counts = rows.groupBy("__run").agg(F.count(F.lit(1)).alias("__size"))  # at most 4096 rows
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__run").orderBy("__d", key)) - 1
    out = rows.withColumn("__own", own).join(F.broadcast(counts.withColumn("__before", before)), "__run")
    return out.withColumn("place", (F.col("__own") + F.col("__before")).cast("int")).drop("__d", "__run", "__own", "__size", "__before")


def split_by_hash(df: DataFrame, strata: list[str], family: str, share: float, seed: int | str) -> DataFrame:
    """Whole families to "development" or "confirmation": the first round(n * share) of a stratum, at least 1, at most n - 1."""
    families = df.select(*strata, family).distinct()
    w = Window.partitionBy(*strata)
    ranked = families.withColumn("__n", F.row_number().over(w.orderBy(hash_order(seed, family), family))).withColumn("__size", F.count(F.lit(1)).over(w))
    cut = F.greatest(F.lit(1), F.least(F.col("__size") - 1, F.bround(F.col("__size") * F.lit(share), 0).cast("long")))
    chosen = ranked.withColumn("split", F.when(F.col("__n") <= cut, "development").otherwise("confirmation")).drop("__n", "__size")
    return df.join(chosen, [*strata, family])


def serpentine(rows: int, columns: int) -> list[tuple[int, int]]:
    """Grid cells row by row, every other row backwards."""
    return [(i, j if i % 2 == 0 else columns - 1 - j) for i in range(rows) for j in range(columns)]


def jittered_levels(n: int, seed: int | str) -> list[float]:
    """n levels from 0 to 1, inner ones moved by at most 40 % of a step; ends are fixed."""
    import hashlib

    step = 1 / (n - 1)
    move = lambda i: (int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:12], 16) / 16**12 * 2 - 1) * 0.4 * step
    return [i * step + (move(i) if 0 < i < n - 1 else 0.0) for i in range(n)]


def increasing_selection(costs: Sequence[float], targets: Sequence[float]) -> list[int]:
    """For each target in order one coordinate, strictly increasing, with the least total distance (dynamic programming)."""
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    inf = float("inf")
    best = [[inf] * (len(order) + 1) for _ in range(len(targets) + 1)]
    best[0] = [0.0] * (len(order) + 1)
    took: dict[tuple[int, int], int] = {}
    group = [0] * len(order)  # first place of an equal run
    for k in range(1, len(order)):
        group[k] = group[k - 1] if costs[order[k]] == costs[order[k - 1]] else k
    for t in range(1, len(targets) + 1):
        for k in range(1, len(order) + 1):
            best[t][k] = best[t][k - 1]
            took[t, k] = took.get((t, k - 1), -1)
            c = best[t - 1][group[k - 1]] + abs(costs[order[k - 1]] - targets[t - 1])
            if c < best[t][k]:
                best[t][k], took[t, k] = c, k - 1
    if best[-1][-1] == inf:
        raise ValueError("fewer different coordinates than targets")
    out, k = [], len(order)
    for t in range(len(targets), 0, -1):
        j = took[t, k]
        out.append(order[j])
        k = group[j]
    return out[::-1]


def assignment(cost: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row in the cheapest one-to-one assignment (shortest augmenting paths), rows <= columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, step, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def diverse_selection(scores: Sequence[float], vectors: Sequence[Sequence[float]], n: int, novelty: float = 1.0) -> list[int]:
    """Greedy picks of the lowest score plus novelty times the largest cosine to what is picked."""
    import numpy as np

    x = np.asarray(vectors, float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near, picked = np.full(len(x), 0.0), []
    for _ in range(min(n, len(x))):
        total = np.asarray(scores, float) + novelty * near
        total[picked] = np.inf
        i = int(np.argmin(total))
        picked.append(i)
        near = np.maximum(near, x @ x[i])
    return picked


def grid_selection(grid: Sequence[Sequence[Sequence[dict]]], tolerance: float = 0.0, most_distance: float | None = None) -> list[dict] | None:
    """One candidate for each cell of a grid (rows of cells of candidates) at the least total cost, exactly, or None.

    A candidate has ``cost``, ``x``, ``y`` and maybe ``vector``. x may not fall along a row, y not from row to row, by more
    than the tolerance, and the vectors of neighbours lie within ``most_distance``. Candidates without a finite cost are
    never taken, and of equal ones only the first. The cheapest candidates of the cells are tried first: a path that costs d more than the sum of the cells'
    least costs proves that no candidate which costs over d more than its cell's least is in a better one, so only those
    within d are looked at again. Where the rules leave no cheap path, this comes to all candidates.
    """
    import numpy as np

    same = lambda c: (c["cost"], c["x"], c["y"], None if most_distance is None else tuple(c["vector"]))
    cells = []
    for cell in (cell for row in grid for cell in row):
        firsts: dict = {}
        for c in cell:
            firsts.setdefault(same(c), c)
        cells.append(list(firsts.values()))
    costs = [np.array([c["cost"] for c in cell], float) for cell in cells]
    sizes = [int(np.isfinite(c).sum()) for c in costs]
    if not sizes or not min(sizes):
        return None
    least = [float(c[np.isfinite(c)].min()) for c in costs]
    more = [np.where(np.isfinite(c), c - m, np.inf) for c, m in zip(costs, least, strict=True)]
    n, limit = 32, -1.0
    while True:
        if limit < 0:
            large = [float(np.partition(m, n - 1)[n - 1]) for m, size in zip(more, sizes, strict=True) if size > n]
            limit = min(large, default=np.inf)
        at = [np.flatnonzero(np.isfinite(m) & (m <= limit)) for m in more]
        took = _grid_path([[cell[i] for i in ix] for cell, ix in zip(cells, at, strict=True)], len(grid[0]), tolerance, most_distance)
        whole = all(len(ix) == size for ix, size in zip(at, sizes, strict=True))
        if took is None:
            if whole:
                return None
            n, limit = n * 4, -1.0
            continue
        path = [int(ix[i]) for ix, i in zip(at, took, strict=True)]
        over = path_excess([float(c[i]) for c, i in zip(costs, path, strict=True)], least)
        if whole or over <= limit:
            return [cell[i] for cell, i in zip(cells, path, strict=True)]
        limit = over


def path_excess(costs: Sequence[float], least: Sequence[float]) -> float:
    """By how much a path costs more than the cells' least costs together, and a little for the rounding of sums."""
    return sum(costs) - sum(least) + 1e-9 * (sum(map(abs, costs)) + sum(map(abs, least)))


def _grid_path(cells: Sequence[Sequence[dict]], width: int, tolerance: float, most_distance: float | None) -> list[int] | None:
    """The places of the cheapest path's candidates in their cells, which lie row by row.

    A dynamic program goes cell by cell and keeps the best cost of each choice of the last row's worth of cells; its memory
    is their number of candidates, multiplied, so rows are to be the short side.
    """
    import numpy as np

    axis = lambda cell, name: np.array([c[name] for c in cell], float)
    vectors = [None if most_distance is None else axis(cell, "vector") for cell in cells]

    def far(k: int, m: int, j: int) -> np.ndarray | bool:
        """The candidates of cell k whose vectors are too far from the j-th one's of cell m."""
        return most_distance is not None and np.linalg.norm(vectors[k] - vectors[m][j], axis=1) > most_distance

    def after(best: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """For each choice of the cells after k and of m below it the least cost over k's candidates, and which one has it."""
        upper, lower = axis(cells[k], "y"), axis(cells[m], "y") + tolerance
        upper[np.isnan(upper)], lower[np.isnan(lower)] = -np.inf, np.inf
        total, who = np.empty((*best.shape[1:], len(lower))), np.empty((*best.shape[1:], len(lower)), np.int32)
        low, first = np.full(best.shape[1:], np.inf), np.zeros(best.shape[1:], np.int32)
        order, at = np.argsort(upper, kind="stable"), 0
        for j in np.argsort(lower, kind="stable"):
            if most_distance is not None:
                ix = np.flatnonzero((upper <= lower[j]) & ~far(k, m, j))
                low, first = (best[ix].min(axis=0), ix[best[ix].argmin(axis=0)]) if len(ix) else (np.inf, 0)
            while most_distance is None and at < len(order) and upper[order[at]] <= lower[j]:
                i = order[at]
                better = (best[i] < low) | ((best[i] == low) & (i < first))
                low, first, at = np.where(better, best[i], low), np.where(better, i, first), at + 1
            total[..., j], who[..., j] = low, first
        return total, who

    best, back = np.zeros(()), []
    for k, cell in enumerate(cells):
        if k < width:
            total = best[..., None] + axis(cell, "cost")
        else:  # the oldest cell of the last row's worth leaves
            total, who = after(best, k - width, k)
            total += axis(cell, "cost")
            back.append(who)
        if k % width:
            left, right = axis(cells[k - 1], "x"), axis(cell, "x") + tolerance
            for j in range(len(cell)):
                total[..., (right[j] < left) | far(k - 1, k, j), j] = np.inf
        best = total
    if not np.isfinite(best).any():
        return None
    tail = list(np.unravel_index(int(best.argmin()), best.shape))
    chosen = tail[:]
    for came in reversed(back):
        first = int(came[tuple(tail)])
        tail = [first, *tail[:-1]]
        chosen = [first, *chosen]
    return [int(i) for i in chosen]


def population_paths(styles: dict, tolerance: float = 0.0, most_distance: float | None = None) -> dict:
    """``grid_selection`` for each style in order; a text (``hash``) that an earlier style took is out for later ones."""
    used: set = set()
    out = {}
    for style in sorted(styles):
        grid = [[[c for c in cell if c["hash"] not in used] for cell in row] for row in styles[style]]
        out[style] = grid_selection(grid, tolerance, most_distance)
        used |= {c["hash"] for c in out[style] or ()}
    return out
