"""SQL of cross-fitted least squares, for the oracles of the estimators: closed forms by determinants."""

from __future__ import annotations

from collections.abc import Sequence

#: The panel of the estimators: order lines with a key, a price as outcome, and numbers.
PANEL = """(SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS key, l_returnflag, l_linestatus, l_quantity::DOUBLE AS l_quantity,
 l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_linenumber::DOUBLE AS l_linenumber, (l_extendedprice / 1000)::DOUBLE AS price, (l_returnflag = 'A')::INT::DOUBLE AS is_a,
 (l_linestatus = 'F')::INT::DOUBLE AS is_f, (l_quantity > 25)::INT::DOUBLE AS high FROM lineitem)"""


def det(m: Sequence[Sequence[str]]) -> str:
    """The determinant of a matrix of expressions."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if j % 2 else '+'} ({m[0][j]}) * {det([[*row[:j], *row[j + 1 :]] for row in m[1:]])}" for j in range(len(m))]
    return f"({' '.join(parts)})"


def residuals(targets: Sequence[str], controls: Sequence[str], where: str = "true", k: int = 5, panel: str = PANEL) -> str:
    """A chain of common tables that ends in r: the panel's rows with ``r_target`` for each target."""
    m = len(controls)
    fold = f"('0x' || substr(md5('42:' || key), 1, 8))::BIGINT % {k}"
    sums = ["count(*)::DOUBLE AS n"]
    sums += [f"sum({c}) AS s{i}" for i, c in enumerate(controls)]
    sums += [f"sum({a} * {b}) AS s{i}_{j}" for i, a in enumerate(controls) for j, b in enumerate(controls) if j >= i]
    sums += [f"sum({t}) AS t_{t}" for t in targets] + [f"sum({c} * {t}) AS t_{t}_{i}" for t in targets for i, c in enumerate(controls)]
    names = [x.rsplit(" AS ", 1)[1] for x in sums]
    rest = ", ".join(f"a.{x} - f.{x} AS {x}" for x in names)
    s = [[f"(s{min(i, j)}_{max(i, j)} - s{i} * s{j} / n)" for j in range(m)] for i in range(m)]
    weights = []
    for t in targets:
        cross = [f"(t_{t}_{i} - s{i} * t_{t} / n)" for i in range(m)]
        for i in range(m):
            weights.append(f"{det([[cross[a] if b == i else s[a][b] for b in range(m)] for a in range(m)])} / {det(s)} AS b_{t}_{i}")
    fits = {t: " + ".join([f"t_{t} / n", *(f"b_{t}_{i} * ({c} - s{i} / n)" for i, c in enumerate(controls))]) for t in targets}
    return f"""p AS (SELECT *, {fold} AS fold FROM {panel} WHERE {where}), f AS (SELECT fold, {', '.join(sums)} FROM p GROUP BY fold), a AS (SELECT {', '.join(f'sum({x}) AS {x}' for x in names)} FROM f),
 g AS (SELECT f.fold, {rest} FROM f, a), w AS (SELECT *, {', '.join(weights)} FROM g), r AS (SELECT p.*, {', '.join(f'p.{t} - ({fit}) AS r_{t}' for t, fit in fits.items())} FROM p JOIN w USING (fold))"""


def plr(outcome: str, treatment: str, controls: Sequence[str], where: str = "true", k: int = 5, extra: str = "", panel: str = PANEL) -> str:
    """One row: extra columns, n_obs, coef, se, ci_lower, ci_upper, r2_outcome, r2_treatment."""
    y, d = f"r_{outcome}", f"r_{treatment}"
    return f"""(WITH {residuals([outcome, treatment], controls, where, k, panel)}, t AS (SELECT sum({d} * {y}) / sum({d} * {d}) AS theta FROM r),
 z AS (SELECT any_value(theta) AS coef, sqrt(sum(pow({d} * ({y} - theta * {d}), 2))) / sum({d} * {d}) AS se, count(*)::DOUBLE AS n_obs, 1 - sum({y} * {y}) / (count(*) * var_pop({outcome})) AS r2_outcome,
 1 - sum({d} * {d}) / (count(*) * var_pop({treatment})) AS r2_treatment FROM r, t)
SELECT {extra}n_obs, round(coef, 5) AS coef, round(se, 6) AS se, round(coef - 1.96 * se, 5) AS ci_lower, round(coef + 1.96 * se, 5) AS ci_upper, round(r2_outcome, 5) AS r2_outcome, round(r2_treatment, 5) AS r2_treatment FROM z)"""


def union(rows: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {r}" for r in rows)


def r2(target: str, controls: Sequence[str], where: str = "true", k: int = 5) -> str:
    """A scalar query: the cross-fitted share of variance."""
    return f"(WITH {residuals([target], controls, where, k)} SELECT 1 - sum(r_{target} * r_{target}) / (count(*) * var_pop({target})) FROM r)"


def ols(outcome: str, treatment: str, control: str, kind: str, panel: str = PANEL) -> str:
    """One row: errors, coef, se, n_obs of least squares on a treatment and a control, with classical, HC1 or HC3 errors."""
    weight = {"none": "", "hc1": "", "hc3": " / pow(1 - h, 2)"}[kind]
    se = {"none": "sqrt(sum(e * e) / (count(*) - 3) * any_value(s22) / any_value(dt))", "hc1": "sqrt(sum(u * u * e * e) * count(*) / (count(*) - 3))", "hc3": f"sqrt(sum(u * u * e * e{weight}))"}[kind]
    return f"""(WITH q AS (SELECT {treatment} - avg({treatment}) OVER () AS c1, {control} - avg({control}) OVER () AS c2, {outcome} - avg({outcome}) OVER () AS c0 FROM {panel}),
 m AS (SELECT sum(c1 * c1) AS s11, sum(c1 * c2) AS s12, sum(c2 * c2) AS s22, sum(c1 * c0) AS s1y, sum(c2 * c0) AS s2y, s11 * s22 - s12 * s12 AS dt, (s1y * s22 - s2y * s12) / dt AS b1, (s2y * s11 - s1y * s12) / dt AS b2, count(*) AS n FROM q),
 v AS (SELECT c0 - b1 * c1 - b2 * c2 AS e, (s22 * c1 - s12 * c2) / dt AS u, 1.0 / n + (s22 * c1 * c1 - 2 * s12 * c1 * c2 + s11 * c2 * c2) / dt AS h, b1, s22, dt FROM q, m)
SELECT '{kind}' AS errors, round(any_value(b1), 6) AS coef, round({se}, 6) AS se, count(*)::DOUBLE AS n_obs FROM v)"""
