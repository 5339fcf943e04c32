"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import pytest

from ranklake.plans import registry
from tests.oracles import connect, rows_of_spark, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols, expected = rows_of_sql(con, SQL[name])
    assert sorted(df.columns) == cols
    assert rows_of_spark(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"d2_plr_trees", "d3_irm"}))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_stable_columns(spark, sf):
    assert registry.flagship(spark, sf).columns == ["l_returnflag", "l_linestatus", "n", "median_abs", "mean_abs", "share_1", "share_3"]


def test_every_line_gets_a_place(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = QUERIES["t10_hash_order_all"](spark, sf).collect()
    places: dict = {}
    for r in rows:
        places.setdefault(r.l_orderkey, []).append(r.place)
    assert len(rows) == lines.count() and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_strengths_fit_all_neighbouring_lines(spark, sf, con):
    pairs = con.sql("SELECT a.l_returnflag, a.l_suppkey, b.l_suppkey, CASE WHEN a.l_quantity > b.l_quantity THEN 1.0 WHEN a.l_quantity < b.l_quantity THEN 0.0 ELSE 0.5 END FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey != b.l_suppkey").fetchall()
    got = {(r.l_returnflag, r.item): r.strength for r in QUERIES["e13_e14_bradley_terry"](spark, sf).collect()}
    assert set(got) == {(f, x) for f, a, b, _ in pairs for x in (a, b)}
    slope = {k: -0.1 * b for k, b in got.items()}
    for f, a, b, score in pairs:
        left = float(score) - 1 / (1 + math.exp(got[f, b] - got[f, a]))
        slope[f, a] += left
        slope[f, b] -= left
    assert max(map(abs, slope.values())) < 1e-3
