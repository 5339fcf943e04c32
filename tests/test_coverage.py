"""COVERAGE.md names only registered queries, and says rightly which have SQL."""

from __future__ import annotations

import re
from pathlib import Path

from ranklake.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_coverage_names_registered_queries():
    queries, sql = registry.queries(), registry.oracle_sql()
    rows = re.findall(r"^\| ([A-Z]\d+)\S* \| (q|b) \| (.*) \|$", (ROOT / "COVERAGE.md").read_text(), re.M)
    assert len(rows) > 250
    for row, kind, names in rows:
        for name in re.findall(r"`(\w+)`", names):
            assert name in queries and (name in sql) == (kind == "q"), (row, name)


def test_every_query_says_what_it_covers():
    assert all(re.match(r"[a-z]\d+_", n) for n in registry.queries() if n != "labels_rates")
