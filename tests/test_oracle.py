"""Every core query against its SQL, and every core query without one for running at all."""

import importlib
import os

import pytest
from helpers import SMALL, duck_rows, spark_rows

MODULES = ["folhario.plans.nodes", "folhario.plans.filters", "folhario.plans.rollups", "folhario.plans.records", "folhario.plans.more", "folhario.plans.extraction", "folhario.plans.structure", "folhario.plans.sinks"]
QUERIES = {k: f for m in MODULES for k, f in importlib.import_module(m).QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in importlib.import_module(m).SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, got = spark_rows(QUERIES[name](spark, SMALL))
    if name in SQL:
        want_cols, want = duck_rows(SQL[name], SMALL)
        assert cols == want_cols
        assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
