"""Registered queries against DuckDB at the smallest scale; ALL_QUERIES=1 runs every one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import differences, duck

SF = "/root/testdata/sf0.001"
SOME = (
    "bucket_mean", "bucket_mean_variant", "history_load", "coverage", "tag_catalog", "run_table", "run_lookup", "cracking_mask",
    "drift", "pass_health", "feature_matrix", "windows_v1", "context_rows", "driver_rank", "lag_xcorr", "pass_bands", "pooled_age",
)
NAMES = sorted(queries()) if os.environ.get("ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    assert differences(spark, con, name, SF).startswith(("equal", "rows only"))


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["unit", "run", "start", "end", "length_days"]
