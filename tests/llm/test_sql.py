"""Operators whose results SQL can express, beside the brute-force tests of each."""

import pytest

from conftest import SMALL
from evertally.llm.queries import ORACLES, QUERIES
from oracle import spark_rows, sql_rows

NAMES = ["op5_near_duplicates", "op6_substring_dedup", "op9_warc", "op10_benchmark_decontamination"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, folder, name):
    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(folder, ORACLES[name])
