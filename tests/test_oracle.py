"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_queries_match_oracle(spark):
    report = compare(spark, SF, verbose=False)
    bad = {k: v for k, v in report.items() if v["status"] not in ("match", "rows_only")}
    assert not bad, bad
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"queries", "hits", "recall_at_k"}
