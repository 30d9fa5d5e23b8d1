"""Every oracle belongs to a query, and a sample of queries matches it."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from checks.verify import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["c1_ads_kpis", "an20_campaign_flags", "c9_j1_query_records", "an8_ctr_opportunities", "a24_st3_sessions",
          "c1_c5_web_kpis", "j8_l5_find_duplicates", "win9_p27_snk7_archive_names"]


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_twin(spark, con, name):
    df = registry.queries()[name](spark, SF)
    res = con.execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
