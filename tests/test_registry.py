"""Registered queries against DuckDB on the smallest scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "f1_demographic_parity", "f14_full_audit", "p5_describe", "e9_stratified_split", "d2_cusum", "d4_wasserstein",
    "d12_compare_report", "d19_alert_summary", "x12_dataset_summary", "m2_threshold_sweep", "m4_pareto_front",
    "k4_validation", "c1_correlation_matrix", "g10_proxy_chains", "t1_streaming_cusum", "s7_json_round_trip",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not mounted")


def test_every_oracle_has_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple("%.5g" % v if isinstance(v, float) else str(v) for v in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
