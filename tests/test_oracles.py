"""Every registered query against its SQL on the smallest test data."""

import os
from pathlib import Path

import numpy as np
import pytest

from quillspark import catalog

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return "~"
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, oracle, name):
    found = catalog.queries()[name](spark, str(DATA)).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
        return
    due = oracle.execute(sql).df()
    assert sorted(found.columns) == sorted(due.columns)
    assert rows(found) == rows(due)


def test_only_these_have_no_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"chunk_pack", "ingest_report", "kmeans_clusters", "substring_match"}
