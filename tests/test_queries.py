"""Each engine query equals its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from terraloc.operators.retrieval import align
from terraloc.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    a, b = (t[cols].sort_values(cols).fillna(-1).reset_index(drop=True) for t in (got, want))
    for c in cols:
        assert (a[c].values == b[c].astype(a[c].dtype).values).all(), c


def test_align_finds_planted_shift():
    rng = np.random.default_rng(5)
    a = rng.random((20, 60)) * (rng.random((20, 60)) < 0.7)
    for s in (0, 1, 17, 59):
        got, dist = align(np.roll(a, s, 1), a)
        assert got == s and abs(dist) < 1e-8


def test_align_without_points():
    assert np.isnan(align(np.zeros((20, 60)), np.zeros((20, 60)))[1])


def test_every_query_counts():
    assert set(SQL) < set(QUERIES) and set(QUERIES) - set(SQL) == {"multilateration", "loam_features", "revisit_fresco"}
