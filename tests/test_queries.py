"""Every registered query runs, and equals its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from chunkwell.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def canon(x):
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or pd.isna(v):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(cell, r)) for r in x[sorted(x.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, D).toPandas()
    if name in registry.oracle_sql():
        want = con.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_unrelated_chunks_stay_in_the_pool(spark):
    # the production threshold: only chunks as alike as that are collapsed or held apart
    from chunkwell.operators import retrieval

    got = retrieval.dedup_pool(registry.pool(spark, D).drop("text"), "seq").collect()
    assert {r.outcome for r in got} >= {"kept"} and all(r.sim >= retrieval.NEAR for r in got if r.outcome != "kept")
