"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gneiss.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(x[c]) for c in columns) for x in df.collect()]
    if name in catalog.ORACLE_SQL:
        with duckdb.connect() as db:
            for path in glob.glob(f"{SF}/*.parquet"):
                db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
            result = db.execute(catalog.ORACLE_SQL[name])
            have = [x[0] for x in result.description]
            assert sorted(have) == columns
            want = [tuple(plain(x[have.index(c)]) for c in columns) for x in result.fetchall()]
        key = lambda row: [(x is None, str(x)) for x in row]
        assert sorted(got, key=key) == sorted(want, key=key)
