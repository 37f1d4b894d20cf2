"""The queries that have SQL against it, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from gneiss.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    with duckdb.connect() as db:
        for path in glob.glob(f"{SF}/*.parquet"):
            db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        result = db.execute(ORACLE_SQL[name])
        have = [x[0] for x in result.description]
        assert sorted(have) == columns
        want = Counter(tuple(x[have.index(c)] for c in columns) for x in result.fetchall())
    assert Counter(tuple(x[c] for c in columns) for x in df.collect()) == want
