"""Every query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from corvane.plans import flow_queries, matching_queries, plan_queries, queries, review_queries  # noqa: F401  (they register their queries)
from corvane.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(theirs)
    assert sorted(ours) == columns
    rows = lambda f: sorted(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()), key=repr)
    assert rows(ours) == rows(theirs)
