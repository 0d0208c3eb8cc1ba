"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge import registry
from tests.compare import rows

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
