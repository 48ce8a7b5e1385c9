"""Every registered query of the folder against its SQL on the smallest tables; the others return rows."""

import os

import duckdb
import pytest

from conftest import DATA
from corpuskeel.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows
    if name in ORACLES:
        duck = duckdb.connect()
        for t in TABLES:
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cursor = duck.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(rows[0].asDict())
        assert sorted(str([r[n] for n in names]) for r in rows) == sorted(str(list(r)) for r in cursor.fetchall())
