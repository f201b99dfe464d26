"""The queries that SQL can express, against it, in every column."""

import pytest

from lantern.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_by_sql(spark, db, name):
    want = db.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == names
    rows = db.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(rows) >= 200 and sorted(map(tuple, got.select(*names).collect())) == sorted(rows)
