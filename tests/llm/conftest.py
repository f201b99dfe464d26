import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def db():
    """The smallest tables in DuckDB."""
    con = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.001"):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/sf0.001/{f}'")
    return con
