import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()
