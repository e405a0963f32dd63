"""One session for all tests, and the SQL yardstick over the same files."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import create

    session = create(
        "tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    from tidewater.session import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    """A value as both engines would write it."""
    import datetime
    import decimal

    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return f"{value} 00:00:00"
    return str(value)


def same_rows(ours: list, theirs: list, ours_columns: list[str], their_columns: list[str]) -> None:
    assert sorted(ours_columns) == sorted(their_columns)
    a = [ours_columns.index(c) for c in sorted(ours_columns)]
    b = [their_columns.index(c) for c in sorted(their_columns)]
    key = lambda row: tuple("" if v is None else v for v in row)
    x = sorted((tuple(plain(r[i]) for i in a) for r in ours), key=key)
    y = sorted((tuple(plain(r[i]) for i in b) for r in theirs), key=key)
    assert x == y


def check(df, duck, sql: str) -> None:
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    same_rows([tuple(r) for r in df.collect()], found.fetchall(), df.columns, names)
