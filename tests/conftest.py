from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankloom.session import build_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true", spark__default__parallelism="4"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same(spark, con):
    """Whether a query and its SQL give the same rows on the smallest data."""

    def check(query, sql):
        df = query(spark, str(DATA))
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        mine = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
        theirs = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in cur.fetchall())
        assert mine == theirs

    return check
