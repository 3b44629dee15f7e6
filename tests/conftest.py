"""One session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessella.session import build_session

    session = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__default__parallelism="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.ndim == 0 or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    names = sorted(frame.columns)
    return sorted(str([_cell(v) for v in r]) for r in frame[names].astype(object).values.tolist())


@pytest.fixture(scope="session")
def same_rows():
    def check(a: pd.DataFrame, b: pd.DataFrame) -> None:
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
