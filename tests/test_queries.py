"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from flowatlas.plans import registry
from flowatlas.plans.fixtures import BASE

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if pd.api.types.is_float_dtype(frame[c]):
            frame[c] = frame[c].round(9) + 0.0
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: "" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    found, expected = plain(registry.queries()[name](spark, FOLDER).toPandas()), plain(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(found, expected)
