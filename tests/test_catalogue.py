"""Each query of the catalogue against its DuckDB twin, over the whole of sf0.001."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from measurelake import catalogue, catalogue_plans  # noqa: F401  (its queries join the catalogue)

DATA = "/root/testdata/sf0.001"


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_twin(spark, duck, name: str) -> None:
    got, want = ordered(catalogue.QUERIES[name](spark, DATA).toPandas()), ordered(duck.execute(catalogue.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
