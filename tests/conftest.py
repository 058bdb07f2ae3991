import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def canonical(df):
    """Rows of a pandas frame as sorted texts, columns by name."""

    def said(v):
        if v is None or type(v).__name__ in ("NaTType", "NAType") or isinstance(v, float) and math.isnan(v):
            return "~"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.6g}"
        return str(v)[:200].removesuffix(" 00:00:00")

    return sorted("|".join(map(said, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    return canonical
