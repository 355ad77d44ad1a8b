"""One local session, the repository's root on the path, and queries beside their SQL."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", 6).config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def plain(value) -> str:
    """A value as text; doubles to six digits, -0 as 0."""
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(plain, value)) + "]"
    return repr(value)


@pytest.fixture
def against_sql(spark):
    """Compare a query with its SQL on one data directory, as bags of rows."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    def compare(name: str, d: str = "/root/testdata/sf0.01") -> int:
        con = duckdb.connect()
        for path in Path(d).glob("*.parquet"):
            at = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{at}')")
        got = queries()[name](spark, d)
        rows = sorted(map(plain, map(tuple, got.collect())))
        named = ", ".join(f'"{c}"' for c in got.columns)
        want = con.execute(f"SELECT {named} FROM ({oracle_sql()[name]})").fetchall()
        assert rows == sorted(map(plain, want)), name
        return len(rows)

    return compare
