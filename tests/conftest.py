from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def duck(sf_dir: str):
    """A DuckDB connection with the tables of `sf_dir` as views."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame, columns by name, floats rounded, in any fixed order."""
    frame = frame[sorted(frame.columns)]

    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        if x is None or x != x:
            return None
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)
