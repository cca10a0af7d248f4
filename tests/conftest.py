import glob
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the small tables."""
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return lambda sql: c.sql(sql).df()


def canonical(frame):
    """Rows of a pandas frame as sorted tuples of text, whatever the order of rows and columns."""
    frame = frame.reindex(sorted(frame.columns), axis=1)

    def show(v):
        if v is None or v != v:  # noqa: PLR0124
            return "null"
        if isinstance(v, float) and v.is_integer():
            return str(int(v))
        return str(v)

    return sorted(tuple(show(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)

    return check
