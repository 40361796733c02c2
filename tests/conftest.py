import contextlib
import io
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowscrub.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.debug.maxToStringFields": "1000"}
    session = local_session(4, partitions=4, **shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to single text values."""

    def run(fn, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
        return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return run


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    """The physical plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()
