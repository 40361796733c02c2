import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from rowscrub.operators import rows as R
from rowscrub.operators.report import Report


@pytest.fixture
def keyed(spark):
    return spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), ("a", 3, "z")], "k string, n int, v string")


def test_dedup_keys(keyed):
    assert R.dedup(keyed, ["k"]).count() == 2
    assert R.dedup(keyed, ["missing"]).count() == 3
    assert R.dedup(keyed, []).count() == 3
    assert R.dedup(keyed.unionByName(keyed)).count() == 3
    report = Report()
    R.dedup(keyed, ["k", "missing"], report=report)
    assert report.skipped("dedup") == ["missing"]


def test_dedup_order(keyed):
    assert rows(R.dedup(keyed, ["k"], ["n"]).select("v")) == [("x",), ("z",)]
    assert rows(R.dedup(keyed, ["k"], [F.col("n").desc()]).select("v")) == [("y",), ("z",)]


def test_dedup_of_structs(spark):
    df = spark.createDataFrame([(1, 2)] * 3, "a int, b int").select(F.struct("a", "b").alias("s"))
    assert R.dedup(df).count() == 1


def test_hot_key_is_reduced_before_the_shuffle(spark, tmp_path):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    spark.range(3000).select(hot.alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for order in (None, ["v"]):
        out = R.dedup(df, ["k"], order)
        plan = plan_of(out)
        exchange = plan.index("Exchange")
        assert plan.count("Exchange") == 1 and "Partial" in plan[exchange:]
        assert out.count() == 2001
    whole = plan_of(R.dedup(df))
    assert whole.count("HashAggregate") == 2 and whole.count("Exchange") == 1


def test_required(keyed):
    assert R.require_not_null(keyed, ["k"]).count() == 1
    assert R.require_not_null(keyed, ["k", "zz"], strict=False).count() == 1
    assert R.require_not_null(keyed, []).count() == 3
    with pytest.raises(ValueError):
        R.require_not_null(keyed, ["zz"])


def test_required_not_empty(spark):
    df = spark.createDataFrame([(v,) for v in ["", " ", "nan", "NULL", " 0 ", " ", None, "x", "00"]], "v string")
    assert rows(R.require_not_empty(df, ["v"])) == [("00",), ("x",)]
    numbers = spark.createDataFrame([(0,), (1,)], "n int")
    assert rows(R.require_not_empty(numbers, ["n"])) == [(1,)]
    with pytest.raises(ValueError):
        R.require_not_empty(df, ["zz"])


def test_heads_and_slices(spark):
    df = spark.range(100)
    assert [r[0] for r in R.head_rows(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert R.head_rows(df, 7).count() == 7
    assert [r[0] for r in R.slice_rows(df, 10, 3, ["id"]).collect()] == [10, 11, 12]
    assert R.vstack([df, df, df]).count() == 300


def test_dedup_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("b", 3, 9)], "k string, __rank int, rank int")
    got = R.dedup(df, ["k"], ["__rank"])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [("a", 1, 7), ("b", 3, 9)]
