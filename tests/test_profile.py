from pyspark.sql import functions as F

from conftest import plan_of, rows
from rowscrub.functions import patterns as P
from rowscrub.operators import profile as A


def found(df, column=None):
    out = {}
    for r in df.where("found").collect():
        out.setdefault(r["column"], set()).add(r["pattern"])
    return out.get(column, set()) if column else out


def test_containment_and_first_match(spark):
    for value, contained, first in [
        ("Ұ", {"kazakh_cyrillic"}, {"kazakh_cyrillic"}),
        ("ұ", {"kazakh_cyrillic", "cyrillic_extended"}, {"kazakh_cyrillic"}),
        ("Ү", set(), set()),
        ("\\u0020", {"backslash", "latin_basic", "digits", "literal_escaped_space"}, {"literal_escaped_space"}),
    ]:
        df = spark.createDataFrame([(value,)], "v string")
        assert found(A.pattern_profile(df), "v") == contained
        assert {r["pattern"] for r in A.pattern_set_first(df).collect()} == first


def test_types_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 1.5, None, True), (-2, float("nan"), None, False), (None, None, None, None)],
        "i bigint, d double, n string, b boolean",
    )
    got = found(A.pattern_profile(df))
    assert got == {"i": {"digits", "hyphen"}, "d": {"digits", "period", "latin_basic"}, "b": {"latin_basic"}}
    assert {r["pattern"] for r in A.pattern_set_column(df, "d").collect()} == {"digits", "period"}
    assert A.pattern_profile(df).count() == 4 * len(P.PATTERNS)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert A.pattern_profile(empty).count() == 56 and found(A.pattern_profile(empty)) == {}
    assert [r["detected_patterns"] for r in A.column_metadata(A.pattern_profile(empty)).collect()] == [[], []]


def test_one_scan_and_tiny_shuffle(spark, tmp_path):
    spark.range(10).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(20)]).write.parquet(str(tmp_path / "t"))
    plan = plan_of(A.pattern_profile(spark.read.parquet(str(tmp_path / "t"))))
    assert plan.count("FileScan") == 1
    assert "partial_bit_or" in plan[plan.index("Exchange"):]


def test_metadata(spark):
    meta = A.column_metadata(A.pattern_profile(spark.createDataFrame([("a1+", "b")], "x string, y string"), uncovered=True), ["x"])
    by_name = {r["column"]: r for r in meta.collect()}
    x = by_name["x"]
    assert x["detected_patterns"] == x["selected_patterns"] == ["digits", "latin_basic"]
    assert x["detected_display_patterns"] == ["Цифры (0–9)", "Латиница (A–Z, a–z)"]
    assert x["uncovered_chars"] and not by_name["y"]["uncovered_chars"]
    assert (x["mode"], by_name["y"]["mode"]) == ("standalone", "exclude")
    merged = A.concat_metadata(meta, "z", ["x", "y"], "-").first()
    assert merged["detected_patterns"] == ["digits", "latin_basic"] and merged["prev_selected_patterns"] is None
    assert merged["concatenated"]["source_columns"] == ["x", "y"]
    assert meta.unionByName(A.concat_metadata(meta, "z", ["x"], "-")).count() == 3


def test_table_info(spark):
    assert A.table_info(spark.range(5).withColumn("b", F.lit(1))).first() == (5, 2, "id,b")


def test_fingerprint(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    base = A.table_fingerprint(df).first()[0]
    assert base == A.table_fingerprint(df.repartition(7)).first()[0]
    assert base != A.table_fingerprint(df.where("id > 0")).first()[0]
    assert base != A.table_fingerprint(df.union(df.limit(1))).first()[0]
    assert base != A.table_fingerprint(df.withColumnRenamed("v", "w")).first()[0]


def test_profile_reuse(spark, tmp_path):
    path = str(tmp_path / "profile")
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    first, reused = A.profile_or_reuse(df, path)
    assert not reused
    again, reused = A.profile_or_reuse(df.repartition(2), path)
    assert reused and rows(again) == rows(first)
    other, reused = A.profile_or_reuse(df.where("v = 'a'"), path)
    assert not reused
    assert not A.profile_or_reuse(df.withColumnRenamed("v", "w"), path)[1]


def test_fingerprint_tells_where_nulls_are(spark):
    schema = "a string, b string"
    one = A.table_fingerprint(spark.createDataFrame([(None, "abc")], schema)).first()[0]
    two = A.table_fingerprint(spark.createDataFrame([("abc", None)], schema)).first()[0]
    other_types = A.table_fingerprint(spark.createDataFrame([(None, "abc")], "a int, b string")).first()[0]
    odd_name = A.table_fingerprint(spark.createDataFrame([("x",)], "`a``b` string")).first()[0]
    assert len({one, two, other_types, odd_name}) == 4
