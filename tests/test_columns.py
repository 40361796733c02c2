import json

import pytest

from conftest import plan_of, rows
from rowscrub.operators import columns as C
from rowscrub.operators.report import Report


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("li", "omsk", "vaz", "2107", 1)], "fio string, city string, make string, model string, n int")


def test_nest(people):
    nested = C.nest(people, ["fio"], ["city", {"car": ["make", "model"]}, "gone", "car", {"empty": ["gone"]}])
    assert nested.dtypes == [("fio", "string"), ("additional_info", "struct<city:string,car:struct<make:string,model:string>>")]
    nothing = C.nest(people, ["fio", "additional_info"], ["gone"])
    assert nothing.collect()[0] == ("li", None) and nothing.dtypes[1][1] == "string"
    assert C.nest(people, [], []).columns == people.columns
    assert C.nest(people, [], ["n"]).columns == ["additional_info"]


def test_nest_auto(people):
    assert C.split_main(["a", "fio", "b"], ["fio", "zz"]) == (["fio"], ["a", "b"])
    assert C.split_main(["a", "b"], ["FIO"], {"b": " fio "}) == (["b"], ["a"])
    assert C.split_main(["a", "b"], ["a"], {"a": "x"}) == (["a"], ["b"])
    assert C.nest_auto(people, ["fio"]).columns == ["fio", "additional_info"]


def test_concat(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "b", 2)], "x string, y string, n int")
    assert rows(C.concat_columns(df, "z", ["x", "y", "n"], "-").select("z")) == [("a-b-2",), (None,)]
    report = Report()
    assert C.concat_columns(df, "z", ["x", "nope"], "-", report=report).columns == df.columns
    assert report.skipped("concat") == ["nope"]
    chained = C.concat_columns(df, "z", ["x"], "-")
    assert "w" not in C.concat_columns(chained, "w", ["z", "x"], "-", known=df.columns).columns


def test_concat_trimmed(spark):
    df = spark.createDataFrame([(" a ", 1)], "x string, n int")
    assert C.concat_trimmed(df, "z", ["x", "n"], "-").collect()[0]["z"] == "a-1"
    with pytest.raises(ValueError):
        C.concat_trimmed(df, "x", ["n"], "")


def test_concat_cleaned(spark):
    df = spark.createDataFrame([("A1", "B"), ("1", "B")], "x string, y string")
    got = C.concat_cleaned(df, "z", ["x", "y"], "-", ["latin_basic"])
    assert rows(got) == [("a", "b", "a-b"), (None, "b", None)]


def test_exclude_and_rename(people):
    report = Report()
    assert C.exclude_columns(people, ["n", "zz"], report=report).columns == ["fio", "city", "make", "model"]
    assert report.skipped("exclude") == ["zz"]
    assert C.exclude_columns(people, ["n"], known=["fio"]).columns == people.columns
    assert C.rename_columns(people, {"fio": "name", "n": "n", "zz": "q"}).columns[0] == "name"
    with pytest.raises(ValueError):
        C.rename_columns(people, {"fio": "city"})


def test_export_names(people):
    names = {"fio": "x", "city": "x", "make": "", "model": "x"}
    assert C.export_projection(people, names, ["n"]).columns == ["x", "x_2", "make", "x_3"]
    assert C.visible_projection(people, ["n", "fio"], {"n": "N"}).columns == ["fio", "N"]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(" a ", "0")], "`a.b` string, `c``d` string")
    assert C.clean_strings(df).collect()[0] == ("a", None)
    assert C.nest(df, ["a.b"], ["c`d"]).columns == ["a.b", "additional_info"]


def test_metadata(people):
    df = C.add_metadata(people.withColumnRenamed("n", "year"), 2024)
    assert df.columns == ["fio", "city", "make", "model", "year", "country_code"]
    assert df.collect()[0]["year"] == 2024 and dict(df.dtypes)["year"] == "int"


def test_filter_does_not_repeat_the_cleaning(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "v string, w string").write.parquet(str(tmp_path / "t"))
    df = C.computed_once(C.clean_strings(spark.read.parquet(str(tmp_path / "t"))))
    plan = plan_of(df.where("v is not null"))
    assert plan.count("{2,}") == 2, plan
    assert "Exchange" not in plan


def test_only_used_columns_are_read(spark, tmp_path):
    spark.createDataFrame([("a", "b", 1)], "v string, w string, n int").write.parquet(str(tmp_path / "t"))
    df = C.clean_strings(spark.read.parquet(str(tmp_path / "t"))).select("v")
    assert "ReadSchema: struct<v:string>" in plan_of(df)


def test_nested_json(people):
    nested = C.nest(people, ["fio"], ["n", {"car": ["make"]}])
    assert json.loads(nested.toJSON().first())["additional_info"] == {"n": 1, "car": {"make": "vaz"}}


@pytest.fixture
def case_sensitive(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


def test_names_that_differ_in_case_are_refused(spark):
    df = spark.createDataFrame([(1, 2020, "x")], "id int, Year int, Label string")
    with pytest.raises(ValueError, match="case"):
        C.add_metadata(df, 2024)
    for concat in (C.concat_columns, C.concat_trimmed):
        with pytest.raises(ValueError, match="case"):
            concat(df, "label", ["id", "Label"], "-")
    with pytest.raises(ValueError, match="duplicate"):
        C.rename_columns(df, {"Label": "ID"})
    assert C.unique_names(["a", "A", "a", "a_2"], ignore_case=True) == ["a", "A_2", "a_3", "a_2_2"]
    assert C.unique_names(["a", "A", "a", "a_2", "a"]) == ["a", "A", "a_2", "a_2_2", "a_3"]


def test_names_that_differ_in_case_with_the_setting(spark, case_sensitive):
    df = spark.createDataFrame([(1, 2020, "x")], "id int, Year int, Label string")
    got = C.add_metadata(C.concat_columns(df, "label", ["id", "Label"], "-"), 2024)
    assert got.columns == ["id", "Year", "Label", "label", "year", "country_code"]
    assert tuple(got.first()) == (1, 2020, "x", "1-x", 2024, "ru")
    assert C.rename_columns(df, {"Label": "ID"}).columns == ["id", "Year", "ID"]
