import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from rowscrub.operators.report import Report
from rowscrub.plans import workflow as W
from rowscrub.plans.settings import Workflow

DOCUMENT = """{
  "version": "1.0", "year": 2024, "country_code": "ru", "output_filename": "out.parquet",
  "columns": {"standalone": ["fio", "number_phone", "city", "make", "model"], "exclude": ["first_name", "last_name"]},
  "concatenations": [{"name": "fio", "source_columns": ["last_name", "first_name"], "separator": " "}],
  "regex_rules": {"fio": ["latin_basic", "hyphen"], "number_phone": ["digits"]},
  "display_names": {"number_phone": "phone"},
  "structure": {"main_info": ["fio", "number_phone", "additional_info"],
                "additional_info": ["city", {"car": ["make", "model"]}]},
  "dedup": {"unique_columns": ["fio", "number_phone"]},
  "not_empty": {"columns": ["fio"]},
  "export": {"format": "parquet", "parquet": {"compression": "zstd", "target_mb_per_file": 100},
             "csv": {"delimiter": "~", "quote_all": true}}
}"""
COLUMNS = "first_name string, last_name string, number_phone string, city string, make string, model string"


@pytest.fixture
def contacts(spark):
    return spark.createDataFrame(
        [
            ("Anna Maria", "Li", "+7 (999) 12-34", "Omsk", "VAZ", "0"),
            ("anna maria!", "LI", "7999 1234", "Tomsk", None, "2107"),
            (None, None, "5", "x", None, None),
            (None, "Bo", None, " NULL ", '"', None),
        ],
        COLUMNS,
    )


def test_standard_job(contacts):
    out = W.cli_workflow(contacts, Workflow.from_json(DOCUMENT), order_by=["fio"])
    assert out.columns == ["fio", "phone", "additional_info", "year", "country_code"]
    by_name = {r["fio"]: r for r in out.collect()}
    assert set(by_name) == {"li annamaria", "bo"}
    assert by_name["li annamaria"]["phone"] == "79991234"
    assert by_name["bo"]["phone"] is None and by_name["bo"]["year"] == 2024
    info = by_name["bo"]["additional_info"].asDict(recursive=True)
    assert info == {"city": None, "car": {"make": None, "model": None}}


def test_null_flow_of_concatenations(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    concat = {"concatenations": [{"name": "z", "source_columns": ["x", "y"], "separator": " "}]}

    def run(rules):
        return W.cli_workflow(df, Workflow.from_dict(concat | {"regex_rules": rules, "year": 2024})).first()["z"]

    assert run({}) is None
    assert run({"z": ["latin_basic"]}) == "a"
    missing = {"concatenations": [{"name": "z", "source_columns": ["x", "gone"], "separator": " "}]}
    report = Report()
    out = W.cli_workflow(df, Workflow.from_dict(missing), report=report)
    assert "z" not in out.columns and report.skipped("concat") == ["gone"]


def test_rules_are_split():
    wf = Workflow.from_dict(
        {
            "concatenations": [
                {"name": "z", "source_columns": ["x", "y"], "separator": ""},
                {"name": "w", "source_columns": ["y"], "separator": ""},
                {"name": "q", "source_columns": ["p"], "separator": ""},
            ],
            "regex_rules": {"z": ["digits"], "w": ["nope"], "q": [], "x": ["colon"], "y": ["colon"], "p": ["colon"]},
        }
    )
    on_sources, own = W.split_rules(wf, ["x", "y", "p"])
    assert on_sources == [("x", ["digits"]), ("y", ["digits"])]
    assert own == {"p": ["colon"]}


def test_unknown_classes(spark):
    df = spark.createDataFrame([("a",)], "x string")
    wf = Workflow.from_dict({"regex_rules": {"x": ["nope"]}, "year": 2024})
    with pytest.raises(ValueError, match="nope"):
        W.cli_workflow(df, wf)
    assert W.cli_workflow(df, wf, strict=False).first()["x"] is None


def test_exclusion_of_a_concatenation_differs(spark):
    df = spark.createDataFrame([("a",)], "x string")
    wf = Workflow.from_dict(
        {"concatenations": [{"name": "z", "source_columns": ["x"], "separator": ""}], "columns": {"exclude": ["z"]}, "year": 2024}
    )
    assert "z" in W.cli_workflow(df, wf).columns
    assert "z" not in W.lib_workflow(df, wf).columns
    assert W.lib_workflow(df, wf).columns == ["x"]


def test_case_differs(spark):
    df = spark.createDataFrame([("Ab'", 0)], "x string, n int")
    wf = Workflow.from_dict({"columns": {"standalone": ["x"]}, "year": 2024})
    assert tuple(W.cli_workflow(df, wf).first())[:2] == ("ab", 0)
    assert tuple(W.lib_workflow(df, wf).first()) == ("Ab", 0)
    assert tuple(W.full_workflow(df, wf).first()) == ("ab'", None)


def test_order_of_filter_and_duplicates(spark):
    df = spark.createDataFrame([(1, "k", None), (2, "k", "v")], "i int, k string, v string")
    wf = Workflow.from_dict({"dedup": {"unique_columns": ["k"]}, "not_empty": {"columns": ["v"]}, "year": 2024})
    assert W.cli_workflow(df, wf, ["i"]).count() == 1
    assert W.lib_workflow(df, wf, ["i"]).count() == 0


def test_required_columns(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    missing = Workflow.from_dict({"not_empty": {"columns": ["gone"]}, "year": 2024})
    with pytest.raises(ValueError):
        W.cli_workflow(df, missing)
    assert W.lib_workflow(df, missing).count() == 2
    nested = Workflow.from_dict(
        {"structure": {"main_info": ["x"], "additional_info": ["y"]}, "not_empty": {"columns": ["y", "year"]}, "year": 2024}
    )
    assert W.cli_workflow(df, nested).count() == 1


def test_nested_duplicate_keys_fall_away(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2")], "x string, y string")
    base = {"structure": {"main_info": ["x"], "additional_info": ["y"]}, "year": 2024}
    one = Workflow.from_dict(base | {"dedup": {"unique_columns": ["x", "y"]}})
    all_columns = Workflow.from_dict(base | {"dedup": {"unique_columns": ["y"]}})
    assert W.cli_workflow(df, one).count() == 1
    assert W.cli_workflow(df, all_columns).count() == 2


def test_full_job_order(spark):
    """Sources are cleaned before they are joined; a last concatenation keeps its text as it is."""
    df = spark.createDataFrame([("Nu", "LL", "0"), ("\tA ", None, "b")], "x string, y string, z string")
    concat = [{"name": "c", "source_columns": ["x", "y"], "separator": ""}]

    def run(standalone, **kw):
        wf = Workflow.from_dict({"concatenations": concat, "columns": {"standalone": standalone}, "display_names": {"c": "C"}})
        return rows(W.full_clean(df, wf, **kw).select("C", "z"))

    assert run(["c"]) == [("null", None), (None, "b")]
    assert run(["c", "z"]) == [(None, "b"), (None, None)]
    assert run(["c", "z"], empty="-") == [("-", "-"), ("a-", "b")]
    assert run(["c"], nullify=False) == [("null", "0"), (None, "b")]


def test_self_configured(spark):
    df = spark.createDataFrame([("a+1", "Щ"), ("a+1", "Щ"), ("b", None)], "x string, y string")
    wf = W.self_configured(df, year=2024)
    assert wf.regex_rules == {"x": ["digits", "latin_basic"], "y": ["cyrillic_common"]}
    assert rows(W.cli_workflow(df, wf).select("x", "y")) == [("a1", "щ"), ("b", None)]


def test_run_writes_parquet_and_csv(spark, contacts, tmp_path):
    contacts.write.parquet(str(tmp_path / "in.parquet"))
    wf = Workflow.from_json(DOCUMENT)
    W.run_workflow(spark, str(tmp_path / "in.parquet"), wf, str(tmp_path / "out.parquet"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    flat = Workflow.from_dict({"export": {"format": "csv", "csv": {"delimiter": "|", "quote_all": True}}})
    (tmp_path / "in.csv").write_text("a,b\n1,x\n1,x\n2,y\n")
    W.run_workflow(spark, str(tmp_path / "in.csv"), flat, str(tmp_path / "out"), variant="lib")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"1"|"x"' in text and text.count('"2"|"y"') == 1
    W.run_workflow(spark, str(tmp_path / "in.csv"), flat, str(tmp_path / "o.parquet"), variant="lib")
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2


def test_plan_of_the_standard_job(spark, contacts, tmp_path):
    contacts.write.parquet(str(tmp_path / "in.parquet"))
    df = spark.read.parquet(str(tmp_path / "in.parquet"))
    plan = plan_of(W.cli_workflow(df, Workflow.from_json(DOCUMENT)))
    assert plan.count("Exchange") == 1
    # fio, phone, city, make, model: each cleaned once although fio is filtered on.
    assert plan.count("{2,}") == 5
    assert "Python" not in plan


def test_current_year_is_the_default(spark):
    from datetime import datetime

    out = W.cli_workflow(spark.createDataFrame([("a",)], "x string"), Workflow())
    assert tuple(out.first()) == ("a", datetime.now().year, "ru")


def test_all_columns_of_a_struct_table(spark):
    df = spark.createDataFrame([(1, "a")] * 2, "n int, v string").select("n", F.struct("v").alias("s"))
    assert W.cli_workflow(df, Workflow(year=2024)).count() == 1


def test_output_name_several_inputs_and_plan(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"Text {i}")], "id int, t string").write.parquet(str(tmp_path / f"in{i}.parquet"))
    wf = Workflow.from_dict({"year": 2024, "output_filename": "done.parquet"})
    W.run_workflow(spark, [str(tmp_path / "in[01].parquet"), str(tmp_path / "in2.parquet")], wf, f"{tmp_path}/")
    assert spark.read.parquet(str(tmp_path / "done.parquet")).count() == 3
    plan = plan_of(W.cli_workflow(spark.read.parquet(str(tmp_path / "in0.parquet")), wf))
    assert "HashAggregate" in plan and "Sort [" not in plan and "Window" not in plan


def test_run_cuts_and_parses_text_once(spark, tmp_path, monkeypatch):
    """Types and the job read the parsed cells, not the text."""
    lines = ["id,t,T 2"] + [f'{i},"Line {i}\nnext, ""{i}""",{i / 2}' for i in range(50)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    plans, infer = [], W.readers.infer_types

    def watched(df, *rest):
        plans.append(plan_of(df))
        return infer(df, *rest)

    monkeypatch.setattr(W.readers, "infer_types", watched)
    W.run_workflow(spark, str(tmp_path / "in.csv"), Workflow.from_dict({"year": 2024}), str(tmp_path / "out.parquet"))
    assert len(plans) == 1 and "FileScan text" not in plans[0] and "MapInPandas" not in plans[0]
    out = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["T 2"] == "double"
    assert sorted(r["id"] for r in out.collect()) == list(range(50))
