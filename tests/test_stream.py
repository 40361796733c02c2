import pytest
from pyspark.sql import functions as F

from conftest import rows
from rowscrub.plans import workflow as W
from rowscrub.plans.settings import Workflow
from rowscrub.streaming import files as S

WF = Workflow.from_dict(
    {
        "regex_rules": {"v": ["latin_basic", "digits"]},
        "display_names": {"v": "body"},
        "dedup": {"unique_columns": ["v"]},
        "not_empty": {"columns": ["v"]},
        "year": 2024,
    }
)


def part(spark, ids):
    values = F.when(F.col("id") % 7 == 0, F.lit(" NULL ")).otherwise(F.concat(F.lit("V-"), (F.col("id") % 50).cast("string")))
    return spark.createDataFrame([(i,) for i in ids], "id long").select(values.alias("v"))


def test_stream_equals_batch_over_several_arrivals(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first, second = part(spark, range(100)), part(spark, range(60, 200))
    first.write.parquet(source)
    stream = lambda: S.stream_files(spark, source, like=first, files_per_batch=1)
    S.run_stream(stream(), WF, out, state, "all_time")
    second.write.mode("append").parquet(source)
    S.run_stream(stream(), WF, out, state, "all_time")
    S.run_stream(stream(), WF, out, state, "all_time")
    want = W.cli_workflow(spark.read.parquet(source), WF)
    assert rows(spark.read.parquet(out)) == rows(want)


def test_hot_key_is_thinned_out_before_the_final_removal(spark, tmp_path):
    source = str(tmp_path / "in")
    hot = spark.createDataFrame([("hot" if i % 3 == 0 else f"v{i}",) for i in range(3000)], "v string").repartition(4)
    hot.write.parquet(source)
    results = {}
    for salts in (1, 4):
        out, state = str(tmp_path / f"out{salts}"), str(tmp_path / f"state{salts}")
        S.run_stream(S.stream_files(spark, source, like=hot), WF, out, state, "all_time", salts=salts)
        results[salts] = rows(spark.read.parquet(out))
    assert results[1] == results[4] == rows(W.cli_workflow(hot, WF)) and len(results[4]) == 2001


def test_duplicates_choice(spark, tmp_path):
    source = str(tmp_path / "in")
    df = part(spark, range(100)).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(source)
    out = {}
    for choice in ("keep", "watermark", "all_time"):
        stream = S.stream_files(spark, source, like=df)
        S.run_stream(stream, WF, str(tmp_path / choice), str(tmp_path / f"{choice}-state"), choice, event_time="ts")
        out[choice] = spark.read.parquet(str(tmp_path / choice)).count()
    batch = W.cli_workflow(df, WF).count()
    assert out["all_time"] == out["watermark"] == batch < out["keep"]
    with pytest.raises(ValueError):
        S.clean_stream(S.stream_files(spark, source, like=df), WF, "watermark")


def test_delimited_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("v\nx-1\nx-1\n")
    stream = S.stream_files(spark, str(tmp_path / "in"), fmt="csv", header=True)
    S.run_stream(stream, WF, str(tmp_path / "out"), str(tmp_path / "state"), "all_time")
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("body")) == [("x1",)]


DELIMITED = Workflow.from_dict({"dedup": {"unique_columns": ["id", "v"]}, "not_empty": {"columns": ["v"]}, "year": 2024})


def test_delimited_stream_equals_batch(spark, tmp_path):
    """Quoted newlines, zeros, headers in other orders, copies over several arrivals."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    run = lambda: S.run_delimited_stream(spark, str(source), DELIMITED, out, state, "all_time", files_per_batch=1)
    (source / "a.csv").write_text('id,n,v\n1,0,"half\na text"\n2,5,x\n2,5,x\n')
    run()
    (source / "b.csv").write_text('v,id,n\nx,2,5\n"y\n\nz",3,0\n')
    (source / "c.csv").write_text("id,v\n4,w\n5,\n")
    run()
    run()
    batch = str(tmp_path / "batch")
    W.run_workflow(spark, str(source), DELIMITED, batch)
    got, want = spark.read.parquet(out), spark.read.parquet(batch)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.count() == 4 and got.where("n = 0").count() == 2


def test_types_are_fixed_by_the_first_batch(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "staged")
    source.mkdir()
    assert S.stage_delimited(spark, str(source), folder) is None
    (source / "a.csv").write_text("id,n\n1,2\n")
    assert S.stage_delimited(spark, str(source), folder).dtypes == [("id", "bigint"), ("n", "bigint")]
    (source / "b.csv").write_text("id,n\n2,x\n")
    with pytest.raises(Exception, match="n is not bigint"):
        S.stage_delimited(spark, str(source), folder)
    # The batch that failed runs again, and what it had written is replaced.
    S.stage_delimited(spark, str(source), folder, strict=False)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/rows/*").collect()), key=repr) == [(1, 2), (2, None)]
    (source / "c.csv").write_text("id,extra\n3,1\n")
    with pytest.raises(Exception, match="without a type"):
        S.stage_delimited(spark, str(source), folder)
