"""Files of an asked size and slices by position."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from rowscrub.sources import sized


def uneven(spark, n, parts):
    """Rows of very unequal length that hardly compress."""
    length = F.when(F.col("id") % 97 == 0, 120).when(F.col("id") < n // 3, 2).otherwise(F.col("id") % 15)
    text = F.array_join(F.transform(F.sequence(F.lit(1), length + 1), lambda i: F.sha2(F.concat_ws("-", "id", i.cast("string")), 256)), "")
    return spark.range(0, n, 1, parts).select(F.col("id").cast("long").alias("id"), text.alias("text"))


@pytest.mark.parametrize(("parts", "target_mb"), [(200, 0.5), (2, 0.5)])
def test_tiny_and_huge_tasks_give_files_of_the_size(spark, tmp_path, parts, target_mb):
    df = uneven(spark, 12_000, parts)
    out = str(tmp_path / "t.parquet")
    sizes = sized.write_sized(df, out, target_mb)
    assert len(sizes) > 5
    assert all(abs(s / (target_mb * (1 << 20)) - 1) < 0.2 for s in sizes[:-1])
    assert {f for f in os.listdir(out) if f.endswith("parquet")} == {f"t_part_{i + 1}.parquet" for i in range(len(sizes))}
    assert [os.path.getsize(f"{out}/t_part_{i + 1}.parquet") for i in range(len(sizes))] == sizes
    assert rows(spark.read.parquet(out)) == rows(df)
    last = -1
    for i in range(len(sizes)):  # rows keep their order through the files
        ids = [r["id"] for r in spark.read.parquet(f"{out}/t_part_{i + 1}.parquet").coalesce(1).collect()]
        assert ids == list(range(last + 1, last + 1 + len(ids)))
        last = ids[-1]
    assert [f for f in os.listdir(tmp_path) if f.startswith("_")] == []


def test_many_small_files_are_dealt_by_few_tasks_and_written_once(spark, tmp_path, monkeypatch):
    plans, write = [], sized._write_parts

    def watched(df, *rest):
        plans.append(plan_of(df))
        write(df, *rest)

    monkeypatch.setattr(sized, "_write_parts", watched)
    df, out = uneven(spark, 12_000, 5), str(tmp_path / "t")
    sizes = sized.write_sized(df, out, 0.03)
    assert len(sizes) > 100 and rows(spark.read.parquet(out)) == rows(df)
    most = sized.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for plan in plans:
        assert "regexp_extract" not in plan  # names of files are not taken apart for each row
        assert all(int(n) <= most for n in re.findall(r"Exchange \w+\(.*, (\d+)\)", plan)) and "Exchange" in plan


def test_modes_and_odd_tables(spark, tmp_path):
    out = str(tmp_path / "t")
    empty = spark.createDataFrame([], "file string, at long, part long")
    assert len(sized.write_sized(empty, out)) == 1
    assert spark.read.parquet(out).columns == ["file", "at", "part"] and spark.read.parquet(out).count() == 0
    odd = spark.createDataFrame([(None, None, None), ("x", 1, None), ("x", 1, None), ("y" * 300_000, 2, [1])], "file string, row long, cuts array<int>")
    with pytest.raises(FileExistsError):
        sized.write_sized(odd, out)
    assert spark.read.parquet(out).count() == 0
    sized.write_sized(odd, out, target_mb=0.001, mode="overwrite", name="n")
    assert rows(spark.read.parquet(out)) == rows(odd)
    with pytest.raises(ValueError):
        sized.write_sized(odd, out, mode="append")


def test_failed_job_leaves_the_old_table(spark, tmp_path):
    out = str(tmp_path / "t")
    sized.write_sized(spark.range(5), out)
    with pytest.raises(Exception, match="stop here"):
        sized.write_sized(spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")).alias("id")), out, mode="overwrite")
    assert spark.read.parquet(out).count() == 5 and os.listdir(tmp_path) == ["t"]


def test_slices_by_position(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.range(0, 1000, 1, 13).select("id", (F.col("id") * 2).alias("start"), F.lit("p").alias("path")).write.parquet(out)
    part = sized.slice_table(spark, out, 333, 100)
    assert part.columns == ["id", "start", "path"]
    assert rows(part) == [(i, 2 * i, "p") for i in range(333, 433)]
    assert len(part.inputFiles()) <= 3
    assert sorted(r["id"] for r in sized.slice_table(spark, out, 990, 500).collect()) == list(range(990, 1000))
    for offset, length in ((1000, 5), (5000, 1), (10, 0)):
        assert sized.slice_table(spark, out, offset, length).count() == 0
    assert sized.slice_table(spark, out, 0, 1 << 40).count() == 1000
    with pytest.raises(ValueError):
        sized.slice_table(spark, out, -1, 5)


def test_slices_of_numbered_files(spark, tmp_path):
    out = str(tmp_path / "t")
    sizes = sized.write_sized(uneven(spark, 3000, 5), out, 0.06)
    assert len(sizes) > 10  # part 10 sorts before part 2 by name
    found = sized.slice_table(spark, out, 2000, 300)
    assert sorted(r["id"] for r in found.collect()) == list(range(2000, 2300)) and len(found.inputFiles()) < len(sizes)
