import csv
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from rowscrub.functions.fields import open_quote, split_fields
from rowscrub.operators import records as B
from rowscrub.operators import repair as S

HEADER = ["a", "b", "c"]


def checked(spark, lines, **kw):
    return S.check_records(spark.createDataFrame([(v,) for v in lines], "value string"), HEADER, **kw)


def test_golden_records(spark):
    got = checked(spark, ["1,2,3", "4,5", "6,7,8,9", "", '"x,y",q,"z ""k"""', '"x,y",q'])
    assert rows(S.valid_rows(got, HEADER)) == [("1", "2", "3"), ("x,y", "q", 'z "k"')]
    assert [r[1:] for r in rows(S.bad_rows(got, ["value"]))] == [
        ("structure", "Неверное количество столбцов: 2 вместо 3", "x,y,q"),
        ("structure", "Неверное количество столбцов: 0 вместо 3", ""),
        ("structure", "Неверное количество столбцов: 2 вместо 3", "4,5"),
        ("structure", "Неверное количество столбцов: 4 вместо 3", "6,7,8,9"),
    ]
    assert rows(S.repair_counts(got)) == [("structure", 4), ("valid", 2)]


@pytest.mark.parametrize("delimiter", [",", "|", "\t"])
def test_every_short_line_splits_as_the_standard_reader(spark, delimiter):
    lines = ["".join(p) for n in range(7) for p in itertools.product(f'a{delimiter}"', repeat=n)]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    value = F.col("value")
    got = df.select("value", split_fields(value, delimiter).alias("f"), open_quote(value, delimiter).alias("o")).collect()
    assert len(got) == len(lines)
    for r in got:
        reader = csv.reader(io.StringIO(r["value"] + "\nNEXT\n", newline=""), delimiter=delimiter)
        first = next(reader)
        assert r["o"] == (len(list(reader)) == 0), r
        if not r["o"]:
            assert r["f"] == first, r


def test_long_quoted_field(spark):
    text = 'a""' * 50_000
    got = checked(spark, [f'1,"{text}",3'])
    assert S.valid_rows(got, HEADER).select(F.length("b")).first()[0] == 100_000


def test_types(spark):
    got = checked(spark, ["1,2,3", "1,x,3", "1,,3"], types={"b": "bigint"})
    assert rows(S.bad_rows(got, [])) == [("processing", "Ошибка обработки: b is not bigint", "1,x,3")]
    assert S.valid_rows(got, HEADER).count() == 2


def write_lines(path, lines):
    path.write_bytes("".join(line + "\n" for line in lines).encode())


def random_lines(seed, n):
    rnd = random.Random(seed)
    return [",".join("ab"[: rnd.randint(0, 2)] for _ in range(rnd.choice([0, 2, 3, 3, 3, 4]))) for _ in range(n)]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_numbers_across_blocks_and_files(spark, tmp_path, small_blocks):
    want = []
    for i, size in enumerate([3000, 10, 1, 1500]):
        lines = ["a,b,c", *random_lines(i, size)]
        write_lines(tmp_path / f"part{i}.csv", lines)
        for n, row in enumerate(csv.reader(lines), start=1):
            if n > 1 and len(row) != 3:
                want.append((n, "structure", S.WRONG_COUNT.format(len(row), 3), ",".join(row)))
    got, header = S.repair_files(spark, str(tmp_path))
    assert header == HEADER
    assert rows(S.bad_rows(got)) == sorted(want, key=repr)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4


def test_numbers_through_the_whole_dataset(spark, tmp_path, small_blocks):
    lines = [str(i) for i in range(2000)]
    write_lines(tmp_path / "a.txt", lines[:900])
    write_lines(tmp_path / "b.txt", lines[900:])
    got = B.number_records(B.scan_lines(spark, str(tmp_path)), "dataset")
    assert got.where("row_number = cast(value as bigint) + 1").count() == 2000


def test_many_blocks_are_joined_without_broadcast(spark, tmp_path, small_blocks, monkeypatch):
    write_lines(tmp_path / "a.txt", [str(i) for i in range(3000)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(B.number_records(B.scan_lines(spark, str(tmp_path))))
        monkeypatch.setattr(B, "broadcast_bytes", lambda spark: 0)
        got = B.number_records(B.scan_lines(spark, str(tmp_path)))
        plan = plan_of(got)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert got.where("row_number = cast(value as bigint) + 1").count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bad_bytes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b,c\r\n1,\xff2,3\r\n\r\n4,5\r\n")
    got, _ = S.repair_files(spark, str(tmp_path / "a.csv"))
    assert rows(S.valid_rows(got, HEADER)) == [("1", "2", "3")]
    assert [(r["row_number"], r["content"]) for r in S.bad_rows(got).orderBy("row_number").collect()] == [(3, ""), (4, "4,5")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    got, header = S.repair_files(spark, str(tmp_path / "a.csv"))
    assert header == [] and got.count() == 0


def test_complete_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,"na~me",x\n1,"a ""b""",\n2\n\n3,c,d\n')
    counts = S.repair_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert rows(counts) == [("structure", 2), ("valid", 2)]
    good = b"".join(p.read_bytes() for p in sorted((tmp_path / "good").glob("part-*"))).decode()
    assert sorted(set(good.split("\r\n"))) == ["", '"1"~"a ""b"""~""', '"3"~"c"~"d"', '"id"~"na~me"~"x"']
    bad = list(csv.reader(io.StringIO("".join(p.read_text() for p in (tmp_path / "bad").glob("*.csv"))), delimiter="~"))
    assert bad[0] == ["row_number", "error_type", "description", "content"]
    assert [r[0] for r in bad if r[0] != "row_number"] == ["3", "4"]


def test_checking_is_done_once(spark, tmp_path):
    write_lines(tmp_path / "a.csv", ["1,2,3"])
    df = S.valid_rows(S.check_records(spark.read.text(str(tmp_path)), HEADER), HEADER)
    assert plan_of(df).count("regexp_extract_all(") == 1


def multi_line_text(seed, n):
    """Random records with newlines, delimiters and quotes inside quoted fields."""
    rnd = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["a", "b", "c"])
    for _ in range(n):
        if rnd.random() < 0.1:
            out.write(rnd.choice(["\n", "1,2\n", 'x"y,"z\n\n",w,v\n', '"p"q"\n']))
        fields = ["".join(rnd.choice(['a', ',', '"', "\n", "\r\n", " "]) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.choice([2, 3, 3, 3]))]
        writer.writerow(fields)
    return out.getvalue()


@pytest.mark.parametrize("block", ["64", "1000", "1000000"])
def test_multi_line_records_as_the_standard_reader(spark, tmp_path, block):
    want = []
    for i in range(3):
        text = multi_line_text(i, 40 if block == "64" else 400)
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
        want += [(f"f{i}.csv", n, row) for n, row in enumerate(csv.reader(io.StringIO(text, newline="")), start=1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        records = B.read_records(spark, str(tmp_path))
        name = F.element_at(F.split("file", "/"), -1)
        got = records.select(name.alias("f"), "row_number", split_fields(F.col("value")).alias("x")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["f"], r["row_number"], r["x"]) for r in got) == sorted(want)


def test_multi_line_without_broadcast(spark, tmp_path, small_blocks, monkeypatch):
    text = multi_line_text(7, 800)
    (tmp_path / "f.csv").write_bytes(text.encode())
    monkeypatch.setattr(B, "broadcast_bytes", lambda spark: 0)
    got = B.read_records(spark, str(tmp_path)).select("row_number", split_fields(F.col("value")).alias("x")).collect()
    assert sorted((r[0], r[1]) for r in got) == list(enumerate(csv.reader(io.StringIO(text, newline="")), start=1))


def test_multi_line_job(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b'a,b\r\n1,"x\ny\r\nz"\r\n2\r\n3,"open\n')
    counts = S.repair_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "good"), str(tmp_path / "bad"), multi_line=True)
    assert rows(counts) == [("structure", 1), ("valid", 2)]
    good = b"".join(p.read_bytes() for p in (tmp_path / "good").glob("part-*"))
    assert b'"1"~"x\ny\r\nz"\r\n' in good and b'"3"~"open"\r\n' in good


@pytest.mark.parametrize(("batch", "block"), [("1", "1000000"), ("500", "64"), ("10000", "100000"), ("10000", "64")])
def test_long_records_do_not_depend_on_batches_and_blocks(spark, tmp_path, batch, block):
    rows_ = ["a,b", '1,"' + "x" * 300 + "\n" * 200 + '"', "2,y", '3,"' + "z\n" * 400]
    (tmp_path / "in.csv").write_text("\n".join(rows_))
    settings = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = B.read_records(spark, str(tmp_path), limit=600).orderBy("row_number").collect()
        checked, header = S.repair_files(spark, str(tmp_path), multi_line=True, limit=600)
        bad = S.bad_rows(checked).collect()
        good = rows(S.valid_rows(checked, header))
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert [(r["row_number"], r["chars"]) for r in got] == [(1, 3), (2, 504), (3, 3), (4, 802)]
    assert got[1]["value"] == rows_[1] and got[3]["value"] == rows_[3][:600]
    assert [(r["row_number"], r["description"]) for r in bad] == [(4, S.TOO_LONG.format(600))]
    assert good == [("1", "x" * 300 + "\n" * 200), ("2", "y")]


def test_quoted_field_longer_than_the_old_limit(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n1,"' + "x" * 150_000 + '"\n2,y\n')
    for batch in ("500", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert B.read_records(spark, str(tmp_path)).count() == 3
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("multi_line", [False, True])
def test_every_file_follows_its_own_header(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("name,city\nann,oslo\n")
    (tmp_path / "b.csv").write_text("city,name\nrome,bob\nx,y,z\n")
    (tmp_path / "c.csv").write_text("name,age,city\ncid,3,bern\n")
    checked, columns = S.repair_files(spark, str(tmp_path), multi_line=multi_line)
    assert columns == ["name", "city", "age"]
    assert rows(S.valid_rows(checked, columns)) == [("ann", "oslo", None), ("bob", "rome", None), ("cid", "bern", "3")]
    bad = S.bad_rows(checked).collect()
    assert [(r["row_number"], r["content"], r["description"]) for r in bad] == [(3, "x,y,z", S.WRONG_COUNT.format(3, 2))]


def test_block_size_setting_is_released(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,2\n")
    S.repair_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "good"), str(tmp_path / "bad"))
    B.read_records(spark, str(tmp_path / "in.csv")).count()
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_block_table_of_100_terabytes_is_broadcast(spark):
    """800 000 blocks: the lines are not shuffled."""
    lines = spark.range(10).select(F.lit("f0").alias("file"), (F.col("id") * (1 << 27)).alias("block"), F.lit(0).cast("long").alias("seq"), F.lit("x").alias("value"))
    blocks = spark.range(800_000).select(
        F.concat(F.lit("f"), F.col("id") % 1000).alias("file"), (F.col("id") * (1 << 27)).alias("block"),
        F.lit(0).cast("long").alias("first_seq"), F.lit(0).cast("long").alias("last_seq"), F.lit(0).cast("long").alias("offset"),
    )
    joined, small = B._with_blocks(lines, blocks, "offset")
    assert small and "Exchange hashpartitioning" not in plan_of(joined)
