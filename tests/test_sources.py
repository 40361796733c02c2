import pytest
from pyspark.sql import functions as F

from conftest import rows
from rowscrub.sources import inspect as I
from rowscrub.sources import published, readers, sinks


def test_plain_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v,d,b\n1,"z ""k"", x",1.5,true\n2,y,2e3,false\n')
    df = readers.scan_plain(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "bigint"), ("v", "string"), ("d", "double"), ("b", "boolean")]
    assert rows(df) == [(1, 'z "k", x', 1.5, True), (2, "y", 2000.0, False)]
    assert set(dict(readers.scan_plain(spark, str(tmp_path / "a.csv"), infer=False).dtypes).values()) == {"string"}


def test_raw_scan(spark, tmp_path):
    body = '"id"; name;"x"\n1;"a";NULL\n2;b\n3;c;d;e\n4; NULL;\t\nx;None;q\n'
    (tmp_path / "a.csv").write_text(body)
    df = readers.scan_raw(spark, str(tmp_path / "a.csv"), ";", infer_rows=4)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "string")]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(
        [(1, "a", None), (2, "b", None), (3, "c", "d"), (4, " NULL", None), (None, None, "q")], key=repr
    )
    kept = readers.scan_raw(spark, str(tmp_path / "a.csv"), ";", strip_quotes=False)
    assert {r["name"] for r in kept.collect()} >= {'"a"'}


def test_header_cleaning(spark, tmp_path):
    assert readers.clean_header(['"a" ', "a", " b"]) == ["a", "a_2", "b"]
    (tmp_path / "a.csv").write_bytes("é,b\nx\xff,1\n".encode("latin-1"))
    df = readers.scan_raw(spark, str(tmp_path / "a.csv"))
    assert df.first()[0] == "x�"


def test_inference_limits(spark):
    df = spark.createDataFrame([("1", "1", "", None), ("2", "1.5", "x", None), ("y", "z", "x", "q")], "a string, b string, c string, d string")
    kinds = readers.inferred_types(df.limit(2))
    assert kinds == {"a": "bigint", "b": "double", "c": "string", "d": "string"}


def test_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary")
    row = df.select(readers.repair_utf8(F.col("b")).alias("x"), readers.drop_bad_utf8(F.col("b")).alias("y")).first()
    assert tuple(row) == ("a�b", "ab")


def test_extensions(spark, tmp_path):
    for name in ("a.csv", "b.TXT", "c.parquet", "d"):
        (tmp_path / name).write_text(name)
    assert rows(readers.read_text_files(spark, str(tmp_path))) == [("a.csv",), ("b.TXT",)]
    names = spark.createDataFrame([("x/a.CSV",), ("csv",), ("a.csv.gz",)], "n string")
    assert rows(names.where(readers.supported_file(F.col("n")))) == [("x/a.CSV",)]


def test_ingest_reuse(spark, tmp_path):
    source, out = tmp_path / "in.csv", str(tmp_path / "out")
    source.write_text("id,v\n1,a\n")
    df, reused = readers.ingest(spark, str(source), out)
    assert not reused and rows(df) == [(1, "a")]
    assert readers.ingest(spark, str(source), out)[1]
    assert not readers.ingest(spark, str(source), out, overwrite=True)[1]
    source.write_text("id,v\n1,a\n2,b\n")
    df, reused = readers.ingest(spark, str(source), out)
    assert not reused and df.count() == 2


def test_spread_only_small_inputs(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(6).write.parquet(str(tmp_path / "six"))
    one, six = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "six"))
    assert readers.spread(one, None) is one and readers.spread(one, 1) is one and readers.spread(six, 6) is six
    sizes = readers.spread(one, 4).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 400
    assert "Exchange" in df_plan(readers.spread(six, 7))


def test_spread_keeps_shares_small(spark, tmp_path, monkeypatch):
    spark.range(0, 50_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    monkeypatch.setattr(readers, "SHARE_BYTES", 200_000, raising=False)
    counts = [r["count"] for r in readers.spread(one, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 10 and max(counts) < 50_000 / 10 and sum(counts) == 50_000


def test_quoted_newlines_in_plain_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,t,t,T\n1,"x\ny",,""\n\n2,"p""q\r\n",w\n3,a,b,c,d\n')
    df = readers.scan_plain(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "t", "t_2", "T_3"]
    assert rows(df) == [(1, "x\ny", None, None), (2, 'p"q\r\n', "w", None), (3, "a", "b", "c")]
    with pytest.raises(Exception, match="quote not closed"):
        readers.scan_plain(spark, str(tmp_path / "a.csv"), infer=False, multi_line=False).collect()
    (tmp_path / "b.csv").write_text('id,v\n1,"a, b"\n2,c\n')
    assert rows(readers.scan_plain(spark, str(tmp_path / "b.csv"), multi_line=False)) == [(1, "a, b"), (2, "c")]


def test_types_come_from_all_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{i},{i}\n" for i in range(1500)) + "1500,abc\n")
    path = str(tmp_path / "a.csv")
    assert readers.scan_plain(spark, path).dtypes == [("id", "bigint"), ("v", "string")]
    assert readers.scan_raw(spark, path).where("v = 'abc'").count() == 1
    assert readers.scan_plain(spark, path, infer_rows=1000).dtypes[1] == ("v", "bigint")
    assert rows(readers.misfits(readers.scan_plain(spark, path, infer=False), 1000)) == [("id", 0), ("v", 1)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_every_file_follows_its_header(spark, tmp_path, multi_line):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_text("y,x,z\n20,10,30\n\n21,11\n")
    (folder / "c.csv").write_text("\"x\"\n100\n")
    df = readers.scan_plain(spark, str(folder), multi_line=multi_line)
    assert df.columns == ["x", "y", "z"]
    assert sorted(map(tuple, df.collect())) == [(1, 2, None), (10, 20, 30), (11, 21, None), (100, None, None)]
    raw = readers.scan_raw(spark, str(folder))
    assert raw.dtypes == [("x", "bigint"), ("y", "bigint"), ("z", "bigint")]
    assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("multi_line", [True, False])
def test_rows_like_the_header_stay(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("x,y\nx,y\n1,2\nx,y\n")
    df = readers.scan_plain(spark, str(tmp_path / "a.csv"), multi_line=multi_line)
    assert sorted(map(tuple, df.collect())) == [("1", "2"), ("x", "y"), ("x", "y")]


@pytest.mark.parametrize("multi_line", [True, False])
def test_numbers_beyond_bigint_keep_their_digits(spark, tmp_path, multi_line):
    big = ["99999999999999999999", "9223372036854775808", "-9223372036854775809"]
    (tmp_path / "a.csv").write_text("a,b,c,d\n" + "".join(f"{v},9223372036854775807,1.5,\n{v},,{v},\n" for v in big))
    df = readers.scan_plain(spark, str(tmp_path / "a.csv"), multi_line=multi_line)
    assert df.dtypes == [("a", "string"), ("b", "bigint"), ("c", "double"), ("d", "string")]
    assert sorted({r["a"] for r in df.collect()}) == sorted(big)
    assert {r["b"] for r in df.collect()} == {None, 2**63 - 1}
    assert readers.scan_raw(spark, str(tmp_path / "a.csv")).dtypes[0] == ("a", "string")


def test_no_python_where_no_quote_goes_on(spark, tmp_path):
    for name, body in {"plain": 'id,v\n1,"a, b"\n2,c\n', "newline": 'id,v\n1,"a\nb"\n2,c\n'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(body)
    plans = {name: df_plan(readers.scan_plain(spark, str(tmp_path / name))) for name in ("plain", "newline")}
    assert "MapInPandas" not in plans["plain"]
    assert plans["newline"].count("MapInPandas") == 1
    assert rows(readers.scan_plain(spark, str(tmp_path / "plain"))) == [(1, "a, b"), (2, "c")]


def test_header_over_several_lines_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"v\nw"\n1,"a\nb"\n\n2,c\n')
    df = readers.scan_plain(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "v\nw"]
    assert rows(df) == [(1, "a\nb"), (2, "c")]


def test_ingest_depends_on_its_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    source, out = str(tmp_path / "a.csv"), str(tmp_path / "out")
    assert readers.ingest(spark, source, out, ",")[0].columns == ["a;b"]
    df, reused = readers.ingest(spark, source, out, ";")
    assert not reused and df.columns == ["a", "b"]
    assert readers.ingest(spark, source, out, ";")[1]
    assert not readers.ingest(spark, source, out, ";", infer=False)[1]


def test_heads_and_hashes_of_odd_files(spark, tmp_path):
    import hashlib

    contents = {"empty": b"", "long": b"a;b" * 3_000_000, "lines": b"x|y\r\n\nz\rw\n", "bad": b"\xff\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    heads = I.file_heads(spark, str(tmp_path)).collect()
    got = {r["file"].rsplit("/", 1)[1]: r for r in heads}
    assert set(got) == set(contents) and got["empty"]["lines"] == [] and len(got["long"]["lines"][0]) == I.LINE_BYTES
    assert [bytes(x) for x in got["lines"]["lines"]] == [b"x|y", b"", b"z", b"w"]
    frame = I.file_heads(spark, str(tmp_path))
    lines = I.head_lines(frame)

    def by_name(df, value):
        return {r["file"].rsplit("/", 1)[1]: r[value] for r in df.collect()}

    assert by_name(I.encoding_profile(frame), "encoding") == {"empty": "utf8", "long": "utf8", "lines": "utf8", "bad": "utf8-lossy"}
    assert by_name(I.delimiter_profile(lines), "delimiter") == {"empty": ",", "long": ";", "lines": "|", "bad": ","}
    assert by_name(I.has_quotes(lines), "has_quotes") == dict.fromkeys(contents, False)
    hashes = {r["path"].rsplit("/", 1)[1]: r["content_hash"] for r in I.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes == {name: hashlib.sha256(data).hexdigest() for name, data in contents.items()}


def df_plan(df):
    from conftest import plan_of

    return plan_of(df)


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "comma.csv").write_text("a,b;c\n")
    (folder / "semi.csv").write_text("a;b;c\n1;2;3\n")
    (folder / "none.csv").write_text("abc")
    (folder / "quoted.csv").write_text("x\r\n" * 20 + 'it"s\n')
    (folder / "late.csv").write_text("x\n" * 21 + 'it"s\n' + "a|b\n" * 8 + "c\td\n" * 90)
    (folder / "bad.csv").write_bytes(b"a\xe4,b\n")
    (folder / "cut.csv").write_bytes(b"x" * 9999 + "é".encode() + b"\n")
    (folder / "empty.csv").write_bytes(b"")
    return str(folder)


def by_name(df, value):
    return {r["file"].rsplit("/", 1)[1].removesuffix(".csv"): r[value] for r in df.collect()}


def test_file_profiles(spark, files):
    heads = I.file_heads(spark, files).cache()
    encodings = by_name(I.encoding_profile(heads), "encoding")
    assert encodings.pop("bad") == "utf8-lossy" and set(encodings.values()) == {"utf8"} and len(encodings) == 7
    lines = I.head_lines(heads)
    delimiters = by_name(I.delimiter_profile(lines), "delimiter")
    assert delimiters == {"comma": ",", "semi": ";", "none": ",", "quoted": ",", "late": "|", "bad": ",", "cut": ",", "empty": ","}
    quotes = by_name(I.has_quotes(lines), "has_quotes")
    assert quotes["quoted"] and not quotes["late"] and not quotes["semi"] and not quotes["empty"]


def test_heads_do_not_read_whole_files(spark, tmp_path):
    with open(tmp_path / "huge.csv", "wb") as f:
        f.write(b"a,b\n" * 50)
        f.truncate(20 << 30)
    heads = I.file_heads(spark, str(tmp_path / "huge.csv"))
    assert rows(heads.select(F.length("head"), F.size("lines"))) == [(10_000, 30)]


def test_file_hash_and_quote_removal(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("a'b\"\n\n'c\n")
    assert I.file_hashes(spark, str(tmp_path / "a.txt")).first()["content_hash"] == hashlib.sha256(b"a'b\"\n\n'c\n").hexdigest()
    I.strip_quotes_files(spark, str(tmp_path / "a.txt"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["ab", "", "c"]


def test_parquet_codecs_and_split(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(25).withColumn("v", F.lit("x")).coalesce(1)
    for codec, name in [("zstd", "ZSTD"), ("snappy", "SNAPPY"), ("gzip", "GZIP"), ("none", "UNCOMPRESSED")]:
        out = tmp_path / codec
        sinks.write_parquet(df, str(out), codec, rows_per_file=10)
        parts = list(out.glob("*.parquet"))
        assert len(parts) == 3
        assert pq.ParquetFile(parts[0]).metadata.row_group(0).column(0).compression == name
        assert spark.read.parquet(str(out)).count() == 25


def test_row_estimate(spark, tmp_path):
    assert sinks.rows_for_size(10_000, 1 << 20, 100) == 1_000_000
    assert sinks.rows_for_size(100, 1 << 30, 1) == 10_000
    assert sinks.rows_for_size(1, 0, 1, 4_000_000) == 1_000_000
    assert sinks.rows_for_size(1, 0, 1, 4) == 100_000
    df = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows_used = sinks.write_split(df, str(tmp_path / "o"), target_mb=1)
    assert 15_000 < rows_used < 40_000 and spark.read.parquet(str(tmp_path / "o")).count() == 20_000
    assert sinks.estimate_rows_per_file(df.where("false"), 1) == 100_000


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("*.csv")))


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a~b", None, ' q"', True)], "x string, y string, z string, t boolean").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "plain"))
    assert text_of(tmp_path / "plain") == 'x~y~z~t\n"a~b"~~" q"""~true\n'
    lines = spark.createDataFrame([("a\r\nb\nc", None, "", True)], "x string, y string, z string, t boolean").coalesce(1)
    sinks.write_csv_flat(lines, str(tmp_path / "flat"))
    assert text_of(tmp_path / "flat") == '"x"|"y"|"z"|"t"\n"a b c"|""|""|"True"\n'
    sinks.write_csv_flat(lines, str(tmp_path / "minimal"), ";", quote_all=False)
    assert text_of(tmp_path / "minimal") == "x;y;z;t\na b c;;;True\n"
    sinks.write_repaired_csv(lines.select("x"), str(tmp_path / "repaired"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "repaired").glob("part-*"))
    assert written == b'"x"\r\n"a\r\nb\nc"\r\n'
    sinks.write_repaired_csv(lines.where("false").select("x", "y"), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "none").glob("part-*")) == b'"x"~"y"\r\n'


def test_delimiter_by_consistency(spark):
    texts = {
        "semicolons": "name;note;n\n" + "\n".join(f"x{i};" + "a, b, c, " * (i % 4) + ";1" for i in range(20)),
        "quoted": '"a;b;c",1\n"d;e;f",2\n"g,h",3',
        "open": 'a|"b,c,d\ne|f',
        "tie": "a,b;c;d\ne,f;g;h",
        "frequent": '"a;b,c;d"',
        "none": "abc\n\n",
        "empty": "",
        "late": "\n" * 40 + "a|b",
    }
    lines = I.text_lines(spark.createDataFrame(list(texts.items()), "file string, text string"), "file", "text", 30)
    found = {r["file"]: r["delimiter"] for r in I.consistent_delimiter(lines).collect()}
    assert found == {"semicolons": ";", "quoted": ",", "open": "|", "tie": ";", "frequent": ";", "none": ",", "empty": ",", "late": ","}
    odd = spark.createDataFrame([("x", 1, None)], "file string, line_no int, line string")
    assert rows(I.consistent_delimiter(odd)) == [("x", ",")] and I.consistent_delimiter(odd.limit(0)).count() == 0


def test_failed_version_leaves_the_table(spark, tmp_path):
    source, out = tmp_path / "in.csv", str(tmp_path / "out")
    source.write_text("id,v\n1,a\n")
    first, _ = readers.ingest(spark, str(source), out)
    with pytest.raises(Exception, match="stop here"):
        published.publish(first.select(F.raise_error(F.lit("stop here")).alias("id")), out)
    assert rows(published.read_published(spark, out)) == [(1, "a")] and readers.ingest(spark, str(source), out)[1]
    second = published.publish(first.unionByName(first), out)
    assert first.count() == 1 and second.count() == 2  # readers of the version before go on
    third = published.publish(second, out, "s")
    assert third.count() == 2 and published.pointer(spark, out)["state"] == "s"
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("version")]) == published.KEPT
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, str(tmp_path / "none"))
