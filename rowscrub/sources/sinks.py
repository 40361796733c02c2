"""Writing Parquet and delimited text."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from rowscrub.functions import text as X
from rowscrub.operators.columns import map_columns, ref, string_columns
from rowscrub.session import discard, scratch_path

CODECS = {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "none": "uncompressed"}
ZSTD_LEVEL = "3"
SAMPLE_ROWS = 10_000
MIN_ROWS = 10_000
FALLBACK_ROWS = 100_000


def write_parquet(
    df: DataFrame, path: str, codec: str = "zstd", rows_per_file: int | None = None, mode: str = "errorifexists"
) -> None:
    """Parquet, by default zstd level 3; ``rows_per_file`` bounds the rows of each file."""
    writer = parquet_writer(df, codec).mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def parquet_writer(df: DataFrame, codec: str) -> DataFrameWriter:
    """A writer set to a codec and its level."""
    writer = df.write.option("compression", CODECS[codec])
    return writer.option("parquet.compression.codec.zstd.level", ZSTD_LEVEL) if codec == "zstd" else writer


def rows_for_size(sample_rows: int, sample_bytes: int, target_mb: int, total_rows: int | None = None, min_rows: int = MIN_ROWS) -> int:
    """Rows that fill ``target_mb`` at the bytes per row of a written sample, but at least ``min_rows``.

    Without a sample it is a quarter of the table, if its rows are known, and at least 100 000.
    """
    if sample_bytes <= 0:
        return max((total_rows or 0) // 4, FALLBACK_ROWS)
    target_bytes = target_mb << 20
    return max(target_bytes * sample_rows // sample_bytes, min_rows)


def estimate_rows_per_file(df: DataFrame, target_mb: int, min_rows: int = MIN_ROWS) -> int:
    """Write the first rows as a sample and scale up.

    The sample of at most 10 000 rows is written by one task and never reaches the driver.
    If it cannot be written, the number of rows decides.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "size-sample")
    try:
        write_parquet(df.limit(SAMPLE_ROWS).coalesce(1), path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length"))
        return rows_for_size(rows, int(size.first()[0] or 0) if rows else 0, target_mb, None, min_rows)
    except PySparkException:
        return rows_for_size(0, 0, target_mb, df.count())
    finally:
        discard(spark, path)


def write_split(
    df: DataFrame, path: str, target_mb: int = 100, codec: str = "zstd", mode: str = "errorifexists", min_rows: int = MIN_ROWS
) -> int:
    """Parquet files of about ``target_mb`` each; returns the row bound that was used.

    ``min_rows`` bounds the number of small files; lower it for very long rows.
    """
    rows = estimate_rows_per_file(df, target_mb, min_rows)
    write_parquet(df, path, codec, rows_per_file=rows, mode=mode)
    return rows


def write_csv(df: DataFrame, path: str, delimiter: str = "~", quote_all: bool = False, mode: str = "errorifexists") -> None:
    """Delimited text with header; quotes only where needed unless ``quote_all``."""
    _csv(df, delimiter, quote_all, mode).csv(path)


def write_csv_flat(
    df: DataFrame, path: str, delimiter: str = "|", quote_all: bool = True, mode: str = "errorifexists"
) -> None:
    """Delimited text, one physical line per row: newlines inside texts become spaces."""
    flat = map_columns(df, string_columns(df), X.flatten_newlines)
    truths = [name for name, kind in df.dtypes if kind == "boolean"]
    flat = map_columns(flat, truths, lambda c: F.initcap(c.cast("string")))
    _csv(flat, delimiter, quote_all, mode).option("emptyValue", '""' if quote_all else "").csv(path)


def write_repaired_csv(df: DataFrame, path: str, delimiter: str = "~", mode: str = "errorifexists") -> None:
    """Repaired rows: everything quoted, CR LF line ends, each file with the header, newlines
    inside quotes unchanged.

    The lines are built as text, because the CSV writer would turn newlines inside values
    into its own line end. A file is what one task writes, so the header goes before the
    first row of each task. A table without rows gives one file with the header alone.
    """

    def quoted(c: Column) -> Column:
        text = F.coalesce(X.as_text(c), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    header = F.concat_ws(delimiter, *[quoted(F.lit(c)) for c in df.columns])
    line = F.concat_ws(delimiter, *[quoted(ref(c)) for c in df.columns])
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = df.select(line.alias("line"), (row_in_task == 0).alias("first"))
    texts = F.when(F.col("first"), F.array(header, "line")).otherwise(F.array("line"))
    texts = lines.select(F.explode(texts).alias("value"))
    if df.isEmpty():
        texts = df.sparkSession.range(1).select(header.alias("value"))
    texts.write.mode(mode).option("lineSep", "\r\n").text(path)


def _csv(df: DataFrame, delimiter: str, quote_all: bool, mode: str):
    flat = df.select(*[ref(c) for c in df.columns])
    return (
        flat.write.mode(mode)
        .option("header", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("quoteAll", quote_all)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
