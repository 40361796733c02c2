"""Separating well-formed from malformed delimited records.

Works on lines or records: ``value`` plus whatever columns the caller wants to keep.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowscrub.functions.fields import open_quote, split_fields
from rowscrub.operators.columns import computed_once, ref, unique_names
from rowscrub.operators.layouts import file_layouts, with_layout
from rowscrub.operators.records import RECORD_LIMIT, number_data, pinned_blocks, scan_lines, split_records
from rowscrub.session import discard, scratch_path
from rowscrub.sources.sinks import write_csv, write_repaired_csv

STRUCTURE, PROCESSING = "structure", "processing"

# --- fixed values: wording of the bad-row descriptions ------------------------------------
WRONG_COUNT = "Неверное количество столбцов: {} вместо {}"
FAILED = "Ошибка обработки: {}"
MESSAGE_CHARS = 100
# --- end of fixed values ------------------------------------------------------------------
OPEN_QUOTE = "quote not closed on its line"
TOO_LONG = "record of more than {} characters: quote not closed?"


def check_records(
    lines: DataFrame,
    header: Sequence[str],
    delimiter: str = ",",
    types: Mapping[str, str] | None = None,
    whole: bool = False,
    layouts: Sequence[Sequence[str]] | None = None,
    limit: int = RECORD_LIMIT,
) -> DataFrame:
    """Add ``fields``, ``error_type``, ``description`` and ``content`` to lines.

    A record is bad (``structure``) if it has another number of fields than the header or
    leaves a quote open, and bad (``processing``) if a value does not fit the type the
    caller asks for in ``types``. ``error_type`` is null on valid records; ``content`` is
    the fields of a bad record joined again, without their quotes. ``whole`` says that
    ``value`` holds whole records, so that an open quote is just one at the end of a file; with
    their length in ``chars``, those of more than ``limit`` characters are bad.

    With ``layouts``, column ``layout`` says which of these headers a record follows; its fields
    are brought into the order of ``header``, and a name that the layout lacks is null.
    """
    kept = [ref(c) for c in lines.columns if c not in ("layout", "chars")]
    value = F.col("value")
    parsed = lines.withColumn("fields", split_fields(value, delimiter))
    width, fields = F.lit(len(header)), F.col("fields")
    if layouts:
        layout = F.col("layout") + 1
        width = F.element_at(F.array(*[F.lit(len(names)) for names in layouts]), layout)
        places = [F.array(*[F.lit(list(names).index(n) if n in names else -1) for n in header]) for names in layouts]
        source = F.element_at(F.array(*places), layout)
        fields = F.transform(source, lambda i: F.when(i >= 0, F.get("fields", i)))
    parsed = parsed.select(*lines.columns, "fields", width.alias("width"), fields.alias("aligned"))
    misfit = F.lit(None).cast("string")
    for name, kind in (types or {}).items():
        cell = F.get(F.col("aligned"), list(header).index(name))
        wrong = cell.isNotNull() & (cell != "") & cell.try_cast(kind).isNull()
        misfit = F.coalesce(misfit, F.when(wrong, F.lit(f"{name} is not {kind}")))
    count = F.size("fields")
    too_long = F.col("chars") > limit if "chars" in lines.columns else F.lit(False)
    wrong_count = count != F.col("width")
    unclosed = F.lit(False) if whole else open_quote(value, delimiter)
    before, between = WRONG_COUNT.split("{}")[:2]
    counted = F.concat(F.lit(before), count.cast("string"), F.lit(between), F.col("width").cast("string"))
    checked = parsed.select(
        *kept,
        F.when(wrong_count, F.col("fields")).otherwise(F.col("aligned")).alias("fields"),
        F.when(too_long | wrong_count | unclosed, F.lit(STRUCTURE)).when(misfit.isNotNull(), F.lit(PROCESSING)).alias("error_type"),
        F.when(too_long, F.lit(TOO_LONG.format(limit)))
        .when(wrong_count, counted)
        .when(unclosed, F.lit(OPEN_QUOTE))
        .when(misfit.isNotNull(), F.concat(F.lit(FAILED.format("")), F.left(misfit, F.lit(MESSAGE_CHARS))))
        .alias("description"),
        F.array_join("fields", delimiter).alias("joined"),
    )
    bad = F.col("error_type").isNotNull()
    checked = checked.select(*kept, "fields", "error_type", "description", F.when(bad, F.col("joined")).alias("content"))
    return computed_once(checked)


def valid_rows(checked: DataFrame, header: Sequence[str]) -> DataFrame:
    """The valid records as text columns."""
    good = checked.where(F.col("error_type").isNull())
    return good.select(*[F.get("fields", i).alias(name) for i, name in enumerate(header)])


def bad_rows(checked: DataFrame, keep: Sequence[str] = ("row_number",)) -> DataFrame:
    """The bad records: what was wrong with them and what they held."""
    bad = checked.where(F.col("error_type").isNotNull())
    return bad.select(*keep, "error_type", "description", "content")


def repair_counts(checked: DataFrame) -> DataFrame:
    """``error_type, records``; valid records are counted as ``valid``."""
    kind = F.coalesce("error_type", F.lit("valid")).alias("error_type")
    return checked.groupBy(kind).agg(F.count(F.lit(1)).alias("records"))


def repair_files(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    types: Mapping[str, str] | None = None,
    multi_line: bool = False,
    limit: int = RECORD_LIMIT,
) -> tuple[DataFrame, list[str]]:
    """Checked records of text files that each start with their header, and the columns.

    Data records are numbered from 2 in every file, and each file's own header says how many fields
    they have and what these are. The columns are those of the first file by name, then what others add. A
    record is one line, and a line that leaves a quote open is bad; with ``multi_line`` quoted fields may hold
    newlines, and a record of more than ``limit`` characters is bad. An empty input gives an empty table and no columns.
    """
    if multi_line:
        first, data = split_records(spark, path, delimiter, limit)
        heads = first.select("file", F.col("value").alias("header"))
    else:
        data, heads = number_data(scan_lines(spark, path))

    def names_of(headers: list[str]) -> list[list[str]]:
        rows = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, value string")
        return [unique_names(r["fields"]) for r in rows.select("i", split_fields(F.col("value"), delimiter).alias("fields")).orderBy("i").collect()]

    layouts = file_layouts(heads, names_of, path)
    columns = layouts.columns
    if layouts.files is not None:
        data = with_layout(data, layouts)
    return check_records(data, columns, delimiter, types, multi_line, layouts.headers if layouts.files is not None else None, limit), columns


def repair_csv(
    spark: SparkSession,
    path: str,
    valid_out: str,
    bad_out: str,
    delimiter: str = ",",
    export_delimiter: str = "~",
    types: Mapping[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Write valid records and bad records apart; returns the counts.

    The input is split and checked once, into a staging table partitioned by outcome, of which both
    outputs read their own part. The counts are taken by the job that writes this table.
    """
    with pinned_blocks(spark):
        return _repair(spark, path, valid_out, bad_out, delimiter, export_delimiter, types, multi_line)


def _repair(spark, path, valid_out, bad_out, delimiter, export_delimiter, types, multi_line) -> DataFrame:
    checked, header = repair_files(spark, path, delimiter, types, multi_line)
    part = F.coalesce("error_type", F.lit("valid")).alias("part")
    checked = checked.select("row_number", "fields", "error_type", "description", "content", part)
    staged = scratch_path(spark, "checked")
    counted = Observation()
    kinds = ("valid", STRUCTURE, PROCESSING)
    checked.observe(counted, *[F.count_if(F.col("part") == kind).alias(kind) for kind in kinds]).write.partitionBy("part").parquet(staged)
    table = spark.read.schema(checked.schema).parquet(staged)
    write_repaired_csv(valid_rows(table.where("part = 'valid'"), header), valid_out, export_delimiter)
    write_csv(bad_rows(table.where("part <> 'valid'")), bad_out, export_delimiter, quote_all=True)
    discard(spark, staged)
    records = [(kind, counted.get[kind]) for kind in kinds if counted.get[kind]]
    return spark.createDataFrame(records, "error_type string, records long")
