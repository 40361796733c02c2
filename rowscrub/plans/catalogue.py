"""Every operator as a query over the standard tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscrub.functions import names as N
from rowscrub.functions import patterns as P
from rowscrub.functions import text as X
from rowscrub.operators import columns as C
from rowscrub.operators import profile as A
from rowscrub.operators import records as B
from rowscrub.operators import repair as S
from rowscrub.operators import rows as R
from rowscrub.plans import workflow as W
from rowscrub.plans.settings import Workflow
from rowscrub.session import scratch_path
from rowscrub.sources import inspect as I
from rowscrub.sources import published, readers, sinks, sized
from rowscrub.streaming import files as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEPT = ["latin_basic", "latin_extended", "digits", "space", "newline", "period"]
LATIN, CYRILLIC = "abvgdeziyklmnoprstufhcABVGDEZIYKLMNOPRSTUFHC", "абвгдезийклмнопрстуфхцАБВГДЕЗИЙКЛМНОПРСТУФХЦ"


SPREAD = ("documents", "pages", "lineitem")  # tables with work enough per row to share out


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, split over the cores if it is too small to have row groups for all of them."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    df = readers.read_parquet(spark, path)
    return readers.spread(df, spark.sparkContext.defaultParallelism) if name in SPREAD else df


def dirty_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, v``: the documents with seven kinds of dirt, one per remainder of the id."""
    return table(spark, folder, "documents").select("doc_id", dirt(F.col("doc_id"), F.col("text")).alias("v"))


def dirt(key: Column, text: Column) -> Column:
    hard_space, zero_width = chr(0xA0), chr(0x200B)
    kinds = [
        F.concat(F.lit('  "'), text, F.lit('"  ')),
        F.replace(text, F.lit(" "), F.lit(hard_space)),
        F.concat(text, F.lit("&nbsp;\\n")),
        F.lit("NULL"),
        F.lit("0"),
        F.lit(None).cast("string"),
        F.replace(text, F.lit(" "), F.lit("\t\r\n")),
    ]
    value = F.replace(text, F.lit("e"), F.lit(zero_width + "e"))
    for i, kind in reversed(list(enumerate(kinds))):
        value = F.when(key % 8 == i, kind).otherwise(value)
    return value


def map_v(spark: SparkSession, folder: str, fn: Callable[[Column], Column]) -> DataFrame:
    return C.map_columns(dirty_docs(spark, folder), ["v"], fn)


def json_of(name: str) -> Column:
    return F.to_json(name, {"ignoreNullFields": "false"}).alias(name)


# --- ingest ---------------------------------------------------------------------------------


@query
def csv_scan_plain(spark, folder):
    path = scratch_path(spark, "csv-plain")
    sinks.write_csv(table(spark, folder, "documents"), path, ",")
    return readers.scan_plain(spark, path)


@query
def csv_scan_late_types(spark, folder):
    """The first code that is no number comes behind thousands of rows."""
    path = scratch_path(spark, "csv-late")
    code = F.when(F.col("l_orderkey") >= 900, F.concat(F.lit("k"), "l_orderkey")).otherwise(F.col("l_orderkey").cast("string"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
    sinks.write_csv(lines.orderBy("l_orderkey", "l_linenumber"), path, ",")
    return readers.scan_plain(spark, path)


def both_ways(spark, path: str) -> DataFrame:
    """A plain scan that looks for quoted newlines and one that does not, above one another."""
    scans = [readers.scan_plain(spark, path, multi_line=m).withColumn("multi_line", F.lit(m)) for m in (True, False)]
    return scans[0].unionByName(scans[1])


@query
def csv_scan_mixed_headers(spark, folder):
    """Files of one folder with their columns in different orders, and one column in some files only."""
    path = scratch_path(spark, "csv-mixed")
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    for i, fields in enumerate((["event_id", "user_id", "event_type"], ["value", "event_type", "event_id", "user_id"], ["user_id", "event_id"])):
        sinks.write_csv(events.where(F.col("event_id") % 3 == i).select(*fields), f"{path}/part{i}", ",")
    plain = both_ways(spark, f"{path}/part*")
    raw = readers.scan_raw(spark, f"{path}/part*").withColumn("multi_line", F.lit(None).cast("boolean"))
    return plain.unionByName(raw)


@query
def csv_scan_wide_numbers(spark, folder):
    """Whole numbers of 20 digits stay text, the widest that a bigint holds are numbers."""
    path = scratch_path(spark, "csv-wide")
    key = F.col("o_orderkey")
    wide = F.concat(F.when(key % 100 == 7, F.lit("99999999999999")).otherwise(F.lit("1")), F.lpad(key.cast("string"), 6, "0")).alias("code")
    fits = F.when(key % 2 == 0, F.lit(2**63 - 1)).otherwise(key).alias("fits")
    sinks.write_csv(table(spark, folder, "orders").select("o_orderkey", wide, fits), path, ",")
    return both_ways(spark, path)


@query
def csv_scan_header_row(spark, folder):
    """Rows that look like the header are rows."""
    path = scratch_path(spark, "csv-header")
    cells = [F.when(F.col("c_custkey") % 10 == 3, F.lit(name)).otherwise(F.col(name).cast("string")).alias(name) for name in ("c_custkey", "c_name")]
    sinks.write_csv(table(spark, folder, "customer").select(*cells), path, ",")
    return both_ways(spark, path)


@query
def csv_scan_raw(spark, folder):
    path = scratch_path(spark, "csv-raw")
    kind = F.when(F.col("event_id") % 7 == 0, F.lit("None")).otherwise(F.col("event_type"))
    props = F.when(F.col("event_id") % 11 == 0, F.lit(" NULL")).otherwise(F.col("props"))
    cells = [F.col("event_id").cast("string"), F.col("user_id").cast("string"), kind, props]
    # Extra fields on some rows, missing ones on others.
    line = F.when(F.col("event_id") % 5 == 0, F.concat_ws(";", *cells, F.lit("x"))).otherwise(
        F.when(F.col("event_id") % 5 == 1, F.concat_ws(";", *cells[:3])).otherwise(F.concat_ws(";", *cells))
    )
    lines = table(spark, folder, "events").select(line.alias('"event_id";user_id ;event_type;"props"'))
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return readers.scan_raw(spark, path, ";")


@query
def null_tokens(spark, folder):
    text = F.col("text")
    tokens = [*X.NULL_TOKENS, " NULL", None]
    value = text
    for i, token in enumerate(tokens):
        value = F.when(F.col("doc_id") % 12 == i, F.lit(token)).otherwise(value)
    docs = table(spark, folder, "documents").select("doc_id", value.alias("v"))
    return C.map_columns(docs, ["v"], X.null_tokens)


@query
def header_clean(spark, folder):
    nation = table(spark, folder, "nation").toDF('"nation" key', " name", '"region"')
    return nation.toDF(*readers.clean_header(nation.columns))


@query
def strip_dquotes(spark, folder):
    return map_v(spark, folder, X.strip_double_quotes)


@query
def utf8_repair(spark, folder):
    broken = F.concat(F.lit(b"\xff"), F.col("text").cast("binary"), F.lit(b"\xe4\xb8"))
    docs = table(spark, folder, "documents").select("doc_id", broken.alias("b"))
    return docs.select(
        "doc_id", readers.repair_utf8(F.col("b")).alias("replaced"), readers.drop_bad_utf8(F.col("b")).alias("dropped")
    )


@query
def parquet_scan(spark, folder):
    return table(spark, folder, "conversations")


@query
def ingest_reuse(spark, folder):
    source, out = scratch_path(spark, "ingest-csv"), scratch_path(spark, "ingest-parquet")
    sinks.write_csv(table(spark, folder, "part"), source, ",")
    readers.ingest(spark, source, out)
    again, reused = readers.ingest(spark, source, out)
    return again.withColumn("reused", F.lit(reused))


@query
def ingest_failed(spark, folder):
    """A version that fails midway leaves the published one, which is also read while the next is published."""
    out = scratch_path(spark, "versions")
    parts = table(spark, folder, "part")
    before = published.publish(parts, out)
    try:
        published.publish(before.withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.raise_error(F.lit("stop"))).otherwise(F.col("p_name"))), out)
    except PySparkException:
        failed = published.read_published(spark, out)
        published.publish(before.where("p_partkey % 2 = 0"), out)
        return failed.withColumn("part", F.lit("old")).unionByName(published.read_published(spark, out).withColumn("part", F.lit("new")))
    raise AssertionError("the version was written")


@query
def ingest_reuse_options(spark, folder):
    """The same files read with another delimiter are another table."""
    source, out = scratch_path(spark, "ingest-csv"), scratch_path(spark, "ingest-parquet")
    sinks.write_csv(table(spark, folder, "part"), source, ";")
    readers.ingest(spark, source, out, ",")
    again, reused = readers.ingest(spark, source, out, ";")
    return again.withColumn("reused", F.lit(reused))


@query
def encoding_profile(spark, folder):
    bad = F.when(F.col("doc_id") % 5 == 0, F.lit(b"\xe4")).otherwise(F.lit(b""))
    head = F.substring(F.concat(bad, F.col("text").cast("binary")), 1, I.ENCODING_BYTES)
    return I.encoding_profile(table(spark, folder, "documents").select(F.col("doc_id").alias("file"), head.alias("head")))


@query
def delimiter_profile(spark, folder):
    return I.delimiter_profile(I.text_lines(table(spark, folder, "documents"), "doc_id", "text", I.DELIMITER_LINES))


@query
def delimiter_consistency(spark, folder):
    """Files of forty events each, with another delimiter unevenly inside a field, or of one field."""
    file = F.expr("event_id div 40")
    part = F.get(F.array(*[F.lit(d) for d in I.DELIMITERS]), (file % 4).cast("int"))
    other = F.when(part == ",", F.lit("; ")).otherwise(F.lit(", "))
    noise = F.when(F.col("event_id") % 40 > 0, F.repeat(other, (F.col("event_id") % 7).cast("int"))).otherwise("title")
    quoted = F.concat(F.lit('"'), "event_type", part, part, other, F.lit('"'))
    line = F.when(file % 9 == 0, quoted).otherwise(F.concat(F.col("event_id").cast("string"), part, noise, part, quoted))
    number = F.col("event_id") % 40 + 1
    return I.consistent_delimiter(table(spark, folder, "events").select(file.alias("file"), number.alias("line_no"), line.alias("line")))


@query
def has_quotes(spark, folder):
    quoted = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\nit's"))).otherwise(F.col("text"))
    docs = table(spark, folder, "documents").select("doc_id", quoted.alias("text"))
    return I.has_quotes(I.text_lines(docs, "doc_id", "text", I.QUOTE_LINES))


def document_files(spark, folder) -> str:
    """Text files written from the documents, one for each source, one empty, one without a newline."""
    path = scratch_path(spark, "files")
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("text", "source").write.partitionBy("source").text(path)
    spark.range(0).selectExpr("'' as value").coalesce(1).write.text(f"{path}/source=empty")
    spark.range(1).selectExpr("'a|b|c' as value").coalesce(1).write.option("lineSep", ";").text(f"{path}/source=single")
    return f"{path}/source=*/part-*"


def source_of(path: Column) -> Column:
    return F.regexp_extract(path, "source=([^/]+)", 1).alias("source")


@query
def file_profiles(spark, folder):
    heads = I.file_heads(spark, document_files(spark, folder))
    lines = I.head_lines(heads)
    both = I.delimiter_profile(lines).join(I.has_quotes(lines), "file")
    return I.encoding_profile(heads).join(both, "file").select(source_of(F.col("file")), "encoding", "delimiter", "has_quotes")


@query
def file_hashes(spark, folder):
    hashes = I.file_hashes(spark, document_files(spark, folder))
    return hashes.select(source_of(F.col("path")), "content_hash")


@query
def strip_quotes_raw(spark, folder):
    source, out = scratch_path(spark, "raw"), scratch_path(spark, "raw-stripped")
    quoted = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('"'), "text", F.lit("'\n''"))).otherwise(F.col("text"))
    table(spark, folder, "documents").select(quoted).write.text(source)
    I.strip_quotes_files(spark, source, out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@query
def supported_files(spark, folder):
    ends = F.element_at(F.array(*[F.lit(e) for e in (".csv", ".TXT", ".Csv", ".parquet", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    names = table(spark, folder, "pages").select("page_id", F.concat("url", ends).alias("name"))
    return names.where(readers.supported_file(F.col("name")))


# --- record repair ----------------------------------------------------------------------------

EVENT_FIELDS = ["event_id", "user_id", "event_type"]


def csv_lines(spark, folder) -> DataFrame:
    """``event_id, value``: delimited lines, three in ten of them malformed."""
    key = F.col("event_id")
    whole = F.concat_ws(",", *EVENT_FIELDS)
    value = (
        F.when(key % 10 == 1, F.concat_ws(",", "event_id", "user_id"))
        .when(key % 10 == 2, F.concat(whole, F.lit(",x")))
        .when(key % 10 == 3, F.lit(""))
        .otherwise(whole)
    )
    return table(spark, folder, "events").select("event_id", value.alias("value"))


@query
def csv_arity_valid(spark, folder):
    lines = csv_lines(spark, folder).select("value")
    return S.valid_rows(S.check_records(lines, EVENT_FIELDS), EVENT_FIELDS)


@query
def csv_arity_bad(spark, folder):
    return S.bad_rows(S.check_records(csv_lines(spark, folder), EVENT_FIELDS), ["event_id"])


@query
def csv_bad_row_numbers(spark, folder):
    path = scratch_path(spark, "lines")
    ordered = csv_lines(spark, folder).repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select("value").write.text(path)
    numbered = B.number_records(B.scan_lines(spark, path), "dataset").withColumn("row_number", F.col("row_number") + 1)
    return S.bad_rows(S.check_records(numbered, EVENT_FIELDS))


@query
def csv_quoted_fields(spark, folder):
    """Records with quoted delimiters, newlines and doubled quotes; the texts come back unchanged."""
    cell = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), cell, F.col("lang"))
    lines = table(spark, folder, "documents").select(line.alias("value"))
    header = ["doc_id", "text", "lang"]
    return S.valid_rows(S.check_records(lines, header, whole=True), header)


@query
def csv_type_errors(spark, folder):
    value = F.concat_ws(",", "event_id", F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.col("user_id").cast("string")))
    lines = table(spark, folder, "events").select("event_id", value.alias("value"))
    return S.bad_rows(S.check_records(lines, ["event_id", "user_id"], types={"user_id": "bigint"}), ["event_id"])


@query
def csv_repair_counts(spark, folder):
    return S.repair_counts(S.check_records(csv_lines(spark, folder).select("value"), EVENT_FIELDS))


@query
def csv_repair_files(spark, folder):
    """The complete repair job on files that start with a header; valid rows read back."""
    source, good, bad = (scratch_path(spark, n) for n in ("repair-in", "repair-good", "repair-bad"))
    lines = csv_lines(spark, folder).select(F.col("value").alias(",".join(EVENT_FIELDS)))
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").option("emptyValue", "").csv(source)
    S.repair_csv(spark, source, good, bad)
    return readers.scan_plain(spark, good, "~")


@query
def csv_multi_line(spark, folder):
    """Texts with newlines inside quotes, found again across file blocks."""
    source = scratch_path(spark, "multi-line")
    sinks.write_csv(table(spark, folder, "documents"), source, ",", quote_all=True)
    checked, header = S.repair_files(spark, source, multi_line=True)
    return S.valid_rows(checked, header)


@query
def csv_repair_mixed_headers(spark, folder):
    """Files of one folder with their columns in different orders."""
    source = scratch_path(spark, "mixed-headers")
    for odd, fields in enumerate((EVENT_FIELDS, EVENT_FIELDS[::-1])):
        part = table(spark, folder, "events").where(F.col("event_id") % 2 == odd).select(*fields)
        sinks.write_csv(part, source, ",", mode="append")
    checked, header = S.repair_files(spark, source)
    return S.valid_rows(checked, header).select(*EVENT_FIELDS)


# --- sinks ----------------------------------------------------------------------------------


def nested_customers(spark, folder) -> DataFrame:
    groups = ["c_name", {"place": ["c_nationkey", "c_mktsegment"]}, "gone", "place"]
    return C.nest(table(spark, folder, "customer"), ["c_custkey", "c_acctbal"], groups)


@query
def write_parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "nested")
    sinks.write_parquet(nested_customers(spark, folder), path)
    return spark.read.parquet(path).select("c_custkey", "c_acctbal", json_of("additional_info"))


@query
def write_parquet_codecs(spark, folder):
    parts = []
    for codec in sinks.CODECS:
        path = scratch_path(spark, f"codec-{codec}")
        sinks.write_parquet(table(spark, folder, "supplier").select("s_suppkey", "s_name"), path, codec)
        parts.append(spark.read.parquet(path).withColumn("codec", F.lit(codec)))
    return R.vstack(parts)


@query
def write_split(spark, folder):
    path = scratch_path(spark, "split")
    sinks.write_split(table(spark, folder, "orders"), path, target_mb=1)
    return spark.read.parquet(path)


@query
def write_sized(spark, folder):
    """All rows again, and whether every file but the last is within 20 % of the size asked for."""
    path, target = scratch_path(spark, "sized"), 0.1
    sizes = sized.write_sized(table(spark, folder, "lineitem"), path, target)
    fits = all(abs(size / (target * (1 << 20)) - 1) < 0.2 for size in sizes[:-1])
    return spark.read.parquet(path).withColumn("fits", F.lit(fits))


@query
def write_csv_minimal(spark, folder):
    path = scratch_path(spark, "csv-minimal")
    sinks.write_csv(table(spark, folder, "conversations"), path, "~")
    reader = spark.read.option("header", True).option("sep", "~").option("escape", '"').option("multiLine", True)
    return reader.schema("conv_id bigint, turn bigint, role string, text string").csv(path)


@query
def write_csv_quoted(spark, folder):
    path = scratch_path(spark, "csv-quoted")
    sinks.write_csv_flat(dirty_docs(spark, folder), path)
    return spark.read.text(path).where(F.col("value") != '"doc_id"|"v"').select(F.col("value").alias("line"))


@query
def write_bad_rows(spark, folder):
    path = scratch_path(spark, "bad")
    bad = S.bad_rows(S.check_records(csv_lines(spark, folder), EVENT_FIELDS), ["event_id"])
    sinks.write_csv(bad, path, "~", quote_all=True)
    return spark.read.option("header", True).option("sep", "~").csv(path).na.fill("")


# --- columns ----------------------------------------------------------------------------------


@query
def exclude_columns(spark, folder):
    return C.exclude_columns(table(spark, folder, "customer"), ["c_acctbal", "nope"])


@query
def rename_columns(spark, folder):
    return C.rename_columns(table(spark, folder, "nation"), {"n_name": "name", "n_nationkey": "n_nationkey", "nope": "x"})


@query
def export_projection(spark, folder):
    names = {"c_custkey": "id", "c_name": "name", "c_nationkey": "", "c_mktsegment": "name"}
    return C.export_projection(table(spark, folder, "customer"), names, ["c_acctbal"])


@query
def concat_columns(spark, folder):
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    orders = table(spark, folder, "orders").select("o_orderkey", status.alias("status"), "o_orderpriority")
    joined = C.concat_columns(orders, "label", ["status", "o_orderkey", "o_orderpriority"], "-")
    return C.concat_columns(joined, "never", ["status", "nope"], "-")


@query
def concat_trimmed(spark, folder):
    padded = F.concat(F.lit("  "), "text", F.lit("\t\n"))
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role", padded.alias("text"))
    return C.concat_trimmed(chats, "said", ["turn", "role", "text"], ": ").drop("text")


@query
def concat_cleaned(spark, folder):
    parts = table(spark, folder, "part").withColumn("size", F.col("p_size") % 5)
    return C.concat_cleaned(parts, "label", ["p_name", "p_brand", "size"], "/", ["latin_basic", "digits"])


@query
def nest_fields(spark, folder):
    return nested_customers(spark, folder).select("c_custkey", "c_acctbal", json_of("additional_info"))


@query
def add_metadata(spark, folder):
    return C.add_metadata(table(spark, folder, "nation"), 2024, "kg")


@query
def cast_to_text(spark, folder):
    return C.cast_to_text(table(spark, folder, "labels"))


@query
def visible_projection(spark, folder):
    return C.visible_projection(table(spark, folder, "supplier"), ["s_name", "s_suppkey"], {"s_name": "supplier"})


@query
def nest_auto(spark, folder):
    customers = table(spark, folder, "customer").withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal"))
    nested = C.nest_auto(customers, ["Name", "id"], {"c_name": " NAME ", "c_custkey": "Id"})
    return nested.select("c_custkey", "c_name", json_of("additional_info"))


@query
def nest_auto_exact(spark, folder):
    nested = C.nest_auto(table(spark, folder, "nation"), ["n_nationkey", "nope"])
    return nested.select("n_nationkey", json_of("additional_info"))


# --- rows -------------------------------------------------------------------------------------


@query
def require_not_null(spark, folder):
    return R.require_not_null(dirty_docs(spark, folder), ["v", "doc_id"])


@query
def require_not_empty(spark, folder):
    return R.require_not_empty(dirty_docs(spark, folder), ["v"])


@query
def dedup_subset(spark, folder):
    events = table(spark, folder, "events").select("user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "props")
    return R.dedup(events, ["user_id", "event_type"]).select("user_id", "event_type")


@query
def dedup_ordered(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "props")
    return R.dedup(events, ["user_id", "event_type"], order_by=["event_id"])


@query
def dedup_all(spark, folder):
    lines = table(spark, folder, "lineitem")
    return R.dedup(R.vstack([lines, lines]))


@query
def dedup_fallback(spark, folder):
    orders = table(spark, folder, "orders")
    return R.dedup(R.vstack([orders, orders]), ["nope"])


@query
def head_rows(spark, folder):
    return R.head_rows(table(spark, folder, "documents"), 5000, ["n_chars", "doc_id"]).select("doc_id", "lang")


@query
def slice_rows(spark, folder):
    return R.slice_rows(table(spark, folder, "conversations"), 100, 50, ["conv_id", "turn"]).select("conv_id", "turn", "text")


@query
def slice_by_position(spark, folder):
    """Rows in the middle of a table that lies sorted in several files."""
    path = scratch_path(spark, "by-position")
    orders = table(spark, folder, "orders")
    orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return sized.slice_table(spark, path, 700, 600)


@query
def vstack(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, folder, "benchmark").select("text", F.col("item_id").alias("id"))
    return R.vstack([docs, items, items])


# --- text -------------------------------------------------------------------------------------


@query
def keep_patterns(spark, folder):
    return map_v(spark, folder, lambda c: X.keep_patterns(c, KEPT))


@query
def keep_patterns_nullsafe(spark, folder):
    return map_v(spark, folder, lambda c: X.keep_patterns_nullsafe(c, KEPT))


@query
def concat_with_target_rules(spark, folder):
    docs = table(spark, folder, "documents")
    lang = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    wf = Workflow.from_dict(
        {
            "concatenations": [{"name": "label", "source_columns": ["source", "lang"], "separator": "-"}],
            "regex_rules": {"label": ["latin_basic"], "source": ["digits"], "n_chars": ["digits"]},
        }
    )
    shaped, _ = W.shape_columns(docs.select("doc_id", "source", lang.alias("lang"), "n_chars"), wf)
    return shaped


@query
def replace_pattern(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        X.replace_pattern(F.col("p_brand"), "hash", with_label_of="dollar").alias("brand"),
        X.replace_pattern(F.col("p_brand"), "digits", "\\1$0").alias("digits_gone"),
        X.replace_pattern(F.nullif(F.col("p_type"), F.lit("SMALL")), "latin_basic").alias("kind"),
    )


@query
def strip_quotes(spark, folder):
    return map_v(spark, folder, X.strip_quotes)


@query
def clean_special_chars(spark, folder):
    return map_v(spark, folder, X.clean_special_chars)


@query
def normalize_whitespace(spark, folder):
    return map_v(spark, folder, X.normalize_whitespace)


@query
def clean_strings(spark, folder):
    return C.clean_strings(dirty_docs(spark, folder))


@query
def lowercase_all(spark, folder):
    return C.lowercase(table(spark, folder, "documents"))


@query
def nullify_empty(spark, folder):
    return C.replace_empty(dirty_docs(spark, folder))


@query
def replace_empty(spark, folder):
    return map_v(spark, folder, lambda c: X.replace_empty(c, "n/a"))


@query
def flatten_newlines(spark, folder):
    return map_v(spark, folder, X.flatten_newlines)


@query
def short_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", N.short_hash(F.col("text")).alias("h"))


@query
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", N.content_hash(F.col("text")).alias("h"))


@query
def transliterate(spark, folder):
    cyrillic = F.translate("text", LATIN, CYRILLIC)
    letters = F.concat(cyrillic, F.lit(" ЖжХхЦцЧчШшЩщЪъЫыЬьЭэЮюЯяЁё"))
    return table(spark, folder, "documents").select("doc_id", N.transliterate(letters).alias("v"))


@query
def sanitize_name(spark, folder):
    urls = F.when(F.col("page_id") % 10 == 0, F.lit("!?-")).otherwise(F.concat("url", F.lit(" Щи,Я.")))
    return table(spark, folder, "pages").select("page_id", N.sanitize_name(urls).alias("v"))


@query
def valid_country(spark, folder):
    code = F.nullif(F.substring("lang", 1, 2), F.lit("fr"))
    docs = table(spark, folder, "documents").select("doc_id", code.alias("code"))
    return docs.select("doc_id", N.valid_country(F.col("code"), ["EN".lower(), "nl"]).alias("ok"))


def named_pages(spark, folder) -> DataFrame:
    country = F.element_at(F.array(*[F.lit(c) for c in ("ru", "KG", "zz")]), (F.col("page_id") % 3 + 1).cast("int"))
    name = N.output_name(country, F.concat("url", F.lit(".csv")), F.lit(2023), prefix="clean")
    return table(spark, folder, "pages").select("page_id", name.alias("name"))


@query
def output_name(spark, folder):
    return named_pages(spark, folder)


@query
def valid_output_name(spark, folder):
    names = named_pages(spark, folder).select(
        "page_id", F.when(F.col("page_id") % 4 == 0, F.replace("name", F.lit("-ru-"), F.lit("-xx-"))).otherwise(F.col("name")).alias("name")
    )
    return names.select("page_id", N.valid_output_name(F.col("name"), "clean").alias("ok"))


@query
def pattern_flags(spark, folder):
    flags = [X.matches_pattern(F.col("v"), n).alias(n) for n in P.PATTERNS]
    return dirty_docs(spark, folder).select("doc_id", *flags)


@query
def array_nonempty(spark, folder):
    words = X.array_nonempty(F.split("v", "[ e]"))
    return dirty_docs(spark, folder).select("doc_id", F.size(words).cast("bigint").alias("n"), X.join_array(words, "|").alias("words"))


# --- profile ----------------------------------------------------------------------------------


def mixed_scripts(spark, folder) -> DataFrame:
    """Text in two scripts, with a letter two classes share and written-out escapes."""
    extra = F.element_at(
        F.array(*[F.lit(e) for e in ("\u04b1", "\u04ae", "\\u0020", "\u02bc#")]), (F.col("doc_id") % 4 + 1).cast("int")
    )
    mixed = F.concat(F.translate("text", LATIN, CYRILLIC), extra)
    return table(spark, folder, "documents").select(
        "doc_id", mixed.alias("mixed"), F.when(F.col("doc_id") % 4 == 0, extra).alias("shared"), F.nullif("lang", F.col("lang")).alias("none")
    )


@query
def pattern_profile(spark, folder):
    parts = []
    for name in ("documents", "pages", "part", "customer", "events"):
        parts.append(A.pattern_profile(table(spark, folder, name)).withColumn("table_name", F.lit(name)))
    return R.vstack(parts)


@query
def column_metadata(spark, folder):
    meta = A.column_metadata(A.pattern_profile(table(spark, folder, "documents"), uncovered=True))
    lists = [
        F.array_join(n, "|").alias(n)
        for n in ("detected_patterns", "prev_selected_patterns", "selected_patterns", "detected_display_patterns", "display_patterns")
    ]
    return meta.select("hash", "column", "origin_name", "display_name", *lists, "mode", "uncovered_chars")


@query
def pattern_set_first(spark, folder):
    return A.pattern_set_first(mixed_scripts(spark, folder), ["mixed", "shared", "none"])


@query
def pattern_set_column(spark, folder):
    return A.pattern_set_column(mixed_scripts(spark, folder), "mixed")


@query
def table_info(spark, folder):
    return A.table_info(table(spark, folder, "lineitem"))


@query
def concat_metadata(spark, folder):
    meta = A.column_metadata(A.pattern_profile(table(spark, folder, "part")))
    merged = A.concat_metadata(meta, "label", ["p_name", "p_brand"], " ")
    lists = [F.array_join(n, "|").alias(n) for n in ("detected_patterns", "detected_display_patterns")]
    return merged.select("hash", "column", *lists, F.array_join("concatenated.source_columns", "|").alias("sources"))


@query
def profile_reuse(spark, folder):
    path = scratch_path(spark, "profile")
    parts = table(spark, folder, "part")
    A.profile_or_reuse(parts, path)
    saved, reused = A.profile_or_reuse(parts, path)
    patterns = F.array_join("detected_patterns", "|").alias("detected_patterns")
    return saved.select("column", patterns, F.lit(reused).alias("reused"))


@query
def profile_reuse_moved_nulls(spark, folder):
    """A table with the same values in the other column is another table."""
    path = scratch_path(spark, "profile")
    parts, none = table(spark, folder, "part"), F.lit(None).cast("string")
    A.profile_or_reuse(parts.select("p_partkey", none.alias("p_name"), F.col("p_brand").alias("p_type")), path)
    saved, reused = A.profile_or_reuse(parts.select("p_partkey", F.col("p_brand").alias("p_name"), none.alias("p_type")), path)
    patterns = F.array_join("detected_patterns", "|").alias("detected_patterns")
    return saved.select("column", patterns, F.lit(reused).alias("reused"))


# --- complete jobs ----------------------------------------------------------------------------

WORKFLOW = Workflow.from_dict(
    {
        "year": 2024,
        "country_code": "ru",
        "columns": {"exclude": ["n_chars", "nope"]},
        "concatenations": [{"name": "label", "source_columns": ["source", "lang"], "separator": " "}],
        "regex_rules": {"label": ["latin_basic", "digits"], "v": KEPT, "source": ["digits"]},
        "display_names": {"v": "body"},
        "structure": {"main_info": ["doc_id", "v", "additional_info"], "additional_info": ["label", {"origin": ["source", "lang"]}]},
        "dedup": {"unique_columns": ["v"]},
        "not_empty": {"columns": ["v"]},
    }
)


def workflow_input(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents")
    lang = F.when(F.col("doc_id") % 3 != 0, F.upper("lang")).alias("lang")
    return docs.select("doc_id", dirt(F.col("doc_id"), F.col("text")).alias("v"), lang, "source", "n_chars")


@query
def workflow_cli(spark, folder):
    result = W.cli_workflow(workflow_input(spark, folder), WORKFLOW, order_by=["doc_id"])
    return result.select("doc_id", "body", json_of("additional_info"), "year", "country_code")


def finished_workflow(spark, path: str | list[str]) -> DataFrame:
    """The standard job from files to files."""
    out = scratch_path(spark, "workflow-out")
    W.run_workflow(spark, path, WORKFLOW, out, order_by=["doc_id"])
    return spark.read.parquet(out).select("doc_id", "body", json_of("additional_info"), "year", "country_code")


@query
def workflow_csv(spark, folder):
    """From delimited files with newlines inside quotes."""
    path = scratch_path(spark, "workflow-in")
    sinks.write_csv(workflow_input(spark, folder), path, ",")
    return finished_workflow(spark, path)


@query
def workflow_many_files(spark, folder):
    """From Parquet files that a glob finds."""
    path = scratch_path(spark, "workflow-in")
    for i in range(3):
        workflow_input(spark, folder).where(F.col("doc_id") % 3 == i).write.parquet(f"{path}/part{i}.parquet")
    return finished_workflow(spark, f"{path}/part*.parquet")


@query
def workflow_case_names(spark, folder):
    """Columns that differ from the added ones in case only stay beside them."""
    docs = table(spark, folder, "documents")
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        cased = docs.select("doc_id", F.col("n_chars").alias("Year"), F.upper("source").alias("Label"), "lang")
        concat = {"name": "label", "source_columns": ["Label", "lang"], "separator": "-"}
        result = W.cli_workflow(cased, Workflow.from_dict({"concatenations": [concat], "year": 2024}))
        return result.toDF("doc_id", "given_year", "given_label", "lang", "label", "year", "country_code")
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def partial_keys(spark, folder) -> DataFrame:
    value = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return table(spark, folder, "events").select("event_id", (F.col("user_id") % 50).alias("k"), value.alias("v"))


@query
def workflow_lib(spark, folder):
    wf = Workflow.from_dict(
        {
            "columns": {"exclude": ["tag"]},
            "concatenations": [{"name": "tag", "source_columns": ["k", "v"], "separator": "-"}],
            "regex_rules": {"v": ["latin_basic"]},
            "display_names": {"v": "kind"},
            "dedup": {"unique_columns": ["k"]},
            "not_empty": {"columns": ["v", "nope"]},
        }
    )
    return W.lib_workflow(partial_keys(spark, folder), wf, order_by=["event_id"])


@query
def workflow_full(spark, folder):
    wf = Workflow.from_dict(
        {
            "columns": {"standalone": ["v", "label", "source"], "exclude": ["n_chars"]},
            "concatenations": [{"name": "label", "source_columns": ["source", "lang"], "separator": "-"}],
            "regex_rules": {"v": KEPT, "label": ["latin_basic", "digits"]},
            "display_names": {"label": "Label"},
            "dedup": {"unique_columns": ["v", "doc_id"]},
            "not_empty": {"columns": ["v", "Label"]},
        }
    )
    return W.full_workflow(workflow_input(spark, folder), wf)


@query
def workflow_default_rules(spark, folder):
    docs = workflow_input(spark, folder).select("v", "lang", "source")
    return W.cli_workflow(docs, W.self_configured(docs, year=2024))


@query
def workflow_stream(spark, folder):
    """The standard job as a stream over the document files; equal to the same job on the table."""
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    docs = readers.read_parquet(spark, f"{folder.rstrip('/')}/documents.parquet")
    stream = streaming.stream_files(spark, f"{folder.rstrip('/')}/documents*.parquet", like=docs)
    wf = Workflow.from_dict(
        {"regex_rules": {"text": KEPT}, "display_names": {"text": "body"}, "columns": {"exclude": ["doc_id", "source", "n_chars"]},
         "not_empty": {"columns": ["text"]}, "year": 2024}
    )
    streaming.run_stream(stream, wf, out, checkpoint, duplicates="all_time")
    return spark.read.parquet(out)


@query
def workflow_stream_csv(spark, folder):
    """The standard job over delimited files that arrive in two steps, with quoted newlines and zeros; equal to the batch job."""
    source, out, checkpoint = (scratch_path(spark, name) for name in ("stream-csv", "stream-csv-out", "stream-csv-state"))
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 5).alias("zeros"))
    wf = Workflow.from_dict(
        {"regex_rules": {"lang": KEPT}, "display_names": {"text": "body"}, "columns": {"exclude": ["doc_id"]},
         "not_empty": {"columns": ["text"]}, "year": 2024}
    )
    for part, fields in enumerate((["doc_id", "text", "lang", "zeros"], ["zeros", "lang", "text", "doc_id"])):
        sinks.write_csv(docs.where(F.col("doc_id") % 2 == part).select(*fields), f"{source}/{part}", ",")
        streaming.run_delimited_stream(spark, f"{source}/*", wf, out, checkpoint, duplicates="all_time")
    return spark.read.parquet(out)
