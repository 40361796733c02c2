"""Complete cleaning jobs, composed from the operators.

Three variants exist: ``cli`` (the standard job), ``lib`` (no lower case, nesting or
metadata; duplicates first) and ``full`` (every column as text, cleaned one by one).
Everything up to the duplicate removal is a chain of projections and a filter inside one
stage; the duplicate removal is the only shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from rowscrub.functions import patterns as P
from rowscrub.functions import text as X
from rowscrub.operators import columns as C
from rowscrub.operators import rows as R
from rowscrub.operators.profile import detected_rules, pattern_profile
from rowscrub.operators.report import Report, note
from rowscrub.plans.settings import Workflow
from rowscrub.sources import readers, sinks

METADATA = ("year", "country_code")
NESTED = "additional_info"


def split_rules(wf: Workflow, columns: Iterable[str]) -> tuple[list[tuple[str, list[str]]], dict[str, list[str]]]:
    """Class rules as (rules on the sources of a ruled concatenation, rules on plain columns).

    A rule on a concatenation is applied to its sources, once per concatenation they feed.
    Those sources lose their own rules, even if the concatenation's rule has no known class.
    """
    present = set(columns)
    on_sources: list[tuple[str, list[str]]] = []
    claimed: set[str] = set()
    targets: set[str] = set()
    for concat in wf.concatenations:
        names = list(wf.regex_rules.get(concat.name) or [])
        if not names:
            continue
        targets.add(concat.name)
        sources = [s for s in concat.sources if s in present]
        claimed.update(sources)
        if any(n in P.PATTERNS for n in names):
            on_sources += [(s, names) for s in sources]
    own = {c: list(n) for c, n in wf.regex_rules.items() if n and c not in targets and c not in claimed}
    return on_sources, own


def shape_columns(
    df: DataFrame, wf: Workflow, variant: str = "cli", strict: bool = True, report: Report | None = None
) -> tuple[DataFrame, Workflow]:
    """Class rules, concatenation, exclusion and renaming; returns the settings under the new names."""
    if strict:
        wf.check_patterns()
    available = list(df.columns)
    on_sources, own = split_rules(wf, available)
    for source, names in on_sources:
        df = C.map_columns(df, [source], lambda c, n=names: X.keep_patterns(c, n, strict=False))
    for concat in wf.concatenations:
        df = C.concat_columns(df, concat.name, concat.sources, concat.separator, known=available, report=report)
    df = C.exclude_columns(df, wf.exclude, known=available if variant == "cli" else None, report=report)
    present = [c for c in own if c in df.columns]
    note(report, "keep", present, [c for c in own if c not in df.columns])
    df = df.select(
        *[X.keep_patterns(C.ref(c), own[c], strict=False).alias(c) if c in own else C.ref(c) for c in df.columns]
    )
    renames = C.valid_renames(df.columns, wf.display_names)
    df = C.rename_columns(df, wf.display_names, report)
    return df, wf.renamed(renames, structure=variant == "cli")


def clean_rows(
    df: DataFrame, wf: Workflow, strict: bool = True, report: Report | None = None, metadata: bool = True
) -> tuple[DataFrame, Workflow]:
    """All of the standard job that works row by row, on a table or a stream; with the renamed settings.

    ``metadata=False`` leaves the constant columns to :func:`add_metadata`.
    """
    df, wf = shape_columns(df, wf, "cli", strict, report)
    df = C.clean_strings(C.lowercase(df))
    nesting = bool(wf.main_info or wf.additional_info)
    later = set(METADATA) | ({NESTED} if nesting else set())
    early = [n for n in wf.not_empty if n not in later]
    if wf.not_empty:
        df = R.require_not_null(C.computed_once(df), early, strict, report)
    if nesting:
        df = C.nest(df, wf.main_info, wf.additional_info, NESTED)
    if metadata:
        df = add_metadata(df, wf)
    constants = set() if metadata else set(METADATA)
    return R.require_not_null(df, [n for n in wf.not_empty if n in later - constants], strict, report), wf


def add_metadata(df: DataFrame, wf: Workflow) -> DataFrame:
    return C.add_metadata(df, datetime.now().year if wf.year is None else wf.year, wf.country_code)


def cli_workflow(
    df: DataFrame,
    wf: Workflow,
    order_by: Sequence[str] | None = None,
    strict: bool = True,
    report: Report | None = None,
) -> DataFrame:
    """The standard job: shape, lower case, clean, required columns, nest, metadata, duplicates.

    The constant columns tell no rows apart, so they are added behind the duplicate removal, which then is
    a plain aggregate if the key is all else; unless they replace columns, or are the whole key.
    """
    rows, renamed = clean_rows(df, wf, strict, report, metadata=False)
    keys = R.dedup_keys([*rows.columns, *METADATA], renamed.unique_columns, report)
    telling = [k for k in keys if k not in METADATA]
    taken = {c.casefold() for c in rows.columns} & set(METADATA)
    if taken or not telling or set(map(str, order_by or ())) & set(METADATA):
        return R.dedup(add_metadata(rows, renamed), keys, order_by)
    return add_metadata(R.dedup(rows, telling, order_by), renamed)


def lib_workflow(
    df: DataFrame,
    wf: Workflow,
    order_by: Sequence[str] | None = None,
    strict: bool = True,
    report: Report | None = None,
) -> DataFrame:
    """Shape and clean, duplicates before required columns; missing required columns are ignored."""
    df, wf = shape_columns(df, wf, "lib", strict, report)
    df = C.computed_once(C.clean_strings(df))
    return R.require_not_null(R.dedup(df, wf.unique_columns, order_by, report), wf.not_empty, False, report)


def full_clean(
    df: DataFrame, wf: Workflow, lower: bool = True, nullify: bool = True, empty: str | None = None, strict: bool = True
) -> DataFrame:
    """Clean every column as text, then each standalone column by its own rule.

    Concatenations are standalone columns too: their sources are cleaned by the rule of
    the concatenation and then joined, under its display name. Empty markers are replaced
    in all columns each time a column has been cleaned, so a concatenation is only covered
    if another standalone column follows it.
    """
    df = C.normalize_whitespace(C.clean_special_chars(df))
    concats = {c.name: c for c in wf.concatenations}
    todo = set(df.columns)
    for name in wf.standalone:
        concat = concats.get(name)
        touched = list(concat.sources) if concat else [name]
        df = C.keep_lower(df, touched, wf.regex_rules.get(name) or (), lower, strict)
        if nullify:
            df = C.map_columns(df, todo | set(touched), lambda c: X.replace_empty(c, empty))
            todo = set()
        if concat:
            joined = wf.display_names.get(name, name)
            df = C.concat_columns(df, joined, concat.sources, concat.separator)
            todo = {joined}
    return C.exclude_columns(df, wf.exclude)


def full_workflow(
    df: DataFrame,
    wf: Workflow,
    order_by: Sequence[str] | None = None,
    lower: bool = True,
    empty: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """:func:`full_clean`, then duplicates, then rows whose required columns hold a value."""
    cleaned = C.computed_once(full_clean(df, wf, lower, True, empty, strict))
    return R.require_not_empty(R.dedup(cleaned, wf.unique_columns, order_by), wf.not_empty)


def default_rules(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Profile a table and take every class found in a column as its keep rule."""
    return detected_rules(pattern_profile(df, columns))


def self_configured(df: DataFrame, year: int | None = None, country_code: str = "ru") -> Workflow:
    """The workflow of somebody who accepts all defaults: keep what was found, key on all columns."""
    return Workflow(
        standalone=tuple(df.columns),
        regex_rules={c: n for c, n in default_rules(df).items() if n},
        unique_columns=tuple(df.columns),
        year=year,
        country_code=country_code,
    )


VARIANTS = {"cli": cli_workflow, "lib": lib_workflow, "full": full_workflow}


def run_workflow(
    spark: SparkSession,
    path: str | Sequence[str],
    wf: Workflow,
    out: str,
    variant: str = "cli",
    order_by: Sequence[str] | None = None,
    mode: str = "errorifexists",
    multi_line: bool = True,
    tasks: int | None = None,
) -> None:
    """Read, clean and write in one job. CSV output exists in the ``lib`` variant only.

    ``path`` is a file, a folder, a glob, or several of these. ``multi_line`` says whether quoted fields of
    delimited input may hold newlines. ``tasks`` deals an input of fewer row groups out to so many tasks. An
    ``out`` that ends in a slash is a folder, in which the workflow's own output name is used.
    """
    if out.endswith("/") and wf.output_filename:
        out += wf.output_filename
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.rstrip("/").lower().endswith(".parquet") for p in paths):
        df = spark.read.parquet(*paths)
    else:
        df = readers.scan_plain(spark, paths, multi_line=multi_line, staged=multi_line)
    df = readers.spread(df, tasks)
    result = VARIANTS[variant](df, wf, order_by=order_by)
    export = wf.export if variant == "lib" else {}
    if out.rstrip("/").lower().endswith(".csv") or (
        export.get("format") == "csv" and not out.rstrip("/").lower().endswith(".parquet")
    ):
        csv = export.get("csv") or {}
        sinks.write_csv(result, out, csv.get("delimiter", "~"), bool(csv.get("quote_all", True)), mode)
    else:
        codec = (export.get("parquet") or {}).get("compression", "zstd")
        sinks.write_parquet(result, out, codec, mode=mode)
