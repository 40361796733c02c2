"""Column-level operators: ``DataFrame`` in, ``DataFrame`` out, no shuffle anywhere."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscrub.functions import text as X
from rowscrub.operators.report import Report, note


def ref(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def case_matters(df: DataFrame) -> bool:
    """Does the session tell column names apart that differ in case only?"""
    return df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column, in place if the exact name exists, else behind the others.

    A name that differs from an existing one in case only would overwrite it; unless
    ``spark.sql.caseSensitive`` is on, that is an error.
    """
    clash = [c for c in df.columns if c != name and c.casefold() == name.casefold()]
    if clash and not case_matters(df):
        raise ValueError(f"column {name!r} differs from {clash[0]!r} in case only; set spark.sql.caseSensitive to have both")
    if name in df.columns:
        return map_columns(df, [name], lambda _: value)
    return df.select(*[ref(c) for c in df.columns], value.alias(name))


def map_columns(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a column function to some columns in one projection, keeping the column order."""
    chosen = set(names)
    return df.select(*[fn(ref(c)).alias(c) if c in chosen else ref(c) for c in df.columns])


def computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters above the expressions of ``df``.

    Catalyst pushes a filter on a computed column below the projection, which evaluates a
    long text chain twice. Passing the row through ``inline`` stops that at no other cost.
    """
    return df.select(F.inline(F.array(F.struct(*[ref(c) for c in df.columns]))))


def clean_strings(df: DataFrame) -> DataFrame:
    """Clean all string columns, then turn empty markers into null.

    Two projections on purpose: the marker test reads the cleaned value instead of
    repeating the chain that made it.
    """
    names = string_columns(df)
    return map_columns(map_columns(df, names, X.clean), names, X.nullify_empty)


def lowercase(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    return map_columns(df, string_columns(df) if names is None else names, F.lower)


def clean_special_chars(df: DataFrame) -> DataFrame:
    """All columns as text, special characters cleaned."""
    return map_columns(df, df.columns, lambda c: X.clean_special_chars(X.as_text(c)))


def normalize_whitespace(df: DataFrame) -> DataFrame:
    return map_columns(df, df.columns, lambda c: X.normalize_whitespace(X.as_text(c)))


def replace_empty(df: DataFrame, value: str | None = None) -> DataFrame:
    """Empty markers to null, or to ``value``, in every column whatever its type."""
    return map_columns(df, df.columns, lambda c: X.replace_empty(c, value))


def cast_to_text(df: DataFrame) -> DataFrame:
    return map_columns(df, df.columns, X.as_text)


def exclude_columns(
    df: DataFrame, names: Iterable[str], known: Iterable[str] | None = None, report: Report | None = None
) -> DataFrame:
    """Drop columns; names outside ``known`` (default: the current columns) are reported."""
    names = list(names)
    allowed = set(df.columns if known is None else known)
    valid = [n for n in names if n in allowed]
    note(report, "exclude", valid, [n for n in names if n not in allowed])
    gone = set(valid)
    return df.select(*[ref(c) for c in df.columns if c not in gone]) if gone else df


def valid_renames(columns: Iterable[str], renames: Mapping[str, str]) -> dict[str, str]:
    present = set(columns)
    return {old: new for old, new in renames.items() if old in present and old != new}


def rename_columns(df: DataFrame, renames: Mapping[str, str], report: Report | None = None) -> DataFrame:
    """Rename what exists and changes; two columns of one name are refused."""
    valid = valid_renames(df.columns, renames)
    note(report, "rename", valid, [n for n in renames if n not in df.columns])
    names = [valid.get(c, c) for c in df.columns]
    seen = Counter(names if case_matters(df) else map(str.casefold, names))
    if max(seen.values(), default=1) > 1:
        raise ValueError(f"rename gives duplicate column names: {names}")
    return df.toDF(*names)


def unique_names(names: Iterable[str], ignore_case: bool = False) -> list[str]:
    """A name that is taken already gets the first free one of ``_2``, ``_3`` and so on."""

    def key(name: str) -> str:
        return name.casefold() if ignore_case else name

    taken: dict[str, int] = {}  # name -> number to try next for a further copy of it

    def place(name: str) -> str:
        chosen = name
        if key(name) in taken:
            number = next(i for i in count(taken[key(name)]) if key(f"{name}_{i}") not in taken)
            taken[key(name)] = number + 1
            chosen = f"{name}_{number}"
        taken.setdefault(key(chosen), 2)
        return chosen

    return [place(name) for name in names]


def export_projection(df: DataFrame, display_names: Mapping[str, str], exclude: Iterable[str] = ()) -> DataFrame:
    """Every column not excluded, under its display name (a blank one falls back to the name)."""
    left_out = set(exclude)
    columns = [c for c in df.columns if c not in left_out]
    names = unique_names(display_names.get(c, c) or c for c in columns)
    return df.select(*[ref(c).alias(n) for c, n in zip(columns, names)])


def visible_projection(df: DataFrame, visible: Iterable[str], display_names: Mapping[str, str]) -> DataFrame:
    """Visible columns in table order under their display names."""
    shown = set(visible)
    return df.select(*[ref(c).alias(display_names.get(c, c)) for c in df.columns if c in shown])


def joined(columns: Sequence[Column], separator: str) -> Column:
    """Concatenate as text; one null makes the result null."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(separator), X.as_text(c)] if parts else [X.as_text(c)]
    return F.concat(*parts)


def concat_columns(
    df: DataFrame,
    name: str,
    sources: Sequence[str],
    separator: str,
    known: Iterable[str] | None = None,
    report: Report | None = None,
) -> DataFrame:
    """Add ``name`` from ``sources``; skipped unless all of them are in ``known``."""
    allowed = set(df.columns if known is None else known)
    missing = [s for s in sources if s not in allowed]
    if missing or not sources:
        note(report, "concat", [], missing or [name])
        return df
    note(report, "concat", [name])
    return add_column(df, name, joined([ref(s) for s in sources], separator))


def concat_trimmed(df: DataFrame, name: str, sources: Sequence[str], separator: str) -> DataFrame:
    """Concatenate trimmed texts into a column that must not exist yet."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    return add_column(df, name, joined([X.trim_all(X.as_text(ref(s))) for s in sources], separator))


def concat_cleaned(
    df: DataFrame,
    name: str,
    sources: Sequence[str],
    separator: str,
    keep: Iterable[str] = (),
    lower: bool = True,
    empty: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Clean the sources in place (classes, case, empty markers), then concatenate them."""
    df = keep_lower(df, sources, keep, lower, strict)
    return concat_columns(map_columns(df, sources, lambda c: X.replace_empty(c, empty)), name, sources, separator)


def keep_lower(
    df: DataFrame, names: Iterable[str], keep: Iterable[str], lower: bool = True, strict: bool = True
) -> DataFrame:
    """Class filter where at least one known class is chosen, then lower case."""
    chosen = list(keep)

    def fn(c: Column) -> Column:
        c = X.keep_patterns(c, chosen, strict) if chosen else c
        return F.lower(c) if lower else c

    return map_columns(df, names, fn)


def nest(
    df: DataFrame, main: Sequence[str], additional: Sequence[str | Mapping[str, Sequence[str]]], into: str = "additional_info"
) -> DataFrame:
    """Keep ``main`` on top and put the rest into one struct: flat fields, then one struct per group."""
    if not main and not additional:
        return df
    present = set(df.columns)
    # Every entry as (name, fields); a plain field has none.
    entries = [pair for item in additional for pair in (item.items() if isinstance(item, Mapping) else [(item, None)])]
    grouped = {name for name, fields in entries if fields is not None}

    def member(name: str, fields: Sequence[str] | None) -> list[Column]:
        if fields is None:
            return [ref(name)] if name in present - grouped else []
        inner = [ref(f) for f in fields if f in present]
        return [F.struct(*inner).alias(name)] if inner else []

    flat_first = sorted(entries, key=lambda entry: entry[1] is not None)
    members = [column for entry in flat_first for column in member(*entry)]
    info = F.struct(*members) if members else F.lit(None).cast("string")
    return df.select(*[ref(m) for m in main if m in present and m != into], info.alias(into))


def split_main(
    columns: Sequence[str], wanted: Iterable[str], display_names: Mapping[str, str] | None = None
) -> tuple[list[str], list[str]]:
    """Columns that stay on top and the others, by exact name or by display name.

    With ``display_names`` the trimmed lower-case display name is matched against the
    trimmed lower-case wanted names; if nothing matches, the exact rule decides.
    """
    wanted = list(wanted)
    if display_names is not None:
        targets = {w.strip().lower() for w in wanted}
        main = [c for c in columns if display_names.get(c, c).strip().lower() in targets]
        if main:
            return main, [c for c in columns if c not in main]
    exact = set(wanted)
    return [c for c in columns if c in exact], [c for c in columns if c not in exact]


def nest_auto(
    df: DataFrame, wanted: Iterable[str], display_names: Mapping[str, str] | None = None, into: str = "additional_info"
) -> DataFrame:
    main, rest = split_main(df.columns, wanted, display_names)
    return nest(df, main, rest, into)


def add_metadata(df: DataFrame, year: int, country_code: str = "ru") -> DataFrame:
    return add_column(add_column(df, "year", F.lit(year).cast("int")), "country_code", F.lit(country_code))
