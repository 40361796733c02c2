"""Hashes, transliteration and file-name functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
COUNTRY_CODES = ("ru", "kg", "uz", "tm", "ua", "by", "nl", "az")
# --- end of fixed values ------------------------------------------------------------------


def short_hash(c: Column, length: int = 20) -> Column:
    return F.substring(F.md5(c), 1, length)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def transliterate(c: Column) -> Column:
    """Cyrillic letters to lower-case Latin; everything else stays.

    One ``translate`` does all letters with a single-character or empty result and lowers
    the rest, which are then replaced one by one.
    """
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    several = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) > 1}
    dropped = [k for k, v in CYRILLIC_TO_LATIN.items() if not v]
    source = [*single, *(k.upper() for k in single), *(k.upper() for k in several)]
    target = [*single.values(), *single.values(), *several]
    source += [*dropped, *(k.upper() for k in dropped)]
    c = F.translate(c, "".join(source), "".join(target))
    for letter, latin in several.items():
        c = F.replace(c, F.lit(letter), F.lit(latin))
    return c


def sanitize_name(c: Column) -> Column:
    """A name of ``[a-z0-9_-]`` only; ``data`` when nothing is left."""
    safe = F.regexp_replace(F.lower(transliterate(c)), "[^a-z0-9_-]+", "_")
    safe = F.trim(F.regexp_replace(safe, "_+", "_"), F.lit("_-"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.when(c.isNotNull(), F.lit("data")))


def valid_country(c: Column, allowed: Iterable[str] = COUNTRY_CODES) -> Column:
    return F.coalesce(F.lower(c).isin(list(allowed)), F.lit(False))


def output_name(
    country: Column,
    original: Column,
    year: Column,
    prefix: str,
    version: str = "v1",
    allowed: Iterable[str] = COUNTRY_CODES,
) -> Column:
    """``<prefix>-<country>-<name><_ext>-<year>-<version>.parquet``; null for a country not allowed."""
    base = F.regexp_extract(original, r"(?s)([^/]*)/*\z", 1)
    suffix = F.regexp_extract(base, r"(?s)\A.+(\.[^.]+)\z", 1)
    stem = F.left(base, F.length(base) - F.length(suffix))
    name = F.concat(
        F.lit(f"{prefix}-"), F.lower(country), F.lit("-"), sanitize_name(stem),
        F.replace(suffix, F.lit("."), F.lit("_")),
        F.lit("-"), year.cast("string"), F.lit(f"-{version}.parquet"),
    )
    return F.when(valid_country(country, allowed), name)


def valid_output_name(c: Column, prefix: str, allowed: Iterable[str] = COUNTRY_CODES) -> Column:
    shape = rf"\A{re.escape(prefix)}-[a-z]{{2}}-[a-z0-9_-]+-\p{{Nd}}{{4}}-v\p{{Nd}}+\.parquet\n?\z"
    country = F.split_part(c, F.lit("-"), F.lit(prefix.count("-") + 2))
    return F.coalesce(c.rlike(shape) & valid_country(country, allowed), F.lit(False))
