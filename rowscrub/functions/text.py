"""Text functions: every one takes and returns Spark ``Column`` objects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscrub.functions import patterns as P

# --- fixed values -------------------------------------------------------------------------
EMPTY_MARKERS = ["", " ", "nan", "NaN", "none", "None", "null", "NULL", "0"]
NULL_TOKENS = ["", " ", "\t", "NULL", "null", "NaN", "nan", "None", "none"]
SPACE_TOKENS = ["&nbsp;", "\\n", "\\t", "\\r"]  # backslash + letter, two characters each
SPACE_CHARS = "\u00a0\ufeff\n\r\t\u202f\u2007\u1680\u180e\u205f"
REMOVED_CHARS = "\u200b\u200c\u200d\u2060\u00ad\u200e\u200f\u061c"
# --- end of fixed values ------------------------------------------------------------------

CONTROL_CHARS = "".join(chr(i) for i in [*range(0x20), 0x7F])
# Unicode White_Space, the set that (?U)\s matches.
WHITE_SPACE = "".join(
    chr(i)
    for i in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def as_text(c: Column) -> Column:
    return c.cast("string")


def strip_quotes(c: Column) -> Column:
    """Drop both quote characters."""
    return F.replace(F.replace(c, F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))


def strip_double_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def clean_special_chars(c: Column) -> Column:
    """Escapes and odd spaces become a space; invisible and control characters go.

    The multi-character tokens are plain substring replacements; everything else is one
    character wide, so a single ``translate`` covers the remaining rules in one pass.
    """
    for token in SPACE_TOKENS:
        c = F.replace(c, F.lit(token), F.lit(" "))
    dropped = REMOVED_CHARS + "".join(ch for ch in CONTROL_CHARS if ch not in SPACE_CHARS)
    return F.translate(c, SPACE_CHARS + dropped, " " * len(SPACE_CHARS))


def trim_all(c: Column) -> Column:
    """Trim every kind of Unicode white space, not just U+0020."""
    return F.trim(c, F.lit(WHITE_SPACE))


def normalize_whitespace(c: Column) -> Column:
    """Runs of two or more white-space characters become one space; ends are trimmed."""
    return trim_all(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def clean(c: Column) -> Column:
    """Quotes, special characters and white space, in that order."""
    return normalize_whitespace(clean_special_chars(strip_quotes(c)))


def is_empty(c: Column) -> Column:
    """Null, or one of the empty markers once trimmed."""
    return c.isNull() | trim_all(as_text(c)).isin(EMPTY_MARKERS)


def nullify_empty(c: Column) -> Column:
    return F.when(is_empty(c), F.lit(None)).otherwise(c)


def replace_empty(c: Column, value: str | None) -> Column:
    return nullify_empty(c) if value is None else F.when(is_empty(c), F.lit(value)).otherwise(c)


def null_tokens(c: Column) -> Column:
    """Ingest rule: exact null tokens (not trimmed) become null."""
    return F.when(c.isin(NULL_TOKENS), F.lit(None)).otherwise(c)


def null_to_blank(c: Column) -> Column:
    return F.coalesce(as_text(c), F.lit(""))


def keep_patterns_nullsafe(c: Column, names: Iterable[str], strict: bool = True) -> Column:
    """Keep only text of the chosen classes; null stays null, no names means no change."""
    names = list(names)
    regex = P.run_regex(names, strict)
    if regex is None:
        return as_text(c)
    # A wanted run is put back as a whole, any other character is dropped.
    return F.regexp_replace(as_text(c), f"(?s)({regex})|.", "$1")


def keep_patterns(c: Column, names: Iterable[str], strict: bool = True) -> Column:
    """Keep only text of the chosen classes; null becomes an empty text.

    An empty list leaves the column alone. A list of nothing but unknown names blanks it
    (only with ``strict=False``; otherwise unknown names raise).
    """
    names = list(names)
    if not names:
        return c
    if not P.known(names, strict):
        return F.lit("")
    return keep_patterns_nullsafe(null_to_blank(c), names, strict)


def keep_patterns_by_matches(c: Column, names: Iterable[str]) -> Column:
    """The same as :func:`keep_patterns`, spelled as match, filter, join; used to check it."""
    matches = F.regexp_extract_all(null_to_blank(c), F.lit(P.combine(names)), F.lit(0))
    return join_array(array_nonempty(matches), "")


def replace_pattern(c: Column, name: str, literal: str = "", with_label_of: str | None = None) -> Column:
    """Replace a class by a literal or, if no literal is given, by another class's label."""
    if not literal and with_label_of:
        literal = P.LABELS.get(with_label_of, "")
    return F.regexp_replace(null_to_blank(c), P.PATTERNS[name], P.escape_java_replacement(literal))


def flatten_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\n|\r", " ")


def array_nonempty(c: Column) -> Column:
    return F.filter(c, lambda x: F.length(x) > 0)


def join_array(c: Column, separator: str) -> Column:
    return F.array_join(c, separator)


def may_hold_wide(c: Column) -> Column:
    """Can any of the classes beyond ASCII match? A length comparison, then one cheap regex:
    their Latin-1 letters, or anything in the range that the others come from."""
    text = as_text(c)
    letters = sorted("".join(P.characters(n) for n in P.WIDE))
    low = "".join(f"\\u{ord(ch):04x}" for ch in letters if ch <= "\xff")
    high = [f"\\u{ord(ch):04x}" for ch in letters if ch > "\xff"]
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[{low}{high[0]}-{high[-1]}]")


def matches_pattern(c: Column, name: str, wide: Column | None = None) -> Column:
    """Does the text contain the class? Fixed texts are a byte search, not a regex.

    Classes beyond ASCII are only tried where ``wide``, by default any multi-byte text, holds.
    """
    text = as_text(c)
    literal = P.literal_of(name)
    if literal is not None:
        return F.contains(text, F.lit(literal))
    found = text.rlike(P.PATTERNS[name])
    if name not in P.WIDE:
        return found
    return (F.octet_length(text) > F.char_length(text) if wide is None else wide) & found


def has_uncovered(c: Column) -> Column:
    """Does the text hold a character that no class of the catalogue covers?"""
    return F.translate(as_text(c), P.COVERED, "") != ""


def without_escapes(c: Column) -> Column:
    """Written-out escapes blanked by a character of no class: each of them is one match."""
    text = as_text(c)
    for token in P.ESCAPE_TOKENS.values():
        text = F.replace(text, F.lit(token), F.lit("\u0001"))
    return text


def owns_match(c: Column, name: str, rest: Column, wide: Column) -> Column:
    """Does the class own a match, if every match belongs to the first class that fits it?

    ``rest`` is :func:`without_escapes` and ``wide`` is :func:`may_hold_wide` of the text.
    """
    literal = P.literal_of(name)
    if literal is not None:
        return F.contains(as_text(c) if name in P.ESCAPE_TOKENS else rest, F.lit(literal))
    found = rest.rlike(P.exclusive(name))
    return wide & found if name in P.WIDE else found


def drop_bad_utf8(c: Column) -> Column:
    """Bad bytes dropped; a genuine U+FFFD in the text goes as well."""
    return F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit(""))
