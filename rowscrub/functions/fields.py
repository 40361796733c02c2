"""Splitting one delimited record into its fields.

A field that starts with a double quote runs to the closing one, a doubled quote inside
stands for one quote, and text after the closing quote is appended to the field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_fields(line: Column, delimiter: str = ",") -> Column:
    """The fields of one line as an array; a blank line has none.

    Lines without any double quote, nearly all of them, are a plain split.
    """
    d = re.escape(delimiter)
    other = f"[^{d}]*+"
    quoted = f'{d}(?:"[^"]*+(?:""[^"]*+)*+(?:"{other}|\\z)|{other})'
    # One pass finds the fields, each behind its delimiter; those in quotes are then opened one by one.
    led = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(quoted), F.lit(0))
    opened = F.transform(led, lambda x: _unquoted(F.substr(x, F.lit(len(delimiter) + 1))))
    plain = F.split(line, d, -1)
    return (
        F.when(line == "", F.array().cast("array<string>"))
        .when(F.contains(line, F.lit('"')), opened)
        .otherwise(plain)
    )


def _unquoted(field: Column) -> Column:
    """One field without its quotes: doubled ones up to the closing one stand for one, what follows is kept as it is."""
    mark = "\x00"
    inner = F.substr(field, F.lit(2))
    # With the doubled quotes set aside, from the left, the first quote that is left closes the field.
    marked = F.replace(inner, F.lit('""'), F.lit(mark))
    end = F.instr(marked, '"')
    inside = F.when(end > 0, F.left(marked, end - 1)).otherwise(marked)
    after = F.when(end > 0, F.substr(marked, end + 1)).otherwise("")
    simple = F.concat(F.replace(inside, F.lit(mark), F.lit('"')), F.replace(after, F.lit(mark), F.lit('""')))
    whole = '(?s)\\A([^"]*+(?:""[^"]*+)*+)"?+(.*)\\z'
    exact = F.concat(
        F.replace(F.regexp_extract(inner, whole, 1), F.lit('""'), F.lit('"')), F.regexp_extract(inner, whole, 2)
    )
    quoted = F.when(F.contains(inner, F.lit(mark)), exact).otherwise(simple)
    return F.when(F.startswith(field, F.lit('"')), quoted).otherwise(field)


def open_quote(line: Column, delimiter: str = ",") -> Column:
    """Does the line end inside a quoted field, so that its record goes on in the next line?"""
    d = re.escape(delimiter)
    field = f'(?:"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|(?!")[^{d}]*+)'
    return F.contains(line, F.lit('"')) & ~line.rlike(f"(?s)\\A{field}(?:{d}{field})*+\\z")
