import re

import pytest
from pyspark.sql import functions as F

from rowscrub.functions import patterns as P
from rowscrub.functions import text as X
from rowscrub.operators import columns as C

CLEAN = [
    ('  "Ab" ', "ab"),
    ("A  B", "a b"),
    ("x&nbsp;y", "x y"),
    ("x\\ny", "x y"),
    ("X\\Ny", "x y"),
    ("&NBSP;", None),
    ("a​b", "ab"),
    ("a\u0007b", "ab"),
    ("a\tb", "a b"),
    ("a　b", "a　b"),
    ("a　　b", "a b"),
    ('&nb"sp;', None),
    ("a&nb​sp;b", "a&nbsp;b"),
    ("NULL", None),
    ("None", None),
    ("nan", None),
    (" 0 ", None),
    ('"0"', None),
    ("", None),
    ("0.0", "0.0"),
    ("00", "00"),
    (None, None),
]


def test_clean_in_workflow_order(spark):
    df = spark.createDataFrame([(i, v, i) for i, (v, _) in enumerate(CLEAN)], "i int, v string, n int")
    got = {r["i"]: r["v"] for r in C.clean_strings(C.lowercase(df)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CLEAN)}


def test_clean_leaves_numbers_alone(spark):
    df = spark.createDataFrame([(0, "0")], "n int, v string")
    assert C.clean_strings(df).collect()[0] == (0, None)


def test_clean_is_idempotent(column):
    values = [v for v, _ in CLEAN if v != "a&nb\u200bsp;b"]  # removing the gap makes a new token
    once = column(X.clean, *values)
    assert column(X.clean, *once) == once


def test_clean_equals_the_regex_chain(column):
    """The substring-and-translate form against one regex per rule."""

    def chain(c):
        for pattern, to in [
            ("[\"']", ""),
            (r"&nbsp;|\\n|\\t|\\r|\x{a0}|\x{feff}", " "),
            (r"[\n\r\t]", " "),
            (r"[\x{a0}\x{202f}\x{2007}\x{1680}\x{180e}\x{205f}]", " "),
            (r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{ad}\x{200e}\x{200f}\x{61c}]", ""),
            (r"[\x00-\x1f\x7f]", ""),
            (r"(?U)\s{2,}", " "),
            (r"(?U)\A\s+|\s+\z", ""),
        ]:
            c = F.regexp_replace(c, pattern, to)
        return c

    odd = [chr(i) for i in [*range(0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x61C, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    values = [f"a{x}b" for x in odd] + [f"{x}a{x}{x}b{x}" for x in odd] + ["\\\\n", "\\\\", "&nbsp", "\\r\\n"]
    assert column(X.clean, *values) == column(chain, *values)


def test_keep_patterns(column):
    assert column(lambda c: X.keep_patterns(c, ["digits", "hyphen"]), "+7 (999) 12-34", None) == ["799912-34", ""]
    assert column(lambda c: X.keep_patterns_nullsafe(c, ["digits"]), "a1", None) == ["1", None]
    assert column(lambda c: X.keep_patterns_nullsafe(c, []), "a1", None) == ["a1", None]
    assert column(lambda c: X.keep_patterns(c, []), "a1", None) == ["a1", None]
    assert column(lambda c: X.keep_patterns(c, ["nope"], strict=False), "a1", None) == ["", ""]
    with pytest.raises(ValueError, match="nope"):
        column(lambda c: X.keep_patterns(c, ["nope"]), "a")


SELECTIONS = [
    ["latin_basic", "literal_escaped_space", "backslash"],
    ["latin_basic", "backslash", "literal_escaped_space"],
    ["literal_escaped_space"],
    ["literal_escaped_newline", "digits"],
    ["latin_extended", "digits", "space", "newline", "period"],
    ["cyrillic_common", "cyrillic_extended", "latin_basic"],
    ["hyphen", "asterisk", "dollar", "vertical_bar", "backslash", "double_quote"],
    list(P.PATTERNS),
]


@pytest.mark.parametrize("names", SELECTIONS)
def test_keep_patterns_equals_joined_matches(column, names):
    values = ["a\\u0020b", "\\\\u0020 \\u000A1", "\\u\\u0020020", "Щука ҰұҮү ö.1\n", "a-b*$|\\\"'@#", "\U0001f600a\U0001f600", "", None]
    python = ["".join(re.findall("|".join(P.PATTERNS[n] for n in names), v or "")) for v in values]
    assert column(lambda c: X.keep_patterns(c, names), *values) == python
    assert column(lambda c: X.keep_patterns_by_matches(c, names), *values) == python


def test_every_class_matches_as_its_regex(column):
    values = [chr(i) for i in range(1, 0x500)] + ["\\u0020", "\\u000A", "plain", ""]
    for name in P.PATTERNS:
        want = [re.search(P.PATTERNS[name], v) is not None for v in values]
        assert column(lambda c, n=name: X.matches_pattern(c, n), *values) == want, name
        wide = column(lambda c, n=name: X.matches_pattern(c, n, X.may_hold_wide(c)), *values)
        assert wide == want, name


def test_uncovered(column):
    assert column(X.has_uncovered, "a1", "é", "(", "Ұ", "") == [False, True, True, False, False]


def test_replace_pattern(column):
    assert column(lambda c: X.replace_pattern(c, "hash", with_label_of="dollar"), "a#b", None) == ["a$b", ""]
    assert column(lambda c: X.replace_pattern(c, "digits", "\\1$0"), "a1") == ["a\\1$0"]
    assert column(lambda c: X.replace_pattern(c, "digits"), "a1b") == ["ab"]
    assert column(lambda c: X.replace_pattern(c, "digits", "x", with_label_of="dollar"), "a1") == ["ax"]


def test_small_functions(column):
    assert column(X.strip_quotes, "a\"'b") == ["ab"]
    assert column(X.strip_double_quotes, "a\"'b") == ["a'b"]
    assert column(X.flatten_newlines, "a\r\nb\nc\rd\n\re") == ["a b c d  e"]
    assert column(X.normalize_whitespace, "  a \t b\u0085") == ["a b"]
    assert column(X.null_tokens, "", " ", "\t", "NULL", "none", " NULL", "x") == [None] * 5 + [" NULL", "x"]
    assert column(lambda c: X.replace_empty(c, "-"), " None ", None, "x") == ["-", "-", "x"]
    assert column(lambda c: X.join_array(X.array_nonempty(F.split(c, ",")), ""), "a,,b") == ["ab"]
    assert column(X.null_to_blank, None, "a") == ["", "a"]


def test_catalogue():
    assert len(P.PATTERNS) == 28
    assert P.combine(["digits", "nope", "colon"]) == "[0-9]|:"
    assert P.combine(["nope"]) is None
    assert "Ү" not in P.characters("cyrillic_extended")
    assert P.names_of_labels([":", "Пробел"]) == ["space", "colon"]
    assert P.label_of("nope") == "nope"


MEMBERS = {
    "kazakh_cyrillic": "ӘәІіҰұ", "uzbek_cyrillic": "ЎўҲҳ", "cyrillic_common": "АЯаяЁёЖж", "cyrillic_extended": "ӨөүұҢңҚқҒғ",
    "latyn_kazakh": "äÄğĞıİñÑşŞ", "latyn_uzbek": "\u02bb\u02bc", "latin_basic": "AZazMm", "latin_extended": "öÖüÜ", "digits": "059",
    "space": " ", "newline": "\n", "colon": ":", "semicolon": ";", "hyphen": "-", "underscore": "_", "period": ".", "comma": ",",
    "backslash": "\\", "forward_slash": "/", "vertical_bar": "|", "double_quote": '"', "single_quote": "'", "dollar": "$", "at": "@",
    "hash": "#", "asterisk": "*",
}
"""Members of every class of single characters, written out here and not taken from the engine."""


def test_members_of_every_class(column):
    shared = {"ұ"}  # in two classes
    everything = "".join(MEMBERS.values()) + "Ү+=é\t"
    for name, members in MEMBERS.items():
        got = column(lambda c, n=name: X.matches_pattern(c, n), *everything)
        assert {ch for ch, found in zip(everything, got, strict=True) if found} == set(members) | (shared & set(members)), name
    assert column(lambda c: X.matches_pattern(c, "literal_escaped_space"), "a\\u0020", " ") == [True, False]
    assert column(lambda c: X.matches_pattern(c, "literal_escaped_newline"), "a\\u000A", "\n") == [True, False]
    assert len(MEMBERS) + 2 == 28
