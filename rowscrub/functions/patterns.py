"""Catalogue of character classes and the regular expressions built from it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from itertools import groupby, takewhile

# --- fixed values: class name -> (regex, display label), in catalogue order ---------------
CATALOGUE: dict[str, tuple[str, str]] = {
    "kazakh_cyrillic": (r"[\u04D8\u04D9\u0406\u0456\u04B0\u04B1]", "Казахская кириллица (Әә, Іі, Ұұ)"),
    "uzbek_cyrillic": (r"[\u040E\u045E\u04B2\u04B3]", "Узбекская кириллица (Ўў, Ҳҳ)"),
    "cyrillic_common": (r"[\u0410-\u044F\u0401\u0451]", "Кириллица (А-Я, а-я, Ёё)"),
    "cyrillic_extended": (
        r"[\u04E8\u04E9\u04AF\u04B1\u04A2\u04A3\u049A\u049B\u0492\u0493]",
        "Кириллица (Өө, Үү, Ңң, Ққ, Ғғ)",
    ),
    "latyn_kazakh": (
        r"[\u00E4\u00C4\u011F\u011E\u0131\u0130\u00F1\u00D1\u015F\u015E]",
        "Казахская латиница (äÄ, ğĞ, ıİ, ñÑ, şŞ)",
    ),
    "latyn_uzbek": (r"[\u02BB\u02BC]", "Узбекская латиница (ʼ)"),
    "latin_basic": (r"[A-Za-z]", "Латиница (A–Z, a–z)"),
    "latin_extended": (r"[\u00F6\u00D6\u00FC\u00DC]", "Латиница (öÖ, üÜ)"),
    "digits": (r"[0-9]", "Цифры (0–9)"),
    "space": (r"\u0020", "Пробел"),
    "newline": (r"\u000A", "Новая строка"),
    "literal_escaped_space": (r"\\u0020", "Экранированный пробел (\\u0020)"),
    "literal_escaped_newline": (r"\\u000A", "Экранированный перенос строки (\\u000A)"),
    "colon": (r":", ":"),
    "semicolon": (r";", ";"),
    "hyphen": (r"-", "-"),
    "underscore": (r"_", "_"),
    "period": (r"\.", "."),
    "comma": (r",", ","),
    "backslash": (r"\\", "\\"),
    "forward_slash": (r"/", "/"),
    "vertical_bar": (r"\|", "|"),
    "double_quote": (r'"', '"'),
    "single_quote": (r"'", "'"),
    "dollar": (r"\$", "$"),
    "at": (r"@", "@"),
    "hash": (r"#", "#"),
    "asterisk": (r"\*", "*"),
}
# --- end of fixed values ------------------------------------------------------------------

PATTERNS: dict[str, str] = {name: regex for name, (regex, _) in CATALOGUE.items()}
LABELS: dict[str, str] = {name: label for name, (_, label) in CATALOGUE.items()}

# The two entries that match a six-character escape written out in the text; every other
# entry matches exactly one character.
ESCAPE_TOKENS: dict[str, str] = {
    "literal_escaped_space": "\\u0020",
    "literal_escaped_newline": "\\u000A",
}


def known(names: Iterable[str], strict: bool = True) -> list[str]:
    """The names that are in the catalogue; unknown ones raise unless ``strict`` is off."""
    names = list(names)
    unknown = [n for n in names if n not in PATTERNS]
    if unknown and strict:
        raise ValueError(f"unknown pattern names: {unknown}")
    return [n for n in names if n in PATTERNS]


def combine(names: Iterable[str]) -> str | None:
    """One alternation in selection order; ``None`` when nothing known is selected."""
    chosen = known(names, strict=False)
    return "|".join(PATTERNS[n] for n in chosen) or None


def literal_of(name: str) -> str | None:
    """The text a class matches if it matches one fixed text, else ``None`` (a range)."""
    if name in ESCAPE_TOKENS:
        return ESCAPE_TOKENS[name]
    regex = PATTERNS[name]
    if regex.startswith("["):
        return None
    if regex.startswith(r"\u"):
        return chr(int(regex[2:], 16))
    return regex.removeprefix("\\")


@cache
def characters(name: str) -> str:
    """The characters of a single-character class; the catalogue stays below U+0500."""
    regex = re.compile(PATTERNS[name])
    return "".join(ch for ch in map(chr, range(0x500)) if regex.fullmatch(ch))


def any_of(chars: Iterable[str]) -> list[str]:
    """Character classes that together match ``chars``, Latin-1 first.

    Java tests a class of single Latin-1 characters with one table look-up but walks
    through all ranges of a mixed class, so the two are kept apart.
    """
    points = sorted(set(map(ord, chars)))
    low = "".join(f"\\u{p:04x}" for p in points if p < 256)
    wide = ""
    # Neighbours share their distance to their rank, so each group is one range.
    for _, run in groupby(enumerate(p for p in points if p >= 256), key=lambda pair: pair[1] - pair[0]):
        members = [p for _, p in run]
        wide += f"\\u{members[0]:04x}-\\u{members[-1]:04x}"
    return [f"[{body}]" for body in (low, wide) if body]


def run_regex(names: Iterable[str], strict: bool = True) -> str | None:
    """A regex for a longest run of wanted text, equal in effect to repeated :func:`combine` matches.

    Single-character classes merge into one class. An escape token only matters while no
    backslash class stands before it in the selection: once the backslash is taken on its
    own, the rest of the token is judged character by character.
    """
    chosen = known(names, strict)
    if not chosen:
        return None
    tokens = []
    for name in chosen:
        if name == "backslash":
            break
        if name in ESCAPE_TOKENS:
            tokens.append(PATTERNS[name])
    singles = any_of("".join(characters(n) for n in chosen if n not in ESCAPE_TOKENS))
    # Next to a token, classes go one character at a time: the token comes first everywhere.
    return f"(?:{'|'.join([*tokens, *(c if tokens else c + '++' for c in singles)])})++"


def exclusive(name: str) -> str:
    """A regex for the characters of a class that no earlier class of the catalogue has."""
    earlier = "".join(characters(n) for n in takewhile(name.__ne__, PATTERNS) if n not in ESCAPE_TOKENS)
    own = characters(name)
    left = [ch for ch in own if ch not in earlier]
    return PATTERNS[name] if len(left) == len(own) else "|".join(any_of(left))


def label_of(name: str) -> str:
    return LABELS.get(name, name)


def names_of_labels(labels: Iterable[str]) -> list[str]:
    """Catalogue names whose display label is in ``labels``, in catalogue order."""
    wanted = set(labels)
    return [n for n in PATTERNS if LABELS[n] in wanted]


# Classes of letters beyond ASCII.
WIDE = [n for n, regex in PATTERNS.items() if regex.startswith("[\\u")]
COVERED = "".join(characters(n) for n in PATTERNS if n not in ESCAPE_TOKENS)


def escape_java_replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)
