"""License scan: ordered signature rules behind a keyword test.

The words of a text (ASCII letters lowered) are written with one blank between them, and hundreds of rules are tried on
this form. A rule is a regular expression with a label, a priority and keywords; a text without a keyword of a rule
is never given to its expression. Where two detections overlap, one that lies wholly inside another goes, unless its
priority is higher; of two over the same words the higher priority and then the earlier rule stays.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowscrub.llm.arrays import ALNUM, LOWER, per_document, slices, spans, text_bytes

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
"""Phrases that always count, with their labels."""

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: long, n_words: long>>"
)


class Rule(NamedTuple):
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int


# Names of licenses as their own texts and their usual headers write them: label, name, short identifier, versions.
FAMILIES = (
    ("apache", r"apache(?: software)? license", "apache", ("1 0", "1 1", "2 0")),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "gpl", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "agpl", ("1 0", "3", "3 0")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", r"mozilla public licen[cs]e", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public licen[cs]e", "epl", ("1 0", "2 0")),
    ("cddl", r"common development and distribution licen[cs]e", "cddl", ("1 0", "1 1")),
    ("cpl", r"common public licen[cs]e", "cpl", ("1 0",)),
    ("eupl", r"european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
    ("afl", r"academic free licen[cs]e", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", r"open software licen[cs]e", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", r"artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    ("bsl", r"boost software licen[cs]e", "bsl", ("1 0",)),
    ("zpl", r"zope public licen[cs]e", "zpl", ("1 1", "2 0", "2 1")),
    ("php", r"php licen[cs]e", "php", ("3 0", "3 01")),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[cs]e", "odbl", ("1 0",)),
    ("ofl", r"(?:sil )?open font licen[cs]e", "ofl", ("1 0", "1 1")),
    ("ecl", r"educational community licen[cs]e", "ecl", ("1 0", "2 0")),
    ("cecill", r"cecill(?: free software)? licen[cs]e", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("mspl", r"microsoft public licen[cs]e", "ms pl", ()),
    ("msrl", r"microsoft reciprocal licen[cs]e", "ms rl", ()),
    ("isc", r"isc licen[cs]e", "isc", ()),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", "mit", ()),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa", ()),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ()),
    ("python", r"python software foundation licen[cs]e", "psf", ("2", "2 0")),
    ("upl", r"universal permissive licen[cs]e", "upl", ("1 0",)),
    ("vim", r"vim licen[cs]e", "vim", ()),
    ("bsd", r"bsd(?: [234] clause)?(?: licen[cs]e)", "bsd", ("2 clause", "3 clause", "4 clause")),
)

# How a family is named in texts: suffix of the rule, pattern, priority.
WORDINGS = (
    ("licensed under (?:the )?(?:terms of )?(?:the )?{name}", 4),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 4),
    ("(?:subject to|governed by|pursuant to|according to) (?:the )?(?:terms of )?(?:the )?{name}", 3),
    ("(?:copy|terms|text) of the {name}", 2),
    ("{name}", 1),
)

# Creative Commons elements: label and the words of the element in short and in long form.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Sentences that license texts and notices themselves contain: label, keyword, pattern, priority.
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies", 5),
    ("mit", "software", "the software is provided as is without warranty of any kind express or implied", 3),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 5),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 5),
    ("bsd", "contributors", "neither the name of .{1,80} nor the names of its contributors may be used to endorse", 5),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee", 6),
    ("apache", "compliance", "you may not use this file except in compliance with the license", 6),
    ("apache", "distributed", "unless required by applicable law or agreed to in writing software distributed under the license", 5),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify", 5),
    ("gpl", "version", "either version [0-9]+ of the license or at your option any later version", 5),
    ("gpl", "received", "you should have received a copy of the gnu general public license", 6),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license", 7),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license", 7),
    ("mpl", "subject", "this source code form is subject to the terms of the mozilla public license", 6),
    ("bsl", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy", 6),
    ("zlib", "software", "this software is provided as is without any express or implied warranty in no event", 6),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 6),
    ("wtfpl", "license", "do what the fuck you want to public license", 6),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 3),
    ("cc0", "creative", "creative commons zero", 3),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 3),
    ("public-domain", "domain", "this work is in the public domain", 3),
    ("reserved", "reserved", "all rights reserved", 2),
    ("reserved", "reserves", "tous droits reserves", 2),
    ("reserved", "réservés", "tous droits réservés", 2),
    ("reserved", "reservados", "todos los derechos reservados", 2),
    ("reserved", "vorbehalten", "alle rechte vorbehalten", 2),
    ("proprietary", "confidential", "proprietary and confidential", 4),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution) of this (?:file|work|document|material)", 4),
    ("proprietary", "reproduced", "no part of this (?:publication|work|document|book) may be reproduced", 4),
    ("proprietary", "permission", "may not be (?:copied|reproduced|redistributed|published) without (?:prior |express )*(?:written )?permission", 4),
    ("non-commercial", "use", "for (?:non ?commercial|personal) use only", 3),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 1),
    ("copyright", "©", "© (?:19|20)[0-9][0-9]", 1),
)


def _versions(versions: tuple[str, ...]) -> Iterator[str]:
    for version in versions:
        yield rf"(?: (?:version|v))? v?{version}(?: (?:only|or later))?"


@functools.cache
def rules() -> tuple[Rule, ...]:
    """The rules in order: families by wording and version, identifiers, Creative Commons, sentences."""
    found: list[Rule] = []
    for label, name, short, versions in FAMILIES:
        key = ("license", "licence")
        for wording, priority in WORDINGS:
            found.append(Rule(label, wording.format(name=name), key, priority))
        for version in _versions(versions):
            found.append(Rule(label, name + version, key, 5))
            found.append(Rule(label, rf"(?:spdx license identifier )?{short}{version}", (short.split()[0],), 2))
        found.append(Rule(label, rf"spdx license identifier {short}", ("spdx",), 6))
    for label, short, long in COMMONS:
        found.append(Rule(label, f"cc {short}", ("cc",), 2))
        found.append(Rule(label, f"creative commons {long}", ("creative",), 3))
        found.append(Rule(label, f"creativecommons org licenses {short}", ("creativecommons",), 4))
        for version in COMMONS_VERSIONS:
            found.append(Rule(label, f"cc {short} {version}", ("cc",), 3))
            found.append(Rule(label, f"creative commons {long}(?: international| unported)? {version}", ("creative",), 4))
            found.append(Rule(label, f"creativecommons org licenses {short} {version}", ("creativecommons",), 5))
    for label, keyword, sentence, priority in SENTENCES:
        found.append(Rule(label, sentence, (keyword,), priority))
    return tuple(found)


class Scanner:
    """Keyword automaton and compiled rules."""

    def __init__(self) -> None:
        self.rules = rules()
        self.compiled = [re.compile(rf"(?<= )(?:{rule.pattern})(?= )") for rule in self.rules]
        by_word: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in rule.keywords:
                by_word.setdefault(word, []).append(i)
        for phrase, _ in BASE:
            by_word.setdefault(max(phrase.split(), key=len), [])
        self.automaton = ahocorasick.Automaton()
        for word, which in by_word.items():
            self.automaton.add_word(f" {word} ", tuple(which))
        self.automaton.make_automaton()
        self.bases = [(label, re.compile(f"(?<= ){re.escape(phrase)}(?= )"), len(phrase.split())) for phrase, label in BASE]

    def candidates(self, raw: str) -> set[int] | None:
        """Rules with a keyword among the words of the text; None without a keyword of any rule or base phrase."""
        hits = {which for _, which in self.automaton.iter(f" {raw} ")}
        return {i for which in hits for i in which} if hits else None

    def detections(self, normal: str, blanks: list[int], which: set[int]) -> list[tuple[int, int, int]]:
        """(first word, words, rule) of what stays after suppression, by place."""
        found = []
        for i in sorted(which):
            for match in self.compiled[i].finditer(normal):
                found.append((bisect_left(blanks, match.start()) - 1, match.group().count(" ") + 1, i))
        return suppressed(found, [rule.priority for rule in self.rules])

    def base(self, normal: str, blanks: list[int]) -> list[tuple[int, int, str]]:
        found = []
        for label, pattern, n in self.bases:
            found += [(bisect_left(blanks, m.start()) - 1, n, label) for m in pattern.finditer(normal)]
        return sorted(found)


def suppressed(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Leave out each detection inside another one of the same or a higher priority; of equals the first rule stays."""
    kept = []
    for level in sorted({priority[i] for _, _, i in found}):
        reach = -1
        for first, n, i in sorted((d for d in found if priority[d[2]] >= level), key=lambda d: (d[0], -d[1], -priority[d[2]], d[2])):
            if priority[i] == level and first + n > reach:
                kept.append((first, n, i))
            reach = max(reach, first + n)
    return sorted(kept)


def license_scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with base counts, labels, a score and the detected spans.

    Null and empty texts have no words, no labels and score 0. Repeated rows give a row each; other columns are not
    carried. `labels` holds the base labels and those of all rules that stay, distinct, sorted and comma-joined;
    `score` is 1 - 2 ** -(sum of priorities / 4) over what stays, base phrases counting 2 each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            lowered = LOWER[data]
            inside = ALNUM[lowered]
            starts, _ = spans(inside, offsets)
            firsts = per_document(starts, offsets)
            flat = np.where(inside, lowered, np.uint8(32)).tobytes()
            rows = []
            for d, doc in enumerate(batch.column("doc_id").to_pylist()):
                n_words = int(firsts[d + 1] - firsts[d])
                raw = flat[offsets[d] : offsets[d + 1]].decode("utf-8")
                which = scanner.candidates(raw) if n_words else None
                base, found = [], []
                if which is not None:
                    normal = re.sub(" +", " ", f" {raw} ")
                    blanks = [m.start() for m in re.finditer(" ", normal)]
                    base, found = scanner.base(normal, blanks), scanner.detections(normal, blanks, which)
                base_labels = {label for _, _, label in base}
                labels = base_labels | {scanner.rules[i].label for _, _, i in found}
                weight = 2 * len(base) + sum(scanner.rules[i].priority for _, _, i in found)
                rows.append(
                    {
                        "doc_id": doc,
                        "n_words": n_words,
                        "n_base": len(base),
                        "first_word": base[0][0] if base else None,
                        "last_word": max(first for first, _, _ in base) if base else None,
                        "base_labels": ",".join(sorted(base_labels)),
                        "labels": ",".join(sorted(labels)),
                        "score": 1 - 2 ** -(weight / 4),
                        "spans": [{"label": scanner.rules[i].label, "first_word": first, "n_words": n} for first, n, i in found],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(scan, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))),
    ]
)
