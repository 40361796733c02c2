"""Token counts at every prefix, and token ids, for a byte-level BPE vocabulary file of `tokenizers`.

The file's merges are in rank order, so `tiktoken` gives the same ids from the vocabulary read as ranks; it does so for
texts of characters up to U+024F and common punctuation, which both libraries class alike, and `tokenizers` itself does so
for all others. The special string in a text becomes its id, as `tokenizers` does by default.

Prefix counts: a text is cut into pieces by the tokenizer's own pattern. For a piece, dynamic programming over its
prefixes finds the last token of each: the one suffix that is a token and that BPE keeps apart from the last token of
the prefix before it. One more than the count of that prefix is the count. Pieces repeat, so results are kept in the worker.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowscrub.llm.arrays import slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""The splitting rule of this kind of vocabulary (a fixed value)."""

PLAIN = re.compile("[\x00-ɏ‐-‧‰-›€]*")
KEPT_PIECES = 300_000  # pieces that a worker remembers before it starts anew
SHORT = 64  # characters of a piece that is remembered


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class KnownSteps(dict):
    """Steps of pieces, worked out when first asked for."""

    def __init__(self, work_out: Callable[[str], bytes]) -> None:
        super().__init__()
        self.work_out = work_out

    def __missing__(self, piece: str) -> bytes:
        found = self.work_out(piece)
        if len(self) >= KEPT_PIECES:
            self.clear()
        if len(piece) <= SHORT:
            self[piece] = found
        return found


class Vocabulary:
    """One tokenizer file in the forms that counting and encoding need."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        as_byte = _byte_characters()
        self.special = {token["content"]: token["id"] for token in data["added_tokens"]}
        self.ranks = {bytes(as_byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        self.words = {i: token for token, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.split = regex.compile(PATTERN).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else re.compile("((?!))")
        self.apart: dict[int, bool] = {}
        self.known = KnownSteps(self.steps)

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return np.frombuffer(self.encoding._core_bpe.encode_to_tiktoken_buffer(text, set(self.special)), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if PLAIN.fullmatch(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def stay_apart(self, left: int, right: int) -> bool:
        key = left * 65536 + right
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= 2 * KEPT_PIECES:
                self.apart.clear()
            found = self.apart[key] = self.encoding._core_bpe.encode_single_piece(self.words[left] + self.words[right]) == [left, right]
        return found

    def counts(self, piece: bytes) -> list[int]:
        """Number of tokens of every prefix of a piece, from none to all."""
        ranks, apart, longest = self.ranks.get, self.apart.get, self.longest
        lasts, counts, begin = [-1], [0], 0
        for end in range(1, len(piece) + 1):
            # Exactly one suffix is the last token; most often it is the one before, grown by a byte.
            token = ranks(piece[begin:end])
            if token is None or (begin and not self.stay_apart(lasts[begin], token)):
                for begin in range(max(0, end - longest), end):
                    token = ranks(piece[begin:end])
                    if token is not None:
                        if not begin:
                            break
                        known = apart(lasts[begin] * 65536 + token)
                        if known or (known is None and self.stay_apart(lasts[begin], token)):
                            break
            lasts.append(token)
            counts.append(counts[begin] + 1)
        return counts

    def steps(self, piece: str) -> bytes:
        """What each character of a piece adds to the count, as signed bytes."""
        data = piece.encode()
        counts = self.counts(data)
        if len(data) > len(piece):
            counts = [n for i, n in enumerate(counts) if i == len(data) or data[i] & 0xC0 != 0x80]
        if piece in ("'re", "'ve", "'ll"):
            counts[2] = 2  # a prefix of two characters is not a contraction yet
        return bytes([b - a & 0xFF for a, b in pairwise(counts)])

    def _segment(self, text: str) -> np.ndarray:
        """What each character of a text without special strings adds."""
        added = np.frombuffer(b"".join(map(self.known.__getitem__, self.cut(text))), np.int8).astype(np.int32)
        # A prefix that ends behind a run of white space has the whole run as one piece; with the next character the last
        # blank of the run leaves it.
        for run in BLANKS.finditer(text):
            whole = int(np.frombuffer(self.steps(run.group()), np.int8).sum())
            parts = int(added[run.start() : run.end()].sum())
            added[run.end() - 1] += whole - parts
            added[run.end()] += parts - whole
        return added

    def prefix_steps(self, text: str) -> np.ndarray:
        """What each character of a text adds to the token count of the prefix that ends with it."""
        if not self.special or not any(s in text for s in self.special):
            return self._segment(text)
        found, before = [], ""
        for part in self.at_special.split(text):
            if part in self.special:
                # Unfinished special strings are ordinary text behind what came before.
                base = int(self._segment(before).sum())
                open_ = [int(self._segment(before + part[:i]).sum()) - base for i in range(1, len(part))]
                found.append(np.diff([0, *open_, 1]).astype(np.int32))
                before = ""
            else:
                found.append(self._segment(part))
                before = part
        return np.concatenate(found)


BLANKS = re.compile(r"[^\S\x1c-\x1f]{2,}(?=[\S\x1c-\x1f])")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def prefix_token_counts(documents: DataFrame, path: str, limit: int = 1024, keep_prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and the counts at every prefix of every document.

    `path` is the tokenizer file on every machine. Null and empty texts count 0. `prefixes` holds one signed step for each
    character, two bytes each, read by `tokens_of_prefix` and `longest_prefix`; `keep_prefixes=False` leaves the column
    out. Repeated rows give a row each; other columns are not carried.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"] + ["prefixes"] * keep_prefixes
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", prefixes binary" * keep_prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            steps = [words.prefix_steps(text) for text in texts]
            totals = np.array([int(s.sum()) for s in steps], np.int64)
            columns = [
                batch.column("doc_id"),
                pa.array([len(text.encode()) for text in texts], pa.int64()),
                pa.array(totals),
                pa.array(totals > limit),
            ]
            if keep_prefixes:
                columns.append(pa.array([s.astype("<i2").tobytes() for s in steps], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(count, schema)


def tokens_of_prefix(prefixes: Column, characters: Column) -> Column:
    """Tokens of the first `characters` characters; all of them if there are fewer. Null gives null."""

    @F.pandas_udf("long")
    def answer(stored: pd.Series, upto: pd.Series) -> pd.Series:
        known = stored.notna() & upto.notna()
        return pd.Series([int(np.frombuffer(s, "<i2")[: max(int(n), 0)].sum()) if k else None for s, n, k in zip(stored, upto, known, strict=True)], dtype="Int64")

    return answer(prefixes, characters.cast("long"))


def longest_prefix(prefixes: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens. Null gives null."""

    @F.pandas_udf("long")
    def answer(stored: pd.Series, most: pd.Series) -> pd.Series:
        def longest(s: bytes, n: int) -> int:
            fits = np.flatnonzero(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64) <= n)
            return int(fits[-1]) + 1 if len(fits) else 0

        known = stored.notna() & most.notna()
        return pd.Series([longest(s, int(n)) if k else None for s, n, k in zip(stored, most, known, strict=True)], dtype="Int64")

    return answer(prefixes, budget.cast("long"))
