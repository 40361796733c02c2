"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts per language inside the tasks, one vector for each task and language, and then over the
tasks. The matrix of log probabilities has one row for each learned language and is sent to the tasks; its size is bounded by
`MOST_LANGUAGES` times `FEATURES`. Scoring adds the rows' entries over the n-grams of a batch of texts with numpy.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscrub.llm.arrays import slices

FEATURES = 1 << 15
"""Hash buckets of n-grams."""
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
TEXT_BYTES = 1 << 20
"""Text bytes whose n-grams are held at once: they take about a hundred bytes a character."""
MOST_LANGUAGES = 512
"""More distinct languages in the training rows raise an error; the matrix then has 64 MB."""
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and unicodedata.category(c)[0] != "L" and not c.isdecimal())
"""Fractions, Roman numerals and the like, which `\\w` takes for word characters; letters are Unicode's category L alone."""
BLANKED = dict.fromkeys(map(ord, NUMERALS), " ")


def prepared(text: str | None) -> str:
    """The text in lower case with one blank for each run of non-letters and at both ends; empty without a letter."""
    if text and not text.isascii() and not NUMERALS.isdisjoint(text):
        text = text.translate(BLANKED)
    return OTHER.sub(" ", f" {text.lower()} ") if text and LETTER.search(text) else ""


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and for each the text's number. No n-gram crosses texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.repeat(np.cumsum(lengths), lengths)
    document = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(points))
    buckets, owners = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if n > len(points):
            break
        code = code[: len(points) - n + 1] * np.uint64(0x1F123BB5) + points[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            whole = place[: len(code)] + n <= ends[: len(code)]
            h = code[whole] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((h >> np.uint64(40)).astype(np.int64) & (FEATURES - 1))
            owners.append(document[: len(code)][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def train(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log probabilities, from text and lang of the rows given (null lang: none).

    Counts come from all rows. They reach the driver as one vector for each language.
    """
    labelled = documents.where("lang is not null and text is not null").selectExpr("cast(text as string) text", "cast(lang as string) lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=TEXT_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array([prepared(t) for t in batch.column("text").to_pylist()], object)
            for lang in set(langs.tolist()):
                found, _ = features(texts[langs == lang].tolist())
                total = totals.setdefault(lang, np.zeros(FEATURES, np.int64))
                total += np.bincount(found, minlength=FEATURES)
            if len(totals) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        if totals:
            # In parts, so that the sums over tasks are spread and no row is large.
            parts = FEATURES // PART
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang in totals for _ in range(parts)]),
                    pa.array([p for _ in totals for p in range(parts)], pa.int32()),
                    pa.array([total[p * PART : (p + 1) * PART].tobytes() for total in totals.values() for p in range(parts)], pa.binary()),
                ],
                ["lang", "part", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
        return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    partial = labelled.mapInArrow(count, "lang string, part int, counts binary")
    summed = partial.groupBy("lang", "part").applyInArrow(add, "lang string, part int, counts binary").collect()
    langs = sorted({row.lang for row in summed})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the bound is {MOST_LANGUAGES}")
    counts = np.full((len(langs), FEATURES), SMOOTHING)
    for row in summed:
        counts[langs.index(row.lang), row.part * PART : (row.part + 1) * PART] += np.frombuffer(row.counts, np.int64)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


PART = 4096  # features of one row of counts


class Model:
    """The learned languages and their log probabilities, as the tasks use them."""

    def __init__(self, langs: list[str], matrix: np.ndarray) -> None:
        self.langs, self.matrix = langs, np.ascontiguousarray(matrix)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = [prepared(t) for t in column.to_pylist()]
        known = np.array([bool(t) and bool(self.langs) for t in texts], bool)
        found, owners = features(texts)
        logs = np.zeros((len(texts), max(len(self.langs), 1)))
        for i, row in enumerate(self.matrix):
            logs[:, i] = np.bincount(owners, row[found], minlength=len(texts))
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0)


def identify(documents: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every document; `und` with score 0 if the text is null or has no letter.

    Without any learned language every document is `und`. The score is the posterior probability under equal priors; ties go
    to the first language in alphabetical order.
    """
    sent = documents.sparkSession.sparkContext.broadcast(Model(langs, matrix))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            found, scores = sent.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    chosen = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return chosen.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def with_language(documents: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """The documents, unchanged and with all their columns, that are in one of the learned languages."""
    sent = documents.sparkSession.sparkContext.broadcast(Model(langs, matrix))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            yield batch.filter(pa.array([lang != UNKNOWN for lang in sent.value.predict(batch.column("text"))[0]], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def held_out_fold(folds: int) -> Column:
    """Fold 0 of the documents, which is not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def language_id(documents: DataFrame, folds: int = 5) -> DataFrame:
    """Learn on all folds but the first, predict every document: doc_id, held_out, lang_pred and score.

    The fold is crc32 of doc_id as text modulo `folds`; a null doc_id counts as fold 0. Only text and non-null lang are used for
    learning, only text for predicting. Repeated rows count and are predicted each.
    """
    langs, matrix = train(documents.where(~held_out_fold(folds)))
    return identify(documents, langs, matrix).select("doc_id", held_out_fold(folds).alias("held_out"), "lang_pred", "score")
