"""Quality rules: text statistics, and robust outliers among them per language and source.

Each document's statistics become a vector of transformed numbers. For every language and source the
minimum-covariance-determinant estimate of centre and covariance is found by concentration steps: from each of three
starts, at the medians and at both quartiles, the half of the rows that lies nearest by Mahalanobis distance gives the next
centre and covariance, until the determinant stops falling. The start that ends at the least one counts. A document
whose distance to the final estimate exceeds a bound is rejected. A group of few rows is judged by the estimate of all
rows of its language, and if these are few too, by the estimate of all rows.

Rows are never gathered: a step adds up, for each group and distance class, counts, sums and products, inside the tasks
before any shuffle, and a group's next estimate is worked out from these at most `CLASSES` rows. The numbers are
fixed-point integers, so that sums, and with them the verdicts, do not depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscrub.llm.arrays import (
    MULTIPLIER,
    NON_SPACE,
    U64,
    _ascii,
    covered,
    hash_spans,
    mixed,
    per_document,
    slices,
    spans,
    text_bytes,
    window_hashes,
    window_starts,
)
from rowscrub.session import via_table

SYMBOLS = _ascii("#*$%&|<>")
MIN_WORDS = 50
MAX_REPEAT = 50  # percent of the words

UNIT = 1000  # a fixed-point one
QUANTILES = (0.5, 0.25, 0.75)  # of the numbers, as centres to start from
LEAST_FALL = 1e-6  # a fall of the determinant's logarithm that calls for another step
CLASSES = 256  # distance classes of a group
LEAST_ROWS = 100  # a smaller group has too few rows for an estimate of its own
POOLS = ("group", "language", "everything")  # whose estimate judges a row: the first that has one
FLOOR = (0.35, 0.12, 0.7, 0.35, 0.7)  # least standard deviation of each number; each can exceed the bound by itself

VECTOR = ("v0", "v1", "v2", "v3", "v4")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _radii() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of normal rows from their centre, with the density and the share of the rows within each."""
    r = np.linspace(0, 12, 24001)
    density = r ** (len(VECTOR) - 1) * np.exp(-r * r / 2)
    return r, density / density.sum(), np.cumsum(density) / density.sum()


def chi_bound(share: float) -> float:
    """The distance within which `share` of normal rows lie: root of the chi-square quantile, a degree of freedom a number."""
    r, _, mass = _radii()
    return float(r[np.searchsorted(mass, share)])


BOUND = chi_bound(0.999)  # distance beyond which a vector is an outlier


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\v\f\r"))


def text_statistics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The statistics of each text of one slice; null counts as empty."""
    data, offsets = text_bytes(batch.column("text"))
    inside = NON_SPACE[data]
    starts, ends = spans(inside, offsets)
    firsts = per_document(starts, offsets)
    chars = np.concatenate(([0], np.cumsum(inside & ((data & 0xC0) != 0x80))))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    words = hash_spans(data, starts, ends)
    at = window_starts(firsts, 3)
    document = np.searchsorted(firsts, at, "right") - 1
    keys = mixed(window_hashes(words, 3)[at] + document.astype(U64) * MULTIPLIER) if len(at) else np.zeros(0, U64)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeat = np.concatenate(([0], np.cumsum(covered(at[twice], 3, len(words)))))
    duplicates = []
    for text in batch.column("text").to_pylist():
        lines = [line for line in text.split("\n") if _has_word(line)] if text else []
        duplicates.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(firsts),
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.array(duplicates, np.int64),
        "n_repeat_words": repeat[firsts[1:]] - repeat[firsts[:-1]],
    }


def quality_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every document."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{name} long" for name in STATISTICS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [pa.array(values.astype(np.int64)) for values in text_statistics(batch).values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *found], ["doc_id", "lang", "source", *STATISTICS])

    chosen = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang", "cast(source as string) source")
    return chosen.mapInArrow(count, schema)


def _vector() -> list[Column]:
    """Logarithms of the length, of the mean word length, and of the shares of symbols, repeated lines and words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    numbers = [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]
    return [F.round(UNIT * number).cast("long").alias(name) for name, number in zip(VECTOR, numbers, strict=True)]


def _distance() -> Column:
    """Squared Mahalanobis distance from the centre, by its inverse covariance."""
    apart = [F.col(v) / UNIT - F.col("centre")[i] for i, v in enumerate(VECTOR)]
    n = len(VECTOR)
    terms = [apart[i] * apart[j] * F.col("inverse")[i * n + j] for i in range(n) for j in range(n)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


SALTS = (32, 512, 512)  # tasks that share the rows of one pool where these meet its estimate, by level


def _pooled(statistics: DataFrame) -> DataFrame:
    """The rows that pass the base rules, once for each pool that needs an estimate: its key, level and number of rows.

    These are the groups of `LEAST_ROWS` rows, the languages of as many rows that have a smaller group, and, if a language
    is smaller, everything.
    """
    sound = statistics.where(~F.col("base_failed"))
    counts = via_table(sound.groupBy("group", "language", "everything").agg(F.count(F.lit(1)).alias("n")), "counts")
    languages = counts.groupBy("language", "everything").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    total = languages.groupBy("everything").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    enough = F.col("n") >= LEAST_ROWS
    needed = [counts.where(enough), languages.where(enough & (F.col("least") < LEAST_ROWS)), total.where(F.col("least") < LEAST_ROWS)]
    pools = [found.select(F.col(name).alias("pool"), F.lit(level).alias("level"), "n") for level, (name, found) in enumerate(zip(POOLS, needed, strict=True))]
    keys = [F.struct(F.col(name).alias("pool"), F.pmod(F.xxhash64("doc_id", *VECTOR), F.lit(salts)).cast("int").alias("salt")) for name, salts in zip(POOLS, SALTS, strict=True)]
    rows = sound.select(F.explode(F.array(*keys)).alias("key"), *VECTOR).select("key.*", *VECTOR)
    return via_table(_beside(rows, pools[0].unionByName(pools[1]).unionByName(pools[2])).select("pool", "level", "n", "salt", *VECTOR), "pooled")


def _beside(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The rows of every pool with its estimate. A pool is dealt to several tasks, so that its rows are added up there first."""
    salts = F.get(F.array(*map(F.lit, SALTS)), F.col("level"))
    spread = estimate.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.join(spread, ["pool", "salt"])


def _start(vectors: DataFrame) -> DataFrame:
    """The first estimates of every pool: centres at the medians and quartiles, and the median deviations as scale."""
    quantiles = vectors.groupBy("pool", "level", "n").agg(*(F.percentile(v, F.array(*map(F.lit, QUANTILES))).alias(f"q_{v}") for v in VECTOR))
    spread = (
        _beside(vectors.drop("level", "n"), quantiles)
        .groupBy("pool", "level", "n")
        .agg(*(F.first(f"q_{v}").alias(f"q_{v}") for v in VECTOR), *(F.percentile(F.abs(F.col(v) - F.col(f"q_{v}")[0]), 0.5).alias(v) for v in VECTOR))
    )
    size = len(VECTOR)
    scale = [F.pow(F.greatest(1.4826 * F.col(v) / UNIT, F.lit(FLOOR[i])), F.lit(-2.0)) for i, v in enumerate(VECTOR)]
    flat = [scale[i] if i == j else F.lit(0.0) for i in range(size) for j in range(size)]
    starts = spread.withColumn("start", F.explode(F.array(*map(F.lit, range(len(QUANTILES))))))
    centre = F.array(*(F.get(f"q_{v}", F.col("start")) / UNIT for v in VECTOR))
    return starts.select("pool", "level", "n", "start", centre.alias("centre"), F.array(*flat).alias("inverse"), F.lit(math.inf).alias("logdet"), F.lit(False).alias("done"))


def _consistency(share: float) -> float:
    """Factor by which the covariance of the nearest `share` of normal rows is too small, by simulation-free integration."""
    r, density, mass = _radii()
    edge = np.searchsorted(mass, share)
    return share * len(VECTOR) / float((r[:edge] ** 2 * density[:edge]).sum()) if share < 1 else 1.0


def _concentrate(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """The next estimates: mean and covariance of the half of each pool that lies nearest to these.

    One whose determinant does not fall any more stays as it is and is done.
    """
    size = len(VECTOR)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)]
    products = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}_{j}") for i, j in pairs]
    class_of = F.least(F.floor(16 * F.log1p(4 * F.col("d2"))), F.lit(CLASSES - 1)).cast("int")
    summed = (
        _beside(vectors.drop("level", "n"), estimate)
        .withColumn("d2", _distance())
        .groupBy("pool", "start", class_of.alias("class"))
        .agg(*(F.first(c).alias(c) for c in ("level", "n", "centre", "inverse", "logdet")), F.count(F.lit(1)).alias("rows"), *sums, *products)
    )

    names = estimate.columns

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        n = int(rows["n"].iloc[0])
        half = (n + size + 1) // 2
        upto = int(np.searchsorted(rows["rows"].cumsum().to_numpy(), min(half, n))) + 1
        near = rows.iloc[:upto]
        m = int(near["rows"].sum())
        mean = [int(near[f"s{i}"].sum()) / m for i in range(size)]
        covariance = np.zeros((size, size))
        for i, j in pairs:
            exact = int(near[f"p{i}_{j}"].sum()) / m - mean[i] * mean[j]
            covariance[i, j] = covariance[j, i] = exact / UNIT**2
        covariance = covariance * _consistency(m / n) + np.diag(np.square(FLOOR)) * 0.5
        low = np.maximum(np.square(FLOOR) / np.diag(covariance), 1.0)
        covariance = covariance * np.sqrt(np.outer(low, low))
        old = rows.iloc[0]
        logdet = float(np.linalg.slogdet(covariance)[1])
        done = not logdet < old["logdet"] - LEAST_FALL
        if done:
            centre, inverse, logdet = old["centre"], old["inverse"], old["logdet"]
        else:
            centre, inverse = [x / UNIT for x in mean], np.linalg.inv(covariance).ravel()
        values = (old["pool"], old["level"], n, old["start"], list(centre), list(inverse), logdet, done)
        return pd.DataFrame({name: [value] for name, value in zip(names, values, strict=True)})

    return summed.groupBy("pool", "start").applyInPandas(step, estimate.schema)


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Centre and inverse covariance of every pool: of the ends that its starts come to, the one of the least determinant."""
    estimate = via_table(_start(vectors), "estimate")
    while not estimate.where(~F.col("done")).isEmpty():
        ended = estimate.where("done")
        estimate = via_table(_concentrate(vectors, estimate.where(~F.col("done"))).unionByName(ended), "estimate")
    best = F.min(F.struct("logdet", "start", "centre", "inverse")).alias("best")
    return via_table(estimate.groupBy("pool", "level").agg(best).select("pool", "level", "best.*"), "estimate")


def quality_outliers(documents: DataFrame, bound: float = BOUND) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the distance from the estimate of the document's language and source.

    Null texts have no words. Null languages and sources form groups of their own. A group below `LEAST_ROWS` rows is judged
    by the estimate of its language, one of a language below as many by that of all documents, however few. The distance is
    null only for documents that fail a base rule and have no estimate to be held against. Repeated rows count and are judged
    each. An empty table gives an empty result. Documents that fail a base rule take no part in the estimates.
    """
    keys = [(0, "lang", "source"), (1, "lang"), (2,)]
    grouped = quality_statistics(documents).select(
        "doc_id",
        *STATISTICS,
        *(F.xxhash64(F.lit(level), *(x for c in columns for x in (F.isnull(c), F.col(c)))).alias(name) for name, (level, *columns) in zip(POOLS, keys, strict=True)),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        *_vector(),
    )
    judged = via_table(grouped, "statistics")
    estimate = robust_estimates(_pooled(judged))
    for level, name in enumerate(POOLS):
        judged = judged.join(estimate.where(F.col("level") == level).select(F.col("pool").alias(name), F.struct("centre", "inverse").alias(f"by_{name}")), name, "left")
    judged = judged.select("*", F.coalesce(*(f"by_{name}" for name in POOLS)).alias("by")).select("*", "by.*").withColumn("distance", F.sqrt(_distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= bound)
    return judged.select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), "distance")
