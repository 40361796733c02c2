"""Repeated bytes, benchmark windows, repeated words, near-duplicates, and the rounds below them."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import by_id, pieces, words
from rowscrub.llm import fmindex, neardup, parsing, rounds, substrings
from rowscrub.llm.arrays import text_bytes


@pytest.fixture(params=[1 << 12, 4 << 20], autouse=True)
def chunk_bytes(request, monkeypatch):
    """Many chunks and buckets, and one."""
    monkeypatch.setattr(rounds.in_chunks, "__defaults__", (request.param, False, False))
    if request.param < 1 << 20:
        monkeypatch.setattr(rounds, "BUCKET_KEYS", 500)
    return request.param


def removed_bytes(rows):
    """By id: bytes, removed ones, spans and hash, by comparing all strings."""
    seen, found = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        kept = bytes(b for b, g in zip(data, gone[:-1], strict=True) if not g)
        found[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return found


def removed_words(rows):
    first, found = {}, {}
    for i, text in rows:
        w = pieces(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, text in rows:
        w = pieces(text)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        found[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return found


def test_prefix_free_parsing(documents, texts):
    got = by_id(parsing.removed_strings(documents), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_bytes(list(enumerate(texts)))


def test_kept_bytes(documents):
    for row in parsing.removed_strings(documents).collect():
        assert hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]


def test_phrases_hold_every_string_once(texts):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, counts, triggers = parsing.phrases(data, offsets)
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, counts, strict=True)])
    want = [k for a, b in zip(offsets[:-1], offsets[1:], strict=True) for k in range(a, b - 99)]
    assert at.tolist() == want
    assert all(a + n - 1 <= t <= a + parsing.REACH - 1 for a, n, t in zip(starts, counts, triggers, strict=True))


def test_suffix_ranks():
    data = np.frombuffer(b"abracadabra" * 30, np.uint8)
    text = data.tobytes()
    ranks = parsing.suffix_ranks(data)
    want = sorted({text[i : i + 100].ljust(100, b"\0") for i in range(len(text))})
    assert ranks.tolist() == [want.index(text[i : i + 100].ljust(100, b"\0")) for i in range(len(text))]


def test_difference_cover():
    cover = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))


def test_substrings(documents, texts):
    found = substrings.removed_words(documents, carry=True)
    assert by_id(found, "n_words", "n_removed", "kept_sha256") == removed_words(list(enumerate(texts)))
    for row in found.collect():
        text = texts[row["doc_id"]]
        assert row["rest"]["chunk"] == "c" and row["rest"]["rest"] == row["doc_id"]
        if row["n_removed"] == 0:
            assert row["kept"] == text
        else:
            assert hashlib.sha256(" ".join(pieces(row["kept"])).encode()).hexdigest() == row["kept_sha256"]


@pytest.mark.parametrize("operator", [parsing.removed_strings, substrings.removed_words, neardup.near_duplicates])
def test_odd_tables(operator, odd, empty):
    assert operator(empty).count() == 0
    assert operator(odd).count() == 6


def test_repeated_ids(odd):
    bytes_ = sorted((r["doc_id"] or 99, r["n_removed"]) for r in parsing.removed_strings(odd).collect())
    assert bytes_ == [(3, 0), (3, 149), (3, 149), (9, 149), (99, 0), (99, 149)]
    words_ = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substrings.removed_words(odd).collect())
    assert words_ == [(3, 0), (3, 0), (3, 0), (9, 40), (99, 0), (99, 40)]


def windows(benchmark):
    found = {}
    for item, text in benchmark:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            found.setdefault(tuple(w[k : k + 10]), set()).add("null" if item is None else str(item))
    return found


def test_decontamination(spark, documents, texts):
    long = max((t or "" for t in texts), key=len)
    source = words(long)
    items = [(1, " ".join(source[10:40])), (2, " ".join(source[35:60]).upper()), (10, "a"), (3, None), (4, ""), (None, " ".join(source[100:104])), (2, " ".join(source[200:215]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = windows(items)
    results = []
    for block in (8 << 20, 100):
        got = by_id(fmindex.decontaminated(documents, benchmark, block_bytes=block), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept")
        results.append(got)
        for i, text in enumerate(texts):
            w = words(text)
            hits = [(k, n, known[tuple(w[k : k + n])]) for n in {len(p) for p in known} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known]
            hit = {k + j for k, n, _ in hits for j in range(n)}
            names = sorted(set().union(*(s for _, _, s in hits)))
            assert got[i][:5] == (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
            assert got[i][5] == text if not hit else words(got[i][5]) == [x for k, x in enumerate(w) if k not in hit]
    assert results[0] == results[1]


def test_decontamination_odd_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    assert fmindex.decontaminated(empty, benchmark).count() == 0
    assert sorted(r["n_hit"] for r in fmindex.decontaminated(odd, benchmark).collect()) == [0, 12, 12, 12, 12, 12]
    assert {r["n_hit"] for r in fmindex.decontaminated(odd, benchmark.where("false")).collect()} == {0}


def test_fm_index_finds_all_places():
    draw = np.random.default_rng(3)
    text = draw.integers(0, 4, 500)
    text[-1] = 0
    index = fmindex.FMIndex(text, 3)
    patterns = [(1,), (1, 2), (3, 3, 3), (2, 1, 3, 1), (1, 1, 1, 1, 1, 1)]
    padded = np.zeros((len(patterns), 6), np.int64)
    for row, p in zip(padded, patterns, strict=True):
        row[: len(p)] = p
    low, high = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(documents, texts, block):
    got = {i: c for i, (c,) in by_id(neardup.near_duplicates(documents, block=block), "class_id").items()}
    sets = {}
    for i, text in enumerate(texts):
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i, j in combinations(sets, 2):
        if sets[i] and sets[j]:
            if jaccard(sets[i], sets[j]) >= 0.85:
                assert got[i] == got[j], (i, j)
            elif got[i] == got[j]:
                assert max(jaccard(sets[i], sets[k]) for k in sets if k != i and got[k] == got[i] and sets[k]) >= 0.75
        else:
            assert got[i] != got[j]
    assert all(got[c] == c and c <= i for i, c in got.items())


def test_sampling_estimates_weighted_similarity():
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 1 << 62, 300, dtype=np.uint64)
    weights = draw.uniform(0.9, 3, 300).astype(np.float32)
    other = weights.copy()
    other[:60] *= 2
    samples = neardup.consistent_samples(np.concatenate((keys[:250], keys[30:])), np.concatenate((weights[:250], other[30:])), np.array([0, 250]), 600)
    a, b = np.zeros(300), np.zeros(300)
    a[:250], b[30:] = weights[:250], other[30:]
    assert abs((samples[0] == samples[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.07


def test_blocks_join_across(spark):
    """Classes do not depend on how a group is split into blocks."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        text = list(base)
        for k in range(20):
            text[(i * 9 + k) % 400] = f"x{i}{k}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = by_id(neardup.near_duplicates(frame, block=1000), "class_id")
    assert one == by_id(neardup.near_duplicates(frame, block=4), "class_id")
    assert len(set(one.values())) < 40


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(60) if i % 20 != 19]
    got = neardup.components(spark.createDataFrame(edges, "a binary, b binary")).select(F.hex("node").alias("n"), F.hex("label").alias("l")).collect()
    assert {(int(r["n"], 16), int(r["l"], 16)) for r in got} == {(i, i // 20 * 20) for i in range(60)}
