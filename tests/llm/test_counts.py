"""License scan, quality rules, language, tokens, packing, preference pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.conftest import by_id, pieces, words
from rowscrub.llm.chat import conversations, parroted, preference_pairs
from rowscrub.llm import langid, packing
from rowscrub.llm.langid import language_id
from rowscrub.llm.licenses import Scanner, license_scan, rules, suppressed
from rowscrub.llm.packing import best_fit, complete, pack, pack_documents
from rowscrub.llm.quality import chi_bound, quality_outliers, robust_estimates
from rowscrub.llm.tokens import longest_prefix, prefix_token_counts, tokens_of_prefix, vocabulary


def test_license_base_places(spark):
    texts = [None, "", "CC BY", "xcc by cc byx", "CC-BY cc   by\ncc by", "All rights reserved. GENERAL public, license! all rights", "cc by cc by cc " * 200]
    got = by_id(license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "n_words", "n_base", "first_word", "last_word", "base_labels")
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for i, text in enumerate(texts):
        found = words(text)
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(found)) if tuple(found[k : k + len(p)]) == p)
        ends = (at[0][0], at[-1][0]) if at else (None, None)
        assert got[i] == (len(found), len(at), *ends, ",".join(sorted({label for _, label in at})))


def test_license_labels(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "licensed under CC BY-NC 4.0", "nothing here"]
    got = by_id(license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "labels", "score")
    assert [got[i][0] for i in range(4)] == ["apache", "mit", "cc-by,cc-by-nc", ""]
    assert got[3][1] == 0 and all(0 < got[i][1] <= 1 for i in range(3))


def test_license_rules():
    assert len(rules()) > 300
    assert all(rule.keywords for rule in rules())
    scanner = Scanner()
    for rule in rules():  # no text without one of its keywords matches a rule
        assert any(k in rule.pattern or k in ("license", "licence") for k in rule.keywords), rule
    assert scanner.candidates("nothing of the kind") is None


def test_suppression():
    priority = [1, 1, 5]
    assert suppressed([(0, 5, 0), (1, 2, 1), (4, 3, 1)], priority) == [(0, 5, 0), (4, 3, 1)]
    assert suppressed([(0, 5, 0), (1, 2, 2)], priority) == [(0, 5, 0), (1, 2, 2)]
    assert suppressed([(0, 5, 0), (0, 5, 1)], priority) == [(0, 5, 0)]


def test_license_odd_tables(documents, odd, empty):
    assert license_scan(empty).count() == 0 and license_scan(odd).count() == 6
    assert license_scan(documents).count() == documents.count()


def test_quality_statistics(documents, texts):
    got = by_id(quality_outliers(documents), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text in enumerate(texts):
        found = pieces(text)
        lines = [line for line in (text or "").split("\n") if pieces(line)]
        grams = Counter(tuple(found[k : k + 3]) for k in range(len(found) - 2))
        inside = {k + j for k in range(len(found) - 2) if grams[tuple(found[k : k + 3])] > 1 for j in range(3)}
        failed = len(found) < 50 or 100 * len(inside) > 50 * len(found)
        want = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed)
        assert got[i][:6] == want
        assert not (failed and got[i][6])


def test_quality_outliers_rejected(spark):
    draw = random.Random(1)
    rows = []
    for i in range(400):
        n = draw.randint(80, 300)
        junk = i % 40 == 0
        rows.append((i, " ".join("w%d" % draw.randrange(10**6) + ("###" if junk else "") for _ in range(n)), "en", "s"))
    got = by_id(quality_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept")
    assert {i for i, (kept,) in got.items() if not kept} == set(range(0, 400, 40))


QUALITY = "doc_id long, text string, lang string, source string"


def fresh(draw, n):
    """n words that hardly ever repeat."""
    return ["w%d" % draw.randrange(10**6) for _ in range(n)]


def odd_in_one(draw):
    """A text each that is odd in repeated lines, in repeated words, and in one or two symbols a word, alone."""
    lines = "\n".join(line for word in fresh(draw, 90) for line in (word, "-"))
    again = fresh(draw, 45)
    repeated = " ".join(again + fresh(draw, 100) + again)
    return [lines, repeated, *(" ".join(word + sign for word in fresh(draw, 150)) for sign in ("#", "#|"))]


def test_quality_odd_in_one_statistic(spark):
    draw = random.Random(11)
    rows = [(i, " ".join(fresh(draw, draw.randint(80, 300))), "en", "s") for i in range(400)]
    rows += [(1000 + i, text, "en", "s") for i, text in enumerate(odd_in_one(draw))]
    got = by_id(quality_outliers(spark.createDataFrame(rows, QUALITY)), "base_failed", "kept")
    assert not any(got[1000 + i][0] for i in range(4))
    assert [i for i, (_, kept) in got.items() if not kept and i < 1000] == []
    assert [got[1000 + i][1] for i in range(4)] == [False] * 4


def test_quality_small_groups(spark):
    draw = random.Random(12)

    def text(i):
        return " ".join(word + ("###" if i % 20 == 0 else "") for word in fresh(draw, draw.randint(80, 300)))

    rows = [(i, text(i), "en", f"s{i % 40}") for i in range(200)]  # five rows a source
    rows += [(i, text(i), [None, "de", "fr"][i % 3], None) for i in range(200, 260)]  # twenty rows a language
    got = by_id(quality_outliers(spark.createDataFrame(rows, QUALITY)), "kept", "distance")
    assert {i for i, (kept, _) in got.items() if not kept} == set(range(0, 260, 20))
    assert all(distance is not None for _, distance in got.values())
    few = by_id(quality_outliers(spark.createDataFrame(rows[1:12] + rows[:1], QUALITY)), "kept")
    assert {i for i, (kept,) in few.items() if not kept} == {0}


def test_quality_estimate_of_the_least_determinant(spark):
    """Two clusters, where steps from the medians alone end at the half with a log-determinant of 5.26."""
    draw, n = np.random.default_rng(182), 1000
    one = int(n * draw.uniform(0.4, 0.6))
    near, wide, apart = draw.uniform(0.1, 1, 5), draw.uniform(0.1, 3, 5), draw.uniform(0, 8, 5)
    values = np.r_[draw.normal(0, 1, (one, 5)) * near + 8, draw.normal(0, 1, (n - one, 5)) * wide + 8 + apart * np.sign(draw.normal(size=5))]
    rows = [(1, 0, n, 0, *row) for row in np.round(1000 * values).astype(int).tolist()]
    vectors = spark.createDataFrame(rows, "pool long, level int, n long, salt int, v0 long, v1 long, v2 long, v3 long, v4 long")
    found = robust_estimates(vectors).collect()
    assert len(found) == 1 and -np.linalg.slogdet(np.array(found[0]["inverse"]).reshape(5, 5))[1] < 2


def test_quality_bound():
    assert abs(chi_bound(0.999) ** 2 - 20.515) < 0.02 and abs(chi_bound(0.975) ** 2 - 12.833) < 0.02


def test_quality_odd_tables(odd, empty):
    assert quality_outliers(empty).count() == 0
    assert [r["kept"] for r in quality_outliers(odd).collect()] == [False] * 6


def test_language_held_out(spark):
    draw = random.Random(2)
    syllables = {"a": ["ba", "ko", "ti"], "b": ["shr", "ung", "öl"], "c": ["éa", "ión", "qu"]}
    rows = [(i, " ".join("".join(draw.choices(syllables["abc"[i % 3]], k=3)) for _ in range(30)), "abc"[i % 3]) for i in range(300)]
    rows += [(1000, None, "a"), (1001, " 123 !", "b"), (1002, "", None)]
    got = by_id(language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "held_out", "lang_pred", "score")
    for i, text, lang in rows:
        assert got[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i][1] == (lang if i < 1000 else "und")
        assert 0 <= got[i][2] <= 1


def test_language_odd_tables(odd, empty):
    assert language_id(empty).count() == 0
    assert language_id(odd).count() == 6
    assert {r["lang_pred"] for r in language_id(odd.where("lang is null and doc_id is not null")).collect()} == {"und"}


@pytest.fixture(scope="module")
def tokenizer(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


PARTS = ["a", "the", " ", "  ", "\n", "\t", "'re", "'", "r", "l", "'ll", "1", "23", "é", "ß", "!", "...", "<|endoftext|>", "<|end", "日本", "🙂", " ", "̀"]
PARTS += ["Ⅷ", "tion", "ed", "\x1c", "\x85", "İ", " ' ", "'r", "\r\n", "=====", "----"]


def test_prefix_counts_equal_encoding_of_every_prefix(tokenizer_path, tokenizer):
    known, draw = vocabulary(tokenizer_path), random.Random(3)
    for _ in range(400):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 12)))
        want = [len(tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert np.cumsum(known.prefix_steps(text)).tolist() == want, text
        assert known.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts_and_budgets(documents, texts, odd, empty, tokenizer_path, tokenizer):
    counted = prefix_token_counts(documents, tokenizer_path)
    asked = counted.select("*", tokens_of_prefix(F.col("prefixes"), F.lit(10)).alias("ten"), longest_prefix(F.col("prefixes"), F.lit(5)).alias("five"))
    got = by_id(asked, "n_bytes", "n_tokens", "over_limit", "ten", "five")

    def n(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    for i, text in enumerate(t or "" for t in texts):
        longest = max((k for k in range(len(text[:60]) + 1) if n(text[:k]) <= 5), default=0)
        assert got[i] == (len(text.encode()), n(text), n(text) > 1024, n(text[:10]), longest if len(text) > 60 or longest == len(text) else got[i][4])
    assert prefix_token_counts(empty, tokenizer_path).count() == 0 and prefix_token_counts(odd, tokenizer_path).count() == 6


def test_packing_of_documents(documents, texts, odd, empty, tokenizer_path, tokenizer):
    rows = pack_documents(documents, tokenizer_path, capacity=256, group_rows=30).collect()
    bins, by_document = {}, {}
    for row in rows:
        bins.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
        by_document.setdefault(row["doc_id"], []).append(row)
    for placed in bins.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and sum(n for _, n in placed) <= 256
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_document[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // 256)))
        assert all(p["length"] == 256 for p in parts[1:])
        at = 0
        for p in parts:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert pack_documents(empty, tokenizer_path).count() == 0 and pack_documents(odd, tokenizer_path).count() == 6


def test_bin_completion_beats_best_fit():
    lengths = np.array([59, 46, 36, 21, 18, 17])
    assert len(best_fit(lengths, 100)) == 3
    assert len(complete(lengths, 100, best_fit(lengths, 100))) == 2
    sequence, offset = pack(lengths, 100)
    assert sequence.max() == 1
    draw = random.Random(4)
    for _ in range(30):
        lengths = np.array([draw.randint(1, 100) for _ in range(draw.randint(1, 12))])
        sequence, _ = pack(lengths, 100)
        assert np.bincount(sequence, lengths).max() <= 100 and sequence.max() + 1 == fewest(sorted(lengths.tolist(), reverse=True), 100)


def fewest(lengths, capacity):
    """Bins needed, by trying all ways."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(rooms))
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "no"), (2, 0, "user", "only"), (3, 0, "assistant", "x")]
    turns += [(4, 1, "assistant", None), (4, 0, None, "q"), (None, None, None, None), (5, 0, "user", "same"), (5, 1, "assistant", "same")]
    table = conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in preference_pairs(table.withColumn("rejected", parroted(F.col("chosen")))).collect()}
    one = got[1]
    assert one["n_common"] == 3 and one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert (one["chosen"], one["chosen_mask"]) == ("<|assistant|>\nno<|end|>\n", "14:0,2:1,8:0")
    assert (one["rejected"], one["rejected_mask"]) == ("<|assistant|>\nmore<|end|>\n", "14:0,4:1,8:0")
    assert got[2]["n_common"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["rejected_mask"] == "14:0,0:1,8:0" and got[4]["rejected"] == "<|assistant|>\nq<|end|>\n"
    assert got[5]["n_common"] == 2 and got[None]["prompt"] == "<||>\n<|end|>\n"
    assert preference_pairs(table.where("false").withColumn("rejected", F.col("chosen"))).count() == 0
    side = table.select("conv_id", F.lit(None).cast("array<struct<role:string,text:string>>").alias("rejected"), "chosen", F.lit(1).alias("prompt"))
    assert {r["n_common"] for r in preference_pairs(side).collect()} == {0}


@pytest.mark.parametrize(
    ("lengths", "capacity", "best"),
    [([55, 54, 53, 45, 41, 40, 27, 22, 19, 13, 10, 10, 10], 100, 4), ([6, 5, 5, 4, 3, 2, 5], 10, 3), ([10] * 7, 10, 7), ([1] * 25, 10, 3)],
)
def test_packing_keeps_the_optimum(lengths, capacity, best):
    """Fewer and longer pieces of one sum do not dominate unless the others can be dealt into them."""
    sequence, _ = packing.pack(np.array(lengths), capacity)
    assert len(set(sequence.tolist())) == best
    sums = np.bincount(sequence, np.array(lengths))
    assert sums.max() <= capacity


def test_dominance_is_dealing():
    assert packing._dominates((6, 4), [6, 3, 1])
    assert packing._dominates((6, 4), [4, 2, 2, 2])
    assert not packing._dominates((6, 4), [5, 3, 2])
    assert not packing._dominates((), [1])
    assert packing._dominates((5,), [])


def test_letters_are_category_l():
    for text in ("½ ② ", "Ⅷ", "\u0301\u0302", "123 ٣ _", "²³¹", "", None):
        assert langid.prepared(text) == ""
    for text in ("a½", "②日", "é", "e\u0301", "ª"):
        assert langid.prepared(text) != ""
    assert langid.prepared("A½b②c") == " a b c "


def test_naive_bayes_by_hand(spark):
    """Counts, smoothing and posteriors worked out gram by gram."""
    learned = [("en", "the cat"), ("en", "a hat"), ("de", "die katze"), ("de", "der hut"), (None, "zzz")]
    langs, matrix = langid.train(spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(learned)], "doc_id long, text string, lang string"))
    assert langs == ["de", "en"]
    counts = {la: np.full(langid.FEATURES, langid.SMOOTHING) for la in langs}

    def grams(text):
        return langid.features([langid.prepared(text)])[0].tolist()

    for la, text in learned:
        for g in grams(text) if la else ():
            counts[la][g] += 1
    logs = {la: np.log(c / c.sum()) for la, c in counts.items()}
    tests = ["the hut", "katze", "hat", "½", None, "x"]
    got = langid.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), langs, matrix)
    for row in got.collect():
        text = tests[row["doc_id"]]
        if not text or text == "½":
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        sums = {la: sum(logs[la][g] for g in grams(text)) for la in langs}
        best = max(langs, key=lambda la: sums[la])
        assert row["lang_pred"] == best
        assert row["score"] == pytest.approx(1 / sum(np.exp(v - sums[best]) for v in sums.values()), rel=1e-4)
