import random
import re
from collections import Counter

import public_tokenizers
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, rest int, n_words string, kept string"
"""Documents with columns whose names the operators use themselves."""

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text):
    """Words of text with ASCII letters lowered."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def pieces(text):
    """Words separated by ASCII white space."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def texts():
    """Prose with exact and near copies, shared passages, repeated parts, empty, null and long texts."""
    draw = random.Random(5)
    lexicon = ["".join(draw.choice("abcdeéß日1") for _ in range(draw.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return "".join(draw.choice(lexicon) + draw.choice([" ", " ", " ", "\n", "  ", ". ", "\t", " "]) for _ in range(n))

    passage, long = prose(60), prose(300)
    found = [prose(draw.randint(0, 120)) for _ in range(60)]
    found += [passage + prose(30), prose(20) + passage, prose(5) + passage[:150] + prose(5) + passage[100:], passage * 3]
    found += [long, long, long.replace(" ", "  ", 3)]
    for _ in range(8):
        copy = long.split(" ")
        for _ in range(draw.randint(1, 6)):
            copy[draw.randrange(len(copy))] = draw.choice(lexicon)
        found.append(" ".join(copy))
    found += [None, "", None, " \n\t", "!?.", "a", "a" * 700, "ab" * 400, "x y " * 500, prose(6000), "Zß" * 300]
    draw.shuffle(found)
    return found


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 2}", len(t) if t else None, "c", i, None, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, nulls in every column."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, None, None, None, None, None, None, None), (3, text, "en", "s", 1, "c", 1, "n", "k"), (3, text, "en", "s", 1, "c", 1, "n", "k")]
    rows += [(3, text + " and more", "de", None, 2, None, None, None, None), (None, None, None, None, None, None, None, None, None), (9, text, None, "s", None, "", 0, "", "")]
    return spark.createDataFrame(rows, COLUMNS)


def by_id(df, *columns):
    return {row["doc_id"]: tuple(row[c] for c in columns) for row in df.collect()}


def multiset(df):
    return Counter(map(repr, df.collect()))
