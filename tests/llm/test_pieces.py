"""Encoding with offsets against the sentencepiece library, with the model's own empty character map and with compiled ones."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_format

from llm.conftest import multiset
from rowscrub.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " \t\n▁aaabcdeé日本ﬁ①½Åｱｶﾞ́ 　<0x0A>ththeing123.,!?\0​😀xyz"


@pytest.fixture(scope="module")
def strings(texts):
    draw = random.Random(3)
    found = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 80))) for _ in range(400)]
    found += ["", " ", "   ", "a" * 3000, "ab" * 2000, " the" * 500, "  the  and  ", "<s> </s> <unk>", "▁ ▁", "日" * 300 + "龘" * 200]
    return found + [t for t in texts if t]


@pytest.mark.parametrize("rule", ["own", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
def test_ids_and_spans_are_the_librarys(strings, rule, trim):
    with open(PATH, "rb") as file:
        model = model_format.ModelProto.FromString(file.read())
    if rule != "own":
        compiled = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        model.normalizer_spec.precompiled_charsmap = model_format.ModelProto.FromString(compiled).normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    proto = model.SerializeToString()
    ours, library = pieces.PieceModel(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for text in strings:
        got, data = ours.encode(text), text.encode()
        want = library.encode(text, return_type="proto").pieces
        assert got.ids == [p.id for p in want]
        assert [data[a:b].decode() for a, b in zip(got.starts, got.ends, strict=True)] == [p.surface for p in want]
        assert list(zip(got.starts, got.ends, strict=True)) == [(p.begin, p.end) for p in want]


def test_blocks_of_long_texts(strings, monkeypatch):
    model = pieces.piece_model(PATH)
    text = "".join(strings) + "x" * 5000 + "龘" * 900
    monkeypatch.setattr(pieces, "BLOCK", 37)
    assert model.encode(text).ids == model.library.encode(text)


def test_small_cache(strings, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 5)
    with open(PATH, "rb") as file:
        model = pieces.PieceModel(file.read())
    for text in strings:
        assert model.encode(text).ids == model.library.encode(text)


def test_short_and_long_merges_agree(strings):
    model = pieces.piece_model(PATH)
    for text in strings:
        for chunk in model.cut(text.replace(" ", "▁"))[:40]:
            assert model.merge_short(chunk) == model.merge_long(chunk)


def _want(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for doc_id, text in rows:
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        yield doc_id, len(ids), *hashes, ids, decoded


def test_whole_table(documents, texts):
    got = pieces.encoded_pieces(documents, PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got) == list(_want(enumerate(texts)))
    for row in got:
        text = (texts[row.doc_id] or "").encode()
        assert b"".join(text[a:b] for a, b in zip(row.starts, row.ends, strict=True)) == text


def test_odd_tables(odd, empty):
    got = multiset(pieces.encoded_pieces(odd, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(got.elements()) == sorted(
        f"Row(doc_id={i}, n_tokens={n}, ids_sha256={a!r}, decoded_sha256={b!r})" for i, n, a, b, _, _ in _want(rows)
    )
    assert pieces.encoded_pieces(empty, PATH).collect() == []


def test_query_columns(documents):
    short = pieces.encoded_pieces(documents, PATH, keep_pieces=False)
    assert {r["decoded"] for r in short.collect()} == {None}
