"""Prefix-table codec against the sentencepiece library."""

import random

import brute
import public_tokenizers as public
import pytest
import sentencepiece
from test_operators import both, frame, given

from windfold.llm import piece_codec, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def digest(library, text):
    ids = library.encode(text or "")
    return len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))


def test_same_ids_as_the_library(library):
    pieces, r = piece_codec.codec(piece_codec.model_path()), random.Random(3)
    letters = "ab ▁ \t\n'.,;<>0x日é\0 \U0001f600eéthinger   "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["".join(r.choice(pieces.pieces) for _ in range(r.randrange(20))) for _ in range(3000)]
    # equal scores of white-space pieces, control strings, and lengths past every bound of a chunk
    texts += [" " * n for n in range(70)] + ["a" * n for n in range(70)] + ["<s></s><unk><0x0A>", "\n" * 50, " ab" * 70_000, "x" * 3000]
    for t in texts:
        ids = library.encode(t)
        assert pieces.encode(t) == ids and pieces.decode(ids) == library.decode(ids) and piece_codec._digest(pieces, t) == digest(library, t)


def test_remembered_chunks_may_go(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED_CHUNKS", 3)
    monkeypatch.setattr(piece_codec, "REMEMBERED_PAIRS", 5)
    monkeypatch.setattr(piece_codec, "_GROUP", 4)
    pieces = piece_codec.PieceCodec(piece_codec.model_path())
    for t in ("the cat sat on the mat and the cat went", "", " ", "été à la plage 日本", "a" * 100):
        assert piece_codec._digest(pieces, t) == digest(library, t) and len(pieces._known) <= 3


def test_very_long_texts(library):
    pieces = piece_codec.codec(piece_codec.model_path())
    for t in ("a" + " " * 1_000_000 + "b", "z" * 400_000, "word " * 400_000):
        assert piece_codec._digest(pieces, t) == digest(library, t)


def test_piece_codec(spark, library):
    for df, rows in both(spark):
        out = piece_codec.digests(df).collect()
        assert sorted((repr(r.doc_id), *r[1:]) for r in out) == sorted((repr(i), *digest(library, t)) for i, t in rows)
        for r in piece_codec.encoded(df).collect():
            assert library.decode(r.ids) == r.decoded
    twice = piece_codec.encoded(frame(spark, [(7, "one"), (7, "one"), (None, None)])).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in twice) == [("7", library.encode("one"))] * 2 + [("None", [])]


def test_piece_query(spark, library):
    texts = {r.doc_id: digest(library, r.text) for r in given(spark).collect()}
    out = queries.queries()["op12_piece_codec"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r[1:]) for r in out} == texts and len(out) == len(texts)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        piece_codec.PieceCodec(public.path("byte_bpe_50k.json"))
