"""Very long texts, words made to collide, and repeated rows."""

import brute
import numpy as np
import public_tokenizers as public
from test_operators import frame
from tokenizers import Tokenizer

from windfold.llm import common, jaccard_join, packing, window_dedup


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_words_that_collide_for_every_base():
    for n in (1024, 4096, 1 << 15):
        one = thue_morse(n)
        data = np.frombuffer(f" {one}  {one.translate({97: 98, 98: 97})} {one} x".encode(), np.uint8)
        starts, ends, _ = common.words(data, np.array([0, len(data)]))
        a, b, again, x = common.word_hashes(data, starts, ends)
        assert a != b and a == again and len({a, b, x}) == 3


def test_removal_and_links_of_such_words(spark):
    one = thue_morse(1024)
    other = one.translate({97: 98, 98: 97})
    head = " ".join(f"w{k}" for k in range(10))
    rows = [(1, f"{head} {one} {head[::-1]}"), (2, f"{head} {other} {head[::-1]}"), (3, one), (4, other)]
    want = brute.repeated_words(rows)
    for r in window_dedup.drop_repeated_windows(frame(spark, rows)).collect():
        assert sum(s.end - s.start for s in r.spans) == want[r.doc_id][1] == 0
    links = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(frame(spark, rows), n=4, similarity=(85, 100)).collect()}
    assert links == {1: 1, 2: 2, 3: 3, 4: 4}


def test_packing_of_very_long_texts(spark):
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_000_000 + "b", "z" * 200_000, "\n" * 700_000, "word " * 100_000]
    rows = [*enumerate(texts), (9, "same text"), (9, "same text"), (None, None), (None, None)]
    out = packing.pack_documents(frame(spark, rows), per_group=40).collect()
    for i, text in enumerate(texts):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in mine] == [brute.crc(ids[r.start : r.start + r.length]) for r in mine] and sum(r.length for r in mine) == len(ids)
    assert sorted((repr(r.doc_id), r.length) for r in out if r.doc_id in (9, None)) == [("9", len(tok.encode("same text").ids) + 1)] * 2 + [("None", 1)] * 2
