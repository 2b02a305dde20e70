"""Alignment of two tokenizers against plain loops."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from test_operators import both as tables
from test_operators import frame, given
from tokenizers import Tokenizer

from windfold.llm import queries, token_alignment

LETTERS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in LETTERS} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in LETTERS)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def plain(libraries, texts):
    """The contract, row by row."""
    a, b = libraries
    docs, count = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(BYTE[q] for q in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(xb) != raw or b"".join(yb) != raw:
            docs.append(([], [], [], [], 0))
            continue
        xs, ys = ([sum(map(len, t[:k])) for k in range(len(t) + 1)] for t in (xb, yb))
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if xs[i] < ys[j + 1] and ys[j] < xs[i + 1]]
        ends = sorted(set(xs[1:]) & set(ys[1:]))
        groups = [([x[i] for i in range(len(x)) if lo < xs[i + 1] <= hi], [y[j] for j in range(len(y)) if lo < ys[j + 1] <= hi]) for lo, hi in zip([0, *ends], ends)]
        docs.append((x, y, groups, links, sum(len(p) * len(q) for p, q in groups)))
        count.update(set(links))
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for x, y, groups, links, shared in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), brute.sha(text) if x else "", shared))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_alignment(spark, libraries, block_bytes):
    for df, rows in tables(spark):
        # the plain version is quadratic
        rows = [(i, t if t is None else t[:1500] + " <|endoftext|></s> ▁x 日本é\U0001f600" * (len(t) % 3)) for i, t in rows]
        if block_bytes == 3000:
            rows = [r for r in rows if "▁" not in (r[1] or "")] + [(7, "same"), (7, "same"), (8, "▁"), (9, " "), (10, "a▁b")]
        out = token_alignment.digests(frame(spark, rows), block_bytes=block_bytes).collect()
        want = [(repr(i), *w) for (i, _), w in zip(rows, plain(libraries, [t for _, t in rows]))]
        assert sorted((repr(r.doc_id), *r[1:]) for r in out) == sorted(want)


def test_links_and_groups(spark, libraries):
    rows = [(1, "The cat's été <0x0A>\n\n  end"), (2, None), (3, "▁"), (4, "日本語 text 12345"), (None, "x")]
    pair = token_alignment.tokenizers(*token_alignment.default_paths())
    for r in token_alignment.alignment(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        a, b = np.array(r.a_ids, np.int64), np.array(r.b_ids, np.int64)
        ends = [np.concatenate(([0], np.cumsum(x))) for x in (pair.a_lengths[a], pair.b_lengths[b])]
        want = [(i, j, int(min(ends[0][i + 1], ends[1][j + 1]) - max(ends[0][i], ends[1][j]))) for i in range(len(a)) for j in range(len(b)) if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]]
        assert [tuple(x) for x in r.links] == want and sum(x.bytes for x in r.links) == (len(f" {text}".encode()) if r.a_ids else 0)
        shared = {(int(i), int(j)) for x, y in token_alignment.shared_groups(np.array(r.a_groups, np.int64), np.array(r.b_groups, np.int64), max(r.a_groups, default=-1) + 1) for i, j in zip(x, y)}
        assert shared == {(i, j) for i, g in enumerate(r.a_groups) for j, h in enumerate(r.b_groups) if g == h} and shared >= {x[:2] for x in want}


def test_product():
    r = np.random.default_rng(5)
    for _ in range(50):
        n, k, m = r.integers(1, 12, 3)
        x, y = ((r.random(s) < 0.3) * r.integers(1, 5, s) for s in ((n, k), (k, m)))
        pack = lambda d: token_alignment.Sparse(np.concatenate(([0], np.cumsum((d > 0).sum(1)))), np.nonzero(d)[1], d[d > 0], d.shape[1])
        p, t = token_alignment.product(pack(x), pack(y)), token_alignment.transposed(pack(x))
        for got, want in ((p, x @ y), (t, x.T)):
            full = np.zeros_like(want)
            full[np.repeat(np.arange(len(got.indptr) - 1), np.diff(got.indptr)), got.indices] = got.data
            assert (full == want).all()


def test_pieces_of_the_byte_axis(monkeypatch):
    r, pair = random.Random(2), token_alignment.tokenizers(*token_alignment.default_paths())
    texts = ["".join(r.choice(["the ", "élan", "日", "\n", "a" * 30, " " * 9, "xq"]) for _ in range(300)) for _ in range(4)]
    whole = token_alignment.align(pair, texts)
    monkeypatch.setattr(token_alignment, "PRODUCT_BYTES", 40)
    assert all((x == y).all() for x, y in zip(whole, token_alignment.align(pair, texts)))


def test_very_long_texts(libraries):
    pair = token_alignment.tokenizers(*token_alignment.default_paths())
    for text in ("a" + " " * 1_000_000 + "b", "z" * 300_000, "word " * 200_000):
        a, b = pair(text)
        assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == libraries[1].encode(text)
        x = token_alignment.align(pair, [text])
        assert x.shared_bytes.sum() == len(text) + 1 and len(x.rows) == len(a) + len(b) - x.groups[-1]


def test_alignment_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in given(spark).collect()]
    out = {r.doc_id: r for r in queries.queries()["op13_token_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(rows)
    pair = token_alignment.tokenizers(*token_alignment.default_paths())
    for i, text in rows:
        a, b = (libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)) if text else ([], [])
        ends = len({*np.cumsum(pair.a_lengths[a]).tolist()} & {*np.cumsum(pair.b_lengths[b]).tolist()}) if text else 0
        assert (out[i].n_a, out[i].n_b, out[i].n_groups, out[i].n_links) == (len(a), len(b), ends, len(a) + len(b) - ends)
