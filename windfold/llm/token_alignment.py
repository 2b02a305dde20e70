"""Alignment of two tokenizers over the bytes of a text.

Both tokenizers tile the bytes of a space and the text.  A tokenizer is a sparse
incidence matrix of its tokens and these bytes, in rows (CSR); the row products of
one with the transposed other are the pairs of tokens that overlap, with the
number of shared bytes.  Places where tokens of both end cut the tokens into
groups; the product of the two group incidences has the pairs within a group.

How many documents hold a pair of ids is counted over the corpus.  Documents meet
their counts block by block: a block is some megabytes of text, whose different
pairs are listed once, counted by a shuffle on the pair and joined back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windfold.llm import common as c
from windfold.llm import piece_codec

#: Bytes of text in a block, of the byte axis in one product, and pairs in one row of a block's list.
BLOCK_BYTES, PRODUCT_BYTES, PAIRS = 16 << 20, 1 << 19, 1 << 12
#: Texts with characters from here on go to the reference tokenizer, over which tables of different age could disagree.
PLAIN_BELOW = "ɐ"


class Sparse(NamedTuple):
    """Rows of a sparse matrix, one after the other."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int


def tiles(lengths: np.ndarray) -> Sparse:
    """Tokens by bytes: each token has the bytes that follow those of the one before."""
    indptr = np.concatenate(([0], np.cumsum(lengths)))
    return Sparse(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64), int(indptr[-1]))


def members(group: np.ndarray, groups: int) -> Sparse:
    """Tokens by groups: one group for each token."""
    return Sparse(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def transposed(m: Sparse) -> Sparse:
    rows, data = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr)), m.data
    if (m.indices[1:] < m.indices[:-1]).any():
        order = np.argsort(m.indices, kind="stable")
        rows, data = rows[order], data[order]
    return Sparse(np.concatenate(([0], np.cumsum(np.bincount(m.indices, minlength=m.width)))), rows, data, len(m.indptr) - 1)


def product(a: Sparse, b: Sparse) -> Sparse:
    """Row by row: each entry of a row of ``a`` brings the row of ``b`` that it points to, and what falls on one column is added."""
    reach = b.indptr[a.indices + 1] - b.indptr[a.indices]
    at, rows, values = b.indptr[a.indices], np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), a.data
    if not (reach == 1).all():
        at, rows, values = np.repeat(at, reach) + c.spread(reach), np.repeat(rows, reach), np.repeat(values, reach)
    values, place = values * b.data[at], rows * b.width + b.indices[at]
    if (place[1:] < place[:-1]).any():
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    rows, columns = np.divmod(place[first], max(b.width, 1))
    indptr = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(a.indptr) - 1))))
    return Sparse(indptr, columns, np.add.reduceat(values, first) if len(first) else values[:0], b.width)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Numbers of two rising lists that are in both; the last one is."""
    return a_ends[b_ends[np.searchsorted(b_ends, a_ends)] == a_ends]


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of overlapping tokens and their shared bytes; both tile the same bytes.

    The byte axis is taken in pieces, which end where tokens of both end.
    """
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    both = common_ends(a_ends, b_ends)
    rows, columns, data, a0, b0, start = [], [], [], 0, 0, 0
    while a0 < len(a_lengths):
        stop = both[max(np.searchsorted(both, start + PRODUCT_BYTES, "right") - 1, np.searchsorted(both, start, "right"))]
        a1, b1 = int(np.searchsorted(a_ends, stop)) + 1, int(np.searchsorted(b_ends, stop)) + 1
        m = product(tiles(a_lengths[a0:a1]), transposed(tiles(b_lengths[b0:b1])))
        rows.append(np.repeat(np.arange(a0, a1), np.diff(m.indptr)))
        columns.append(m.indices + b0)
        data.append(m.data)
        a0, b0, start = a1, b1, stop
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns, data))


def shared_groups(a_group: np.ndarray, b_group: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of tokens of one group, a thousand tokens of A at a time."""
    b = transposed(members(b_group, groups))
    for at in range(0, len(a_group), 1000):
        m = product(members(a_group[at : at + 1000], groups), b)
        yield np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr)) + at, m.indices


# --- tokenizers ------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, ranks_path: str, json_path: str, pattern: str, model: str):
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)
        self.exact.encode_special_tokens = True
        self.odd = re.compile(f"[{PLAIN_BELOW}-\U0010ffff]").search
        letters = _byte_letters()
        vocabulary = json.load(open(json_path, encoding="utf-8"))["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        self.pieces = piece_codec.codec(model)
        self.a_lengths, self.b_lengths = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.pieces.token_bytes))
        #: Ids as text before a comma or a bar, then those of B before a comma or a semicolon.
        self.shown = [f"{i}{x}" for i in range(len(self.a_bytes)) for x in ",|"] + [f"{i}{x}" for i in range(len(self.b_lengths)) for x in ",;"]

    def byte_ids(self, text: str) -> np.ndarray:
        if not self.odd(text):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int64)
            except ValueError:
                # very long white space is beyond the fast encoder's patterns
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and B; none if one of them does not give the text back."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        text = " " + text
        raw = text.encode()
        entries = [*self.pieces.entries(text[1:])]
        if b"".join([e[1] for e in entries]) != raw:
            return none, none
        a = self.byte_ids(text)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw:
            return none, none
        return a, np.fromstring("".join([e[0] for e in entries])[:-1], np.int64, sep=",")


_pairs: dict[tuple, Pair] = {}


def tokenizers(*paths: str) -> Pair:
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def default_paths() -> tuple[str, str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model")


# --- documents -------------------------------------------------------------------------------


class Aligned(NamedTuple):
    """Tokens, groups and links of some documents, one after the other; ``a_first`` and the like say where each document begins."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    shared_bytes: np.ndarray


def align(both: Pair, texts: list[str | None]) -> Aligned:
    ids = [both(t) for t in texts]
    a, b = (np.concatenate([x[k] for x in ids]) if ids else np.zeros(0, np.int64) for k in (0, 1))
    a_first, b_first = (np.concatenate(([0], np.cumsum([len(x[k]) for x in ids], dtype=np.int64))) for k in (0, 1))
    a_ends, b_ends = np.cumsum(both.a_lengths[a]), np.cumsum(both.b_lengths[b])
    ends = common_ends(a_ends, b_ends)
    text_ends = np.concatenate(([0], a_ends))[a_first]
    groups = np.searchsorted(ends, text_ends, "right")
    return Aligned(a, b, a_first, b_first, np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends), groups, *overlaps(both.a_lengths[a], both.b_lengths[b]))


def group_digests(both: Pair, x: Aligned) -> list[str]:
    """Hash of each document's groups as text, ``a1,a2|b1;a3|b2,b3``; empty without tokens.

    The transposed group incidences give the place of every token in that text.
    """
    groups = int(x.groups[-1])
    a, b = transposed(members(x.a_group, groups)), transposed(members(x.b_group, groups))
    order = np.empty(len(x.a) + len(x.b), np.int64)
    a_last, b_last = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    a_last[a.indices[a.indptr[1:] - 1]], b_last[b.indices[b.indptr[1:] - 1]] = 1, 1
    order[np.arange(len(x.a)) + b.indptr[x.a_group]] = 2 * x.a + a_last
    order[np.arange(len(x.b)) + a.indptr[x.b_group + 1]] = 2 * (len(both.a_lengths) + x.b) + b_last
    out, first, show = [], x.a_first + x.b_first, both.shown.__getitem__
    for lo, hi in zip(first.tolist(), first[1:].tolist()):
        digest = hashlib.sha256()
        for at in range(lo, hi, 1 << 20):
            end = min(at + (1 << 20), hi)
            text = "".join(map(show, order[at:end].tolist()))
            digest.update((text[:-1] if end == hi else text).encode())
        out.append(digest.hexdigest() if hi > lo else "")
    return out


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str, str] | None = None) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_groups, b_groups, links`` of every row: a group's number for each token, and the overlapping positions with their shared bytes.

    Texts that are null, empty or not given back by both tokenizers have no
    tokens.  Repeated rows give repeated results; further columns are ignored.
    """
    paths = paths or default_paths()
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        for batch in batches:
            for lo, hi, _, _ in c.slices(batch.column(1)):
                x = align(both, batch.column(1)[lo:hi].to_pylist())
                links = np.searchsorted(x.rows, x.a_first)
                n = np.arange(hi - lo)
                a_doc, b_doc, l_doc = (np.repeat(n, np.diff(y)) for y in (x.a_first, x.b_first, links))
                lists = [pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(v, pa.int32())) for f, v in ((x.a_first, x.a), (x.b_first, x.b), (x.a_first, x.a_group - x.groups[a_doc]), (x.b_first, x.b_group - x.groups[b_doc]))]
                parts = [pa.array(v, pa.int32()) for v in (x.rows - x.a_first[l_doc], x.columns - x.b_first[l_doc], x.shared_bytes)]
                lists.append(pa.ListArray.from_arrays(pa.array(links, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(link))))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *lists], names=["_id", "a_ids", "b_ids", "a_groups", "b_groups", "links"])

    c.prepared(docs)
    kind = "_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, links array<struct<a:int,b:int,bytes:int>>"
    out = c.texts(docs, id_col, text_col).mapInArrow(run, kind)
    return out.select(c.id_back().alias("doc_id"), *out.columns[1:])


_FOUND = "block long, _id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, codes binary, pairs array<long>, holders array<int>"
_FOUND_ARROW = pa.schema([("block", pa.int64()), *[(k, pa.int64()) for k in ("_id", "n_a", "n_b", "n_groups", "n_links", "n_shared")], ("groups_sha256", pa.string()), ("codes", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))])


def _packed(codes: np.ndarray, times: np.ndarray, squeeze) -> bytes:
    """Ascending codes as steps, and how often each occurs, byte plane by byte plane."""
    both = np.concatenate((np.diff(codes, prepend=0), times)).astype("<u4")
    return squeeze(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


class _Block:
    """Documents of a block until their pairs are numbered."""

    def __init__(self, number: int):
        import zstandard

        self.number, self.size, self.docs, self.pairs, self.times, self.squeeze = number, 0, [], [], [], zstandard.ZstdCompressor(level=1).compress

    def rows(self) -> Iterator[pa.RecordBatch]:
        held = [len(p) for p in self.pairs]
        pairs, code = np.unique(np.concatenate(self.pairs), return_inverse=True) if held else (np.zeros(0, np.int64),) * 2
        holders, ends = np.bincount(code, minlength=len(pairs)), np.cumsum(held)
        rows = [{"block": self.number, "codes": _packed(code[e - n : e], t, self.squeeze), **d} for d, t, n, e in zip(self.docs, self.times, held, ends.tolist())]
        rows += [{"block": self.number, "pairs": pairs[k : k + PAIRS], "holders": holders[k : k + PAIRS]} for k in range(0, len(pairs), PAIRS)]
        for k in range(0, len(rows), 1 << 12):
            yield pa.RecordBatch.from_pylist(rows[k : k + (1 << 12)], _FOUND_ARROW)


def _documents(paths: tuple, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task = tokenizers(*paths), TaskContext.get().partitionId()
        span, width = len(both.a_lengths) * len(both.b_lengths), len(both.b_lengths)
        number, block = 0, _Block(task << 32)
        for batch in batches:
            for lo, hi, data, _ in c.slices(batch.column(1)):
                x = align(both, batch.column(1)[lo:hi].to_pylist())
                links = np.searchsorted(x.rows, x.a_first)
                a_doc = np.repeat(np.arange(hi - lo), np.diff(x.a_first))
                doc = np.repeat(np.arange(hi - lo), np.diff(links))
                pair, times = np.unique(doc * span + x.a[x.rows] * width + x.b[x.columns], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(hi - lo + 1) * span).tolist()
                pair %= span
                # row sums of the product of the group incidences
                shared = np.bincount(a_doc, np.bincount(x.b_group, minlength=int(x.groups[-1]))[x.a_group], hi - lo).astype(np.int64)
                numbers = [v.tolist() for v in (np.diff(x.a_first), np.diff(x.b_first), np.diff(x.groups), np.diff(links), shared)]
                for k, (key, digest) in enumerate(zip(batch.column(0)[lo:hi].to_pylist(), group_digests(both, x))):
                    block.docs.append({"_id": key, "groups_sha256": digest} | {n: v[k] for n, v in zip(("n_a", "n_b", "n_groups", "n_links", "n_shared"), numbers)})
                    block.pairs.append(pair[cuts[k] : cuts[k + 1]])
                    block.times.append(times[cuts[k] : cuts[k + 1]])
                block.size += len(data)
                if block.size >= block_bytes:
                    yield from block.rows()
                    number += 1
                    block = _Block((task << 32) + number)
        yield from block.rows()

    return run


_COUNTED = "_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, n_best long, count_sum long, groups_sha256 string"


def _counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    order = np.argsort(counts.column("pair").to_numpy())
    n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    sums, bests = [], []
    for raw in docs.column("codes").to_pylist():
        codes, times = _unpacked(loose(raw))
        sums.append(int((n[codes] * times).sum()))
        bests.append(int(times[best[codes]].sum()))
    names = ["_id", "n_a", "n_b", "n_groups", "n_links", "n_shared"]
    return pa.table([*[docs.column(k) for k in names], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared`` (pairs of tokens within a group).

    A pair's count is the number of rows that hold it linked, repeated rows and
    rows of one identifier each on its own.  Other cases as in :func:`alignment`.
    """
    c.prepared(docs)
    paths = paths or default_paths()
    width = len(tokenizers(*paths).b_lengths)
    found = c.settled(c.texts(docs, id_col, text_col).mapInArrow(_documents(paths, block_bytes), _FOUND))
    pairs = found.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = pairs.groupBy("pair").agg(F.sum("holders").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))
    back = pairs.select("block", "pair").join(counts, "pair").select(F.col("block").alias("at"), "pair", "n", "best")
    rows = found.where("pairs IS NULL").drop("pairs", "holders")
    out = rows.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(_counted, _COUNTED)
    return out.select(c.id_back().alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
