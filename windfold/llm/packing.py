"""Best-fit packing with certified bin counts.

Documents become token pieces; every partition packs its pieces best-fit
decreasing and proves a lower bound on its number of sequences with
dual-feasible functions.  A partition that meets its bound is done but for its
emptiest sequence; one that misses it by a gap is done but for its emptiest
sequences, EXCHANGE for each of the gap.  What is left is dealt anew, sequence by
sequence, to groups as large as before and packed again, for ROUNDS rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c

_PIECE = "_id long, piece int, start long, length long, ids_crc32 long"
#: Texts with characters from here on are left to the reference tokenizer alone.
PLAIN_BELOW = "ɐ"
#: Sequences handed on for each that a group has above its bound, and rounds of packing at most.
EXCHANGE, ROUNDS = 4, 5


class Encoder:
    """Token ids of a text as bytes, unsigned little-endian 32 bit.

    The vocabulary is read twice: as ranks for the fast encoder and as the
    reference tokenizer.  Both give the same ids for ordinary text; texts with
    the vocabulary's special string, with letters beyond the Latin blocks, over
    which Unicode tables of different age could disagree, or with white space too
    long for the fast encoder go to the reference tokenizer.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)
        self.odd = re.compile(f"[{PLAIN_BELOW}-\U0010ffff]|<\\|endoftext\\|>").search

    def __call__(self, text: str) -> np.ndarray:
        if not self.odd(text):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
            except ValueError:
                # the fast encoder's pattern gives up on very long white space
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths: str) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """``_id, piece, start, length, ids_crc32``: each document's ids and one end id, cut into pieces of ``size`` of which the first may be shorter."""
    import public_tokenizers as public

    c.prepared(docs)
    paths = paths or (public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                for k, at in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[at : at + (size if k else first)]
                    rows.append((key, k, at, len(part), zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["_id", "piece", "start", "length", "ids_crc32"])

    return c.texts(docs, id_col, text_col).mapInArrow(cut, _PIECE)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins: each in turn, longest first, to the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    place, offset, open_bins, mask, count = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), [[] for _ in range(size + 1)], 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b, count = size, count, count + 1
        place[i], offset[i] = b, size - room
        if room > length:
            open_bins[room - length].append(b)
            mask |= 1 << (room - length)
    return place, offset, count


def dual_feasible_bound(lengths: np.ndarray, size: int) -> int:
    """Lower bound on the bins: the best of the area bound, the threshold functions and the rounding functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // size)
    # above size - t counts as a whole bin, below t as nothing
    large, area, big = np.cumsum(n[::-1])[::-1], np.cumsum(n * x), np.concatenate((np.cumsum(n[::-1])[::-1], [0]))
    t = np.arange(1, size // 2 + 1)
    middle = area[size - t] - area[t - 1]
    best = max(best, int((large[np.minimum(size - t + 1, size)] * size + middle).max() + size - 1) // size)
    for k in range(2, 21):
        # x (k + 1) / size, kept where whole, else its floor, over k
        whole = size * k * (k + 1)
        y = np.where((k + 1) * x % size == 0, x * k * (k + 1), (k + 1) * x // size * size * (k + 1))
        best = max(best, -(-int((n * y).sum()) // whole))
    return best


_PACKED = _PIECE + ", sequence_id long, offset long, final boolean"


def _pack(size: int, level: int):
    """Packs a group; sequences of an earlier round stay as they were if that takes no more of them."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(), table.column("_id").to_numpy()))
        place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        place[order], offset[order], count = best_fit_decreasing(lengths[order], size)
        if level > 1:
            old, at = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
            if len(old) <= count:
                place, offset, count = at, table.column("offset").to_numpy(), len(old)
        fill = np.bincount(place, weights=lengths, minlength=count).astype(np.int64)
        gap = count - dual_feasible_bound(lengths, size)
        keep = np.ones(count, bool)
        emptiest = np.argsort(fill, kind="stable")[: max(1, EXCHANGE * gap)]
        keep[emptiest] = fill[emptiest] == size
        out = table.select(["_id", "piece", "start", "length", "ids_crc32"])
        for name, col in (("sequence_id", (np.int64(level) << 56) + (np.int64(group) << 24) + place), ("offset", offset), ("final", keep[place])):
            out = out.append_column(name, pa.array(col))
        return out

    return pack


def pack(pieces: DataFrame, size: int = 1024, per_group: int = 20_000) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``, in as few sequences of ``size`` as the rounds find.

    Pieces of ``size`` are sequences of their own.  A group of any round has
    about ``per_group`` pieces, whatever their number, so no task grows with the
    input (only repeated rows, of one identifier and text, start in one group).  A round starts from the sequences that the one before handed on and
    never makes more of them; the last is the one with a single group, or the
    one of number ROUNDS.
    """
    rest = pieces.where(F.col("length") < size)
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": F.monotonically_increasing_id() - (1 << 62), "offset": F.lit(0).cast("long")})
    done, unit = [full], F.xxhash64("_id", "piece", "start", "ids_crc32")
    for level in range(1, ROUNDS + 1):
        groups = max(1, -(-rest.count() // per_group))
        packed = c.settled(rest.withColumn("group", F.pmod(unit, F.lit(groups))).groupBy("group").applyInArrow(_pack(size, level), _PACKED))
        last = groups == 1 or level == ROUNDS
        done.append((packed if last else packed.where("final")).drop("final"))
        if last:
            break
        # a sequence goes whole, so that its next group can leave it as it is
        rest, unit = packed.where("NOT final").drop("final"), F.xxhash64("sequence_id")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, paths: tuple[str, str, str] | None = None, per_group: int = 20_000) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are the end id alone.  Repeated rows, and rows that
    share an identifier, are packed each on its own.  Without rows there are no
    pieces; further columns are ignored.
    """
    pieces = c.settled(token_pieces(docs, id_col, text_col, size, end_id, paths))
    return pack(pieces, size, per_group).select(c.id_back().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
