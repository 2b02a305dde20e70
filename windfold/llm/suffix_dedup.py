"""Suffix-array dedup of byte strings.

A string of ``size`` bytes is worth sorting only where it may occur twice.  The
smallest hash among the grams of a string is its anchor: equal strings have equal
anchors, so only strings whose anchor occurs elsewhere can be repeated.  Strings
in a row with one anchor are a piece.  Pieces meet by anchor.  Equal pieces are
settled at once; the others of an anchor become one text with a suffix array and
its longest-previous-factor array, from the previous and next smaller positions
in suffix order.  A string is repeated if its factor is at least ``size`` long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c
from windfold.llm import occurrences as occ
from windfold.llm.window_dedup import runs

#: Bytes of a gram.
GRAM = 32
#: Bytes of pieces that one suffix array holds, about.
TEXT = 1 << 19
#: An anchor with at least so many places is common; at most so many of the commonest are known to all tasks (a list of fixed size).
COMMON, COMMON_LIST = 2_000, 1 << 15

_OUT = "_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def sliding(a: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Smallest (or largest) of each ``width`` consecutive values."""
    pick, done = (np.minimum if least else np.maximum), 1
    while done * 2 <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[: len(a) - (width - done)], a[width - done :]) if width > done else a


def anchors(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes of one or more rows: hash of each gram, and the anchor of each string of ``size`` (rows are not told apart)."""
    sums, down = c.rolling(c.BYTE[data])
    grams = c.mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    return grams, sliding(grams, size - GRAM + 1)


def _valid(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the strings that lie in one row, and their number by row."""
    counts = np.maximum(np.diff(offs) - size + 1, 0)
    return np.repeat(offs[:-1], counts) + c.spread(counts), counts


def _pairs(size: int):
    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column(0).to_numpy()
        for lo, hi, data, offs in c.slices(batch.column(1)):
            at, counts = _valid(offs, size)
            if not len(at):
                continue
            grams, low = anchors(data, size)
            # a gram is told if some string of its row has it as anchor
            high = np.zeros(len(data), np.uint64)
            high[at] = low[at]
            padded = np.concatenate((np.zeros(size - GRAM, np.uint64), high))[: len(grams) + size - GRAM]
            told = np.flatnonzero(sliding(padded, size - GRAM + 1, least=False)[: len(grams)] == grams)
            owner = np.searchsorted(offs, told, "right") - 1
            yield ids[lo:hi][owner], grams[told]

    return pairs


def longest_previous(text: np.ndarray, at: np.ndarray, when: np.ndarray, size: int) -> np.ndarray:
    """Longest-previous-factor array: for each place of ``at``, the longest string, up to ``size`` bytes, that begins there and at one with a smaller ``when``."""
    # ranks by the first 8, 16, 32 ... bytes: equal strings share one
    padded = np.concatenate((text, np.zeros(2 * size + 8, np.uint8))).astype(np.uint64)
    key = np.zeros(len(text) + size, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(key)]
    levels, length = [(8, np.unique(key, return_inverse=True)[1].astype(np.uint64))], 8
    while length < size:
        grow = min(length, size - length)
        rank = levels[-1][1]
        far = np.concatenate((rank[grow:], np.zeros(grow, np.uint64)))
        levels.append((length + grow, np.unique((rank << np.uint64(32)) | far, return_inverse=True)[1].astype(np.uint64)))
        length += grow
    order = np.lexsort((when, levels[-1][1][at]))
    place, time, n = at[order], when[order], len(at)

    def smaller(step: int) -> np.ndarray:
        """Index in suffix order of the nearest suffix, backward or forward, that is earlier; -1 or n without one."""
        near, edge, todo = np.arange(n) + step, (-1 if step < 0 else n), np.arange(n)
        while len(todo):
            todo = todo[near[todo] != edge]
            todo = todo[time[near[todo]] >= time[todo]]
            near[todo] = near[near[todo]]
        return near

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal bytes of the suffixes at ``a`` and ``b``, up to ``size``."""
        same = np.zeros(len(a), np.int64)
        for width, rank in reversed(levels[:-1]):
            same += width * (rank[np.minimum(a + same, len(rank) - 1)] == rank[np.minimum(b + same, len(rank) - 1)])
        go = np.ones(len(a), bool)
        for _ in range(7):
            go &= padded[a + same] == padded[b + same]
            same += go
        return np.where(levels[-1][1][a] == levels[-1][1][b], size, np.minimum(same, size - 1))

    best = np.zeros(n, np.int64)
    for near in (smaller(-1), smaller(1)):
        ok = np.flatnonzero((near >= 0) & (near < n))
        best[ok] = np.maximum(best[ok], common(place[ok], place[near[ok]]))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


_TOLD = "block int, ids binary, starts binary, lengths binary, hashes binary"


def _told(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, blocks: int) -> list[tuple]:
    """Removed strings, as runs of starts, by block of documents; the hash of a run's bytes goes along."""
    if not len(ids):
        return []
    block = occ.block_of(ids, blocks)
    order = np.argsort(block, kind="stable")
    cuts = occ._cuts(block[order])
    return [(int(block[order[a]]), *(occ.squeezed(x[order[a:b]]) for x in (ids, starts, lengths, hashes))) for a, b in zip(cuts[:-1], cuts[1:])]


def _bytes_of(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The given parts of ``data`` as a binary column."""
    take = np.repeat(begin, sizes) + c.spread(sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)), pa.py_buffer(data[take])])


def _first_of_each(codes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each code, the earliest, and the mask of rows that are later than it."""
    order = np.lexsort((starts, ids, codes))
    head = occ._cuts(codes[order])[:-1]
    first = order[head]
    lead = np.empty(len(codes), np.int64)
    lead[order] = np.repeat(first, np.diff(np.append(head, len(codes))))
    return first, (ids[lead] < ids) | (starts[lead] < starts)


def _column(docs: pa.Table, name: str) -> pa.Array:
    col = docs.column(name)
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], docs.schema.field(name).type)


def _pieces(size: int, buckets: int, blocks: int, common: np.ndarray):
    def pieces(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        known = occ.Pairs(*occ.reported(found))
        all_ids = docs.column("_id").to_numpy()
        got: list[tuple] = []
        for lo, hi, data, offs in c.slices(_column(docs, "_text")) if len(docs) and len(found) else ():
            at, counts = _valid(offs, size)
            if not len(at):
                continue
            low = anchors(data, size)[1][at]
            edge, ok = np.concatenate(([0], np.cumsum(counts))), np.zeros(len(at), bool)
            for k, one in enumerate(all_ids[lo:hi].tolist()):
                keys, here = known.of(one), low[edge[k] : edge[k + 1]]
                if len(keys) and len(here):
                    ok[edge[k] : edge[k + 1]] = keys[np.minimum(np.searchsorted(keys, here), len(keys) - 1)] == here
            cut = np.concatenate((edge, np.flatnonzero(low[1:] != low[:-1]) + 1))
            a, b = runs(ok, cut)
            anchor = low[a]
            if len(common):
                # a string of a common anchor goes alone, by its own hash
                hot = common[np.minimum(np.searchsorted(common, anchor), len(common) - 1)] == anchor
                n = np.where(hot, b - a, 1)
                a = np.repeat(a, n) + np.where(np.repeat(hot, n), c.spread(n), 0)
                b = np.where(np.repeat(hot, n), a + 1, np.repeat(b, n))
                anchor = np.repeat(anchor, n)
                sums, down = c.rolling(c.BYTE[data])
                anchor = np.where(np.repeat(hot, n), c.mixed((sums[at[a] + size] - sums[at[a]]) * down[at[a]]), anchor)
            row = np.searchsorted(edge, a, "right") - 1
            got.append((all_ids[lo:hi][row], at[a] - offs[row], anchor, b - a, _bytes_of(data, at[a], b - a + size - 1)))
        rows: list[tuple] = []
        if got:
            ids, starts, anchor, n = (np.concatenate([g[i] for g in got]) for i in range(4))
            parts = pa.concat_arrays([g[4] for g in got])
            first, later = _first_of_each(parts.dictionary_encode().indices.to_numpy(), ids, starts)
            rows = [(buckets + t[0], *t[1:], b"") for t in _told(ids[later], starts[later], n[later], _hash_of(parts.filter(pa.array(later))), blocks)]
            bucket = occ.bucket_of(anchor[first], buckets)
            first = first[np.argsort(bucket, kind="stable")]
            cuts = occ._cuts(np.sort(bucket))
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = first[a:b]
                joined = b"".join(parts.take(pa.array(here)).to_pylist())
                rows.append((int(occ.bucket_of(anchor[here[:1]], buckets)[0]), *(occ.squeezed(x[here]) for x in (ids, starts, n, anchor)), occ.squeezed(np.frombuffer(joined, np.uint8))))
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.int64()] + [pa.binary()] * 5)], names=["bucket", "ids", "starts", "sizes", "anchors", "data"])

    return pieces


def _hash_of(parts: pa.Array) -> np.ndarray:
    """Rabin-Karp hash of each part."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offs in c.slices(parts):
        sums, down = c.rolling(c.BYTE[data])
        out.append(c.mixed((sums[offs[1:]] - sums[offs[:-1]]) * down[offs[:-1]]))
    return np.concatenate(out)


def _twice(parts: pa.Array, anchor: np.ndarray) -> np.ndarray:
    """Which parts hold their anchor at two places."""
    out = [np.zeros(0, bool)]
    for lo, hi, data, offs in c.slices(parts):
        sums, down = c.rolling(c.BYTE[data])
        grams = c.mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
        hits = np.flatnonzero(grams == np.repeat(anchor[lo:hi], np.diff(offs))[: len(grams)])
        out.append(np.bincount(np.searchsorted(offs, hits, "right") - 1, minlength=hi - lo)[: hi - lo] > 1)
    return np.concatenate(out)


def _sorted_out(data, begin, ids, starts, n, some, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings of ``some`` pieces, by their suffix array: identifiers, starts, lengths and hashes of their runs."""
    some = some[np.lexsort((starts[some], ids[some]))]
    sz, wn = n[some] + size - 1, n[some]
    text = data[np.repeat(begin[some], sz) + c.spread(sz)]
    at = np.repeat(np.cumsum(sz) - sz, wn) + c.spread(wn)
    owner = np.repeat(np.arange(len(some)), wn)
    start = starts[some][owner] + c.spread(wn)
    order = np.lexsort((start, ids[some][owner]))
    i, s = ids[some][owner][order], start[order]
    when = np.empty(len(at), np.int64)
    when[order] = np.cumsum(np.concatenate(([0], (i[1:] != i[:-1]) | (s[1:] != s[:-1]))))
    a, b = runs(longest_previous(text, at, when, size) >= size, np.cumsum(wn) - wn)
    return ids[some][owner[a]], start[a], b - a, _hash_of(_bytes_of(text, at[a], b - a + size - 1))


def _settled(size: int, buckets: int, blocks: int):
    def settle(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:
            n = len(table)
            return pa.table([pa.array([bucket - buckets] * n, pa.int32()), *(table.column(x).cast(pa.binary()) for x in ("ids", "starts", "sizes", "anchors"))], names=["block", "ids", "starts", "lengths", "hashes"])
        ids, starts, n = (np.concatenate([occ.unsqueezed(b, np.int64) for b in table.column(x).to_pylist()]) for x in ("ids", "starts", "sizes"))
        anchor = np.concatenate([occ.unsqueezed(b, np.uint64) for b in table.column("anchors").to_pylist()])
        data = np.concatenate([occ.unsqueezed(b, np.uint8) for b in table.column("data").to_pylist()])
        del table
        sizes = n + size - 1
        begin = np.cumsum(sizes) - sizes
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)])
        first, later = _first_of_each(parts.dictionary_encode().indices.to_numpy(), ids, starts)
        rows = _told(ids[later], starts[later], n[later], _hash_of(parts.filter(pa.array(later))), blocks)
        # left: pieces whose anchor other texts have too, or that hold it twice
        twice = np.zeros(len(n), bool)
        twice[first] = _twice(parts.take(pa.array(first)), anchor[first])
        _, where, many = np.unique(anchor[first], return_inverse=True, return_counts=True)
        first = first[(many[where] > 1) | twice[first]]
        # strings with different anchors differ: texts of about TEXT bytes, each with all pieces of its anchors
        first = first[np.argsort(anchor[first], kind="stable")]
        head = occ._cuts(anchor[first])
        load = np.concatenate(([0], np.cumsum(sizes[first])))[head]
        cuts = head[np.unique(np.concatenate((np.searchsorted(load, np.arange(0, load[-1], TEXT)), [len(head) - 1])))]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows += _told(*_sorted_out(data, begin, ids, starts, n, first[lo:hi], size), blocks)
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.int32()] + [pa.binary()] * 4)], names=["block", "ids", "starts", "lengths", "hashes"])

    return settle


def _cleaned(size: int):
    def cleaned(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        kinds = (("ids", np.int64), ("starts", np.int64), ("lengths", np.int64), ("hashes", np.uint64))
        ids, starts, n, hashes = (np.concatenate([np.zeros(0, k)] + [occ.unsqueezed(b, k) for b in told.column(x).to_pylist()]) for x, k in kinds)
        order = np.argsort(ids, kind="stable")
        ids, starts, n, hashes = ids[order], starts[order], n[order], hashes[order]
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        parts = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pair)), pa.array([], pa.binary())], names=["_id", "n_bytes", "spans", "kept"])]
        all_ids = docs.column("_id").to_numpy()
        for lo, hi, data, offs in c.slices(_column(docs, "_text")) if len(docs) else ():
            here = all_ids[lo:hi]
            a, b = np.searchsorted(ids, here), np.searchsorted(ids, here, "right")
            pick, row = np.repeat(a, b - a) + c.spread(b - a), np.repeat(np.arange(hi - lo), b - a)
            begin = offs[row] + starts[pick]
            end = begin + n[pick] + size - 1
            # of rows that share an identifier, only those with the bytes that were judged
            ok = end <= offs[row + 1]
            begin, end, pick, row = begin[ok], end[ok], pick[ok], row[ok]
            drop = np.zeros(len(data), bool)
            if len(begin):
                sums, down = c.rolling(c.BYTE[data])
                ok = c.mixed((sums[end] - sums[begin]) * down[begin]) == hashes[pick]
                edge = np.bincount(begin[ok], minlength=len(data) + 1) - np.bincount(end[ok], minlength=len(data) + 1)
                drop = np.cumsum(edge)[: len(data)] > 0
            x, y = runs(drop, offs)
            owner = np.searchsorted(offs, x, "right") - 1
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=hi - lo)))).astype(np.int32)), pa.StructArray.from_arrays([pa.array((x - offs[owner]).astype(np.int32)), pa.array((y - offs[owner]).astype(np.int32))], names=["start", "end"]))
            left = np.concatenate(([0], np.cumsum(~drop)))[offs].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~drop]))])
            parts.append(pa.table([pa.array(here), pa.array(np.diff(offs)), spans, kept], names=["_id", "n_bytes", "spans", "kept"]))
        return pa.concat_tables(parts)

    return cleaned


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, bucket_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal runs of removed bytes, ``kept`` the bytes that stay.
    A byte is removed if a string of ``size`` bytes that covers it also starts
    earlier: in a document with a smaller identifier, or at a smaller place of
    its own.  Strings are judged on the input and lie in one document.  Null
    texts are empty; texts shorter than ``size`` lose nothing.  Rows that share
    an identifier are one document with several texts: what starts at the same
    place of it is not earlier.  A null identifier ranks first.  No rows give no
    rows; further columns are ignored.  Anchors are 64-bit hashes, which decide
    only who meets; strings are compared byte by byte.
    """
    if size <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    c.prepared(docs)
    rows = c.texts(docs, id_col, text_col)
    blocks = c.blocks_for(rows, bucket_bytes)
    found = c.settled(occ.repeated(rows, _pairs(size), blocks, blocks, with_first=True, common=COMMON))

    def unpack(batches):
        for batch in batches:
            keys = [occ.unsqueezed(b, np.uint64).astype(np.int64) for b in batch.column(1).to_pylist()]
            seen = [occ.unsqueezed(b, np.int64) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (keys, seen)], names=["key", "seen"])

    top = found.where("block = -1").select("ids", "keys").mapInArrow(unpack, "key long, seen long").orderBy(F.col("seen").desc(), "key").limit(COMMON_LIST)
    common = np.sort(np.array([r["key"] for r in top.collect()], np.int64).view(np.uint64))
    placed = occ.blocked(rows, blocks)
    pieces = placed.groupBy("block").cogroup(found.where("block >= 0").groupBy("block")).applyInArrow(_pieces(size, blocks, blocks, common), "bucket long, ids binary, starts binary, sizes binary, anchors binary, data binary")
    told = pieces.groupBy("bucket").applyInArrow(_settled(size, blocks, blocks), _TOLD)
    out = placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cleaned(size), _OUT)
    return out.select(c.id_back().alias("doc_id"), "n_bytes", "spans", "kept")
