"""Which 64-bit keys of which documents also occur earlier: packed exchanges shared by the two substring operators.

A mapper gathers keys of many documents and settles what it can see alone: of
equal keys it sends one, with the smallest identifier, so a key that a third of
all documents share arrives once per mapper.  Keys are dealt to buckets by range
and travel sorted, as differences, in one compressed row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a mapper gathers before it sends them.
FLUSH = 1_500_000

SENT = "bucket long, ids binary, keys binary, more binary"
FOUND = "block int, ids binary, keys binary"


def squeezed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8)) if len(a) else b""


def unsqueezed(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind) if b else np.zeros(0, kind)


def planes(a: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, so that equal bytes meet."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return squeezed(np.ascontiguousarray(d.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).ravel())


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = unsqueezed(b, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view(kind), dtype=kind)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a document, as BLOCK_SQL has it."""
    u = ids.view(np.uint64)
    low = (u ^ (u >> np.uint64(31))) & np.uint64(2**31 - 1)
    return ((low * np.uint64(2654435761) >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)


BLOCK_SQL = "CAST(pmod(shiftright(((_id ^ shiftrightunsigned(_id, 31)) & 2147483647L) * 2654435761L, 20), {}) AS INT)"


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)])) if len(values) else np.zeros(1, np.int64)


def found_rows(ids: np.ndarray, keys: np.ndarray, blocks: int) -> list[tuple]:
    """(document, key) pairs as one row per block of documents."""
    block = block_of(ids, blocks)
    order = np.lexsort((ids, block))
    ids, keys, block = ids[order], keys[order], block[order]
    cuts = _cuts(block)
    return [(int(block[a]), planes(ids[a:b]), squeezed(keys[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]


def settle(ids: np.ndarray, keys: np.ndarray, with_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: the distinct keys, their smallest identifiers and numbers of pairs, and as a mask of pairs the ones to report.

    Reported are pairs whose key has a smaller identifier or, ``with_first``, any other pair.
    """
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    cuts = _cuts(keys)
    starts, counts = cuts[:-1], np.diff(cuts)
    low = np.minimum.reduceat(ids, starts) if len(ids) else ids
    again = np.repeat(counts > 1, counts)
    said = np.zeros(len(keys), bool)
    said[order] = again if with_first else again & (ids > np.repeat(low, counts))
    return keys[starts], low, counts, said, order


def send(ids: np.ndarray, keys: np.ndarray, buckets: int, blocks: int, with_first: bool) -> pa.RecordBatch:
    """What a mapper sends for gathered pairs (document, key)."""
    unique, low, counts, said, _ = settle(ids, keys, with_first)
    names = np.unique(low)
    which = np.searchsorted(names, low).astype(np.uint16 if len(names) < 65536 else np.uint32)
    bucket = bucket_of(unique, buckets)
    cuts = _cuts(bucket)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        here = np.unique(which[a:b])
        index = np.searchsorted(here, which[a:b]).astype(np.uint16 if len(here) < 65536 else np.uint32)
        more = np.minimum(counts[a:b], 65535).astype(np.uint16)
        rows.append((int(bucket[a]), planes(names[here]), planes(unique[a:b]), squeezed(np.concatenate((np.array([index.dtype.itemsize], np.uint8), index.view(np.uint8), more.view(np.uint8))))))
    # what is settled here goes past the buckets, dealt by block of documents
    rows += [(buckets + block, ids_, keys_, None) for block, ids_, keys_ in found_rows(ids[said], keys[said], blocks)]
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "ids", "keys", "more"])


def gather(pairs: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, blocks: int, with_first: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for ids, keys in pairs:
        held.append((ids, keys))
        size += len(keys)
        if size >= FLUSH:
            yield send(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), buckets, blocks, with_first)
            held, size = [], 0
    if size:
        yield send(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), buckets, blocks, with_first)


def meet(buckets: int, blocks: int, with_first: bool, common: int | None = None) -> Callable[[tuple, pa.Table], pa.Table]:
    """Reducer of one bucket: rows of :data:`FOUND`.

    With ``common``, keys that ``common`` pairs or more have are also told in a
    row of block -1 (ids: the numbers of pairs).
    """

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:
            parts = [(unplanes(i, np.int64), unsqueezed(k, np.uint64)) for i, k in zip(table.column("ids").to_pylist(), table.column("keys").to_pylist())]
            rows = [(bucket - buckets, planes(i), squeezed(k)) for i, k in parts]
        else:
            ids, keys, seen = [], [], []
            for i, k, m in zip(*(table.column(n).to_pylist() for n in ("ids", "keys", "more"))):
                names, these, raw = unplanes(i, np.int64), unplanes(k, np.uint64), unsqueezed(m, np.uint8)
                kind = np.uint16 if raw[0] == 2 else np.uint32
                split = 1 + len(these) * int(raw[0])
                ids.append(names[np.frombuffer(raw[1:split].tobytes(), kind)])
                seen.append(np.frombuffer(raw[split:].tobytes(), np.uint16).astype(np.int64))
                keys.append(these)
            ids, keys, seen = np.concatenate(ids), np.concatenate(keys), np.concatenate(seen)
            unique, _, counts, said, order = settle(ids, keys, with_first)
            rows = found_rows(ids[said], keys[said], blocks)
            if common:
                total = np.add.reduceat(seen[order], np.concatenate(([0], np.cumsum(counts)[:-1])))
                hot = total >= common
                if hot.any():
                    rows.append((-1, squeezed(total[hot]), squeezed(unique[hot])))
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([pa.array(col, t) for col, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["block", "ids", "keys"])

    return reduce


def repeated(docs: DataFrame, pairs: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int, blocks: int, with_first: bool, common: int | None = None) -> DataFrame:
    """Rows of :data:`FOUND` for the (document, key) pairs that ``pairs`` makes of each batch of ``docs``."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gather((p for batch in batches for p in pairs(batch)), buckets, blocks, with_first)

    return docs.mapInArrow(mapper, SENT).groupBy("bucket").applyInArrow(meet(buckets, blocks, with_first, common), FOUND)


def reported(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All (document, key) pairs of a block."""
    ids = [unplanes(b, np.int64) for b in found.column("ids").to_pylist()]
    keys = [unsqueezed(b, np.uint64) for b in found.column("keys").to_pylist()]
    return (np.concatenate(ids), np.concatenate(keys)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Pairs:
    """Membership of (document, key) pairs."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray):
        order = np.lexsort((keys, ids))
        self.ids, self.keys = ids[order], keys[order]

    def of(self, one: int) -> np.ndarray:
        a, b = np.searchsorted(self.ids, [one, one + 1]) if one < 2**63 - 1 else (np.searchsorted(self.ids, one), len(self.ids))
        return self.keys[a:b]


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("block", F.expr(BLOCK_SQL.format(blocks)))
