"""Substring dedup over windows of words.

Every window of ``n`` consecutive words has a Rabin-Karp hash.  Spark counts the
hashes: a window whose hash has a smaller identifier too, or stands earlier in
its own document, is repeated.  Repeated windows of a document merge into maximal
intervals, and their words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c
from windfold.llm import occurrences as occ

_OUT = "_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"


def _pairs(n: int):
    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column(0).to_numpy()
        for lo, hi, data, offs in c.slices(batch.column(1)):
            starts, ends, first = c.words(data, offs)
            keys, _, counts = c.windows(c.word_hashes(data, starts, ends), first, n)
            yield np.repeat(ids[lo:hi], counts), keys

    return pairs


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of ``size`` places: those in a window of ``n`` that begins at one of ``at``."""
    edge = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return np.cumsum(edge)[:size] > 0


def runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of ``mask``, none across ``cuts``."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[cuts] = True
    before = np.concatenate(([False], mask[:-1])) & ~edge[:-1]
    after = np.concatenate((mask[1:], [False])) & ~edge[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def _cleaned(n: int):
    def cleaned(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        known = occ.Pairs(*occ.reported(found))
        ids_all = docs.column("_id").to_numpy()
        text = docs.column("_text")
        text = text.chunk(0) if text.num_chunks == 1 else pa.concat_arrays(text.chunks) if text.num_chunks else None
        parts = []
        for lo, hi, data, offs in c.slices(text) if len(docs) else ():
            starts, ends, first = c.words(data, offs)
            keys, at, counts = c.windows(c.word_hashes(data, starts, ends), first, n)
            edge = np.concatenate(([0], np.cumsum(counts)))
            gone = np.zeros(len(keys), bool)
            for k, one in enumerate(ids_all[lo:hi].tolist()):
                here = keys[edge[k] : edge[k + 1]]
                if len(here) > 1:
                    # later windows of the document itself
                    order = np.argsort(here, kind="stable")
                    gone[edge[k] + order[1:][here[order[1:]] == here[order[:-1]]]] = True
                if len(here) and len(old := known.of(one)):
                    gone[edge[k] : edge[k + 1]] |= old[np.minimum(np.searchsorted(old, here), len(old) - 1)] == here
            drop = covered(at[gone], n, len(starts))
            a, b = runs(drop, first)
            owner = np.searchsorted(first, a, "right") - 1
            # kept words, each but a row's last with one byte of the white space behind it, made a space
            keep = np.flatnonzero(~drop)
            row = np.searchsorted(first, keep, "right") - 1
            last = np.append(row[1:] != row[:-1], True) if len(keep) else np.zeros(0, bool)
            sizes = ends[keep] - starts[keep] + ~last
            take = np.repeat(starts[keep], sizes) + c.spread(sizes)
            out = data[np.minimum(take, max(len(data) - 1, 0))]
            out[np.cumsum(sizes)[~last] - 1] = 0x20
            per_row = np.bincount(row, weights=sizes, minlength=hi - lo).astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
            kept = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(begin), pa.py_buffer(out))
            span_at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=hi - lo)))).astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array((a - first[owner]).astype(np.int32)), pa.array((b - first[owner]).astype(np.int32))], names=["start", "end"])
            parts.append(pa.table([pa.array(ids_all[lo:hi]), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(span_at), pair), kept], names=["_id", "n_words", "spans", "kept"]))
        if parts:
            return pa.concat_tables(parts)
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pair)), pa.array([], pa.string())], names=["_id", "n_words", "spans", "kept"])

    return cleaned


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, kept``.

    ``spans`` are the maximal intervals of removed words, ``kept`` the words that
    stay, joined by one space.  A word is removed if a window of ``n`` words that
    covers it also starts earlier: in a document with a smaller identifier, or
    earlier in the same row.  Windows are judged on the input.  Null texts and
    texts of fewer than ``n`` words lose nothing.  Rows that share an identifier
    do not outrank one another.  A null identifier ranks first.  No rows give no
    rows; further columns are ignored.  Buckets and blocks grow with the bytes of
    all texts.  Hashes have 64 bits: among w windows about w * w / 2**65 pairs of
    different windows are taken as equal.
    """
    c.prepared(docs)
    rows = c.texts(docs, id_col, text_col)
    blocks = c.blocks_for(rows, bucket_bytes)
    found = occ.repeated(rows, _pairs(n), blocks, blocks, with_first=False)
    out = occ.blocked(rows, blocks).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cleaned(n), _OUT)
    return out.select(c.id_back().alias("doc_id"), "n_words", "spans", "kept")
