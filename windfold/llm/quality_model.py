"""Byte-level convolutional quality classifier in NumPy.

A document is read in overlapping chunks that cover all its bytes.  In a chunk,
learned filters run over embedded bytes, each filter's largest answer is kept,
and a small dense layer makes chunk features; their mean and maximum over the
chunks give one probability.  Training is mini-batch Adam on a bounded sample of
labelled rows on the driver; scoring is one pass over the table, in which Spark
only reads and maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c

#: Embedding size, filters, hidden units; bytes between filter places and of a filter; places between chunks, which are two hops long.
EMB, FILTERS, HIDDEN, STRIDE, WIDTH, HOP = 6, 24, 16, 4, 12, 32
#: Rows of each label, at most, that a fit reads, steps of the fit, rows of a step and bytes of a row, at most, that a step reads.
SAMPLE, FIT_STEPS, BATCH, CROP = 1500, 700, 24, 20_000
#: Bytes of all rows that a fit reads: room for CROP bytes of each.
SAMPLE_BYTES = 2 * SAMPLE * CROP
PAD = 256


class ByteNet:
    """The network and its fit; weights are a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 11):
        if weights is None:
            r = np.random.default_rng(seed)
            make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
            weights = {"emb": make(PAD + 1, EMB, scale=0.5), "conv": make(WIDTH * EMB, FILTERS, scale=(WIDTH * EMB) ** -0.5), "cb": np.zeros(FILTERS, np.float32), "dense": make(FILTERS, HIDDEN, scale=FILTERS**-0.5), "db": np.zeros(HIDDEN, np.float32), "out": make(2 * HIDDEN, scale=0.1), "ob": np.zeros(1, np.float32)}
        self.w = weights

    @staticmethod
    def layout(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded bytes of all rows, the first hop of each chunk and the number of chunks of each row.

        A row takes whole hops, at least two, and ends with padding as long as a
        filter reaches beyond its place, so that no filter sees two rows.
        """
        sizes = np.diff(offs)
        hops = np.maximum(-(-(sizes + WIDTH) // (HOP * STRIDE)), 2)
        begin = np.concatenate(([0], np.cumsum(hops)))
        padded = np.full(begin[-1] * HOP * STRIDE, PAD, np.int64)
        padded[np.repeat(begin[:-1] * HOP * STRIDE - offs[:-1], sizes) + np.arange(len(data))] = data
        return padded, np.repeat(begin[:-1], hops - 1) + c.spread(hops - 1), hops - 1

    def answers(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded groups of STRIDE bytes, and each filter's answer at each place."""
        groups = np.take(self.w["emb"], padded, axis=0, mode="clip").reshape(-1, STRIDE * EMB)
        width = STRIDE * EMB
        out = groups @ self.w["conv"][:width]
        for k in range(1, WIDTH // STRIDE):
            out[:-k] += groups[k:] @ self.w["conv"][k * width : (k + 1) * width]
        return groups, out

    def chunk_features(self, padded: np.ndarray, first: np.ndarray, keep: bool = False):
        groups, out = self.answers(padded)
        # the last places of a row would reach into the next one: padding alone, never the largest
        reach = WIDTH // STRIDE - 1
        ends = np.append(np.flatnonzero(np.diff(first) > 1) + 1, len(first)) - 1
        for k in range(reach):
            out[(first[ends] + 2) * HOP - 1 - k] = -1e9
        hops = out.reshape(-1, HOP, FILTERS)
        if not keep:
            top = hops.max(1)
            return np.maximum(top[first], top[first + 1]) + self.w["cb"], None
        at = hops.argmax(1)
        top = np.take_along_axis(hops, at[:, None, :], 1)[:, 0]
        later = top[first + 1] > top[first]
        place = np.where(later, at[first + 1] + (first[:, None] + 1) * HOP, at[first] + first[:, None] * HOP)
        return np.maximum(top[first], top[first + 1]) + self.w["cb"], (groups, place)

    def forward(self, data: np.ndarray, offs: np.ndarray, keep: bool = False):
        w = self.w
        padded, first, chunks = self.layout(data, offs)
        pooled, more = self.chunk_features(padded, first, keep)
        act = np.maximum(pooled, 0)
        hid = act @ w["dense"] + w["db"]
        h = np.maximum(hid, 0)
        edge = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        mean = np.add.reduceat(h, edge, axis=0) / chunks[:, None]
        most = np.maximum.reduceat(h, edge, axis=0)
        doc = np.concatenate((mean, most), 1)
        logit = doc @ w["out"] + w["ob"]
        return logit, (padded, first, chunks, pooled, act, hid, h, most, doc, more) if keep else None

    def step_gradients(self, data: np.ndarray, offs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        logit, (padded, first, chunks, pooled, act, hid, h, most, doc, (grid, at)) = self.forward(data, offs, True)
        g = {}
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g["out"], g["ob"] = doc.T @ d, np.array([d.sum()], np.float32)
        ddoc = d[:, None] * w["out"]
        row = np.repeat(np.arange(len(chunks)), chunks)
        dh = ddoc[row, :HIDDEN] / chunks[row, None]
        hit = h == most[row]
        share = np.add.reduceat(hit.astype(np.float32), np.concatenate(([0], np.cumsum(chunks)[:-1])), axis=0)
        dh += ddoc[row, HIDDEN:] * hit / share[row]
        dhid = dh * (hid > 0)
        g["dense"], g["db"] = act.T @ dhid, dhid.sum(0)
        dpool = (dhid @ w["dense"].T) * (pooled > 0)
        g["cb"] = dpool.sum(0)
        conv, demb = np.zeros_like(w["conv"]), np.zeros_like(w["emb"])
        for f in range(FILTERS):
            rows = grid[at[:, f, None] + np.arange(WIDTH // STRIDE)].reshape(len(at), -1)
            conv[:, f] = rows.T @ dpool[:, f]
            into = (dpool[:, f : f + 1] * w["conv"][:, f]).reshape(len(rows), WIDTH, EMB)
            where = padded[at[:, f, None] * STRIDE + np.arange(WIDTH)]
            for e in range(EMB):
                demb[:, e] += np.bincount(where.ravel(), weights=into[:, :, e].ravel(), minlength=PAD + 1).astype(np.float32)
        g["conv"], g["emb"] = conv, demb
        return g

    def fit(self, rows: list[bytes], labels: list[int], steps: int = FIT_STEPS, seed: int = 5) -> "ByteNet":
        """Adam on batches with as many rows of either label; one label alone gives a constant answer."""
        y = np.array(labels)
        kinds = [np.flatnonzero(y == k) for k in (0, 1)]
        if not len(kinds[0]) or not len(kinds[1]):
            self.w["out"][:] = 0
            self.w["ob"][:] = 4.0 if len(kinds[1]) else (-4.0 if len(kinds[0]) else 0.0)
            return self
        r, m, v = np.random.default_rng(seed), {}, {}
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(k, BATCH // 2) for k in kinds])
            parts = [np.frombuffer(rows[i], np.uint8) for i in pick]
            parts = [p if len(p) <= CROP else p[(s := int(r.integers(len(p) - CROP))) : s + CROP] for p in parts]
            offs = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            g = self.step_gradients(np.concatenate(parts), offs, y[pick].astype(np.float32))
            rate = 0.01 * min(1, t / 20) * (0.5 + 0.5 * np.cos(np.pi * t / steps))
            for k in g:
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(data, offs)[0].astype(np.float64)))


def held_out(key: str = "doc_id"):
    """crc32 of the identifier's text, modulo 4, is 2; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def row_limit(sizes: list[int], total: int) -> int:
    """The largest limit with which rows of ``sizes``, each cut to it, have ``total`` bytes at most; no row is cut if all fit."""
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > total:
            return total // (len(sizes) - k)
        total -= size
    return max(sizes, default=0)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """At most ``sample`` different rows of either label that are not held out, in an order by hash, and ``sample_bytes`` bytes of them.

    No row is left out for its size.  If the rows have more bytes, the longest
    are cropped to one limit, at places by hash; it is at least ``sample_bytes``
    over twice ``sample``.
    """
    marked = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_key"), "quality").dropDuplicates(["_key"])
    picked = [marked.where(F.col("quality") == k).orderBy(F.xxhash64("_key"), "_key").limit(sample) for k in (0, 1)]
    # at most 2 * sample rows, but an identifier can have many texts
    few = picked[0].unionByName(picked[1])
    text = docs.select(F.col("doc_id").alias("_key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    order = F.xxhash64("_key", "_hash")
    sized = text.join(F.broadcast(few), "_key").select("_key", "quality", "_hash", F.octet_length("_text").alias("_size")).dropDuplicates(["_key", "_hash"])
    chosen = [sized.where(F.col("quality") == k).orderBy(order, "_key", "_hash").limit(sample) for k in (0, 1)]
    chosen = c.settled(chosen[0].unionByName(chosen[1]))
    limit = row_limit([r["_size"] for r in chosen.select("_size").collect()], sample_bytes)
    begin = F.pmod(order, F.greatest(F.col("_size") - limit, F.lit(0)) + 1).cast("int")
    parts = text.join(F.broadcast(chosen), ["_key", "_hash"]).select("_key", "_hash", "quality", F.substring("_text", begin + 1, F.lit(limit)).alias("_part"))
    rows, got = [], []
    for row in parts.dropDuplicates(["_key", "_hash"]).orderBy(order, "_key", "_hash").toLocalIterator():
        rows.append(bytes(row["_part"]))
        got.append(int(row["quality"]))
    return rows, got


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = FIT_STEPS, sample_bytes: int = SAMPLE_BYTES) -> ByteNet:
    return ByteNet().fit(*sample_rows(docs, labels, sample, sample_bytes), steps=steps)


def scored(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row: the probability of quality 1.

    Null and empty texts are one chunk of padding.  Rows are scored one by one,
    whatever their identifiers; further columns are ignored.
    """
    c.prepared(docs)
    weights = net.w

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNet(weights)
        for batch in batches:
            out = [model.scores(data, offs) for _, _, data, offs in c.slices(batch.column(1), 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["_id", "score"])

    return c.texts(docs, id_col, text_col).mapInArrow(answer, "_id long, score double").select(c.id_back().alias("doc_id"), "score")


def keep_good(docs: DataFrame, net: ByteNet, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    c.prepared(docs)
    weights, at, schema = net.w, docs.columns.index(text_col), docs.schema

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNet(weights)
        for batch in batches:
            filled = batch.column(at).fill_null("")
            keep = [model.scores(data, offs) >= threshold for _, _, data, offs in c.slices(filled, 1 << 18)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(good, schema)
