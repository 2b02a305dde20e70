"""Embedding near-dedup by random-hyperplane hashing.

Vectors with equal components are one class.  Each class is hashed in several
tables, a table being the signs of its dot products with some fixed random
directions.  Classes with one code in a table meet and are compared by exact
cosines in double precision, as blocks of a matrix product; a pair that meets
in several tables counts in the first.  Links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c
from windfold.llm.components import components, forest

#: Sign bits of a table, and tables: a pair at cosine 0.93 meets with probability 0.9971.
BITS, TABLES = 12, 24
#: Classes of one code that one task compares; more are cut into parts, and all pairs of parts are compared.
PART = 1024


def directions(size: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, BITS * TABLES))


def codes(vectors: np.ndarray) -> np.ndarray:
    """Code of each vector in each table."""
    signs = (vectors @ directions(vectors.shape[1])) >= 0
    return (signs.reshape(len(vectors), TABLES, BITS) << np.arange(BITS)).sum(2).astype(np.int16)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, n = (batch.column(i).to_numpy() for i in range(3))
        rows = batch.column(3)
        flat, sizes = rows.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(rows.offsets))
        begin = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            pick = np.flatnonzero(sizes == size)
            v = flat[begin[pick][:, None] + np.arange(size)].astype(np.float64)
            # scaled first, so that squares neither overflow nor vanish
            unit = v / np.abs(v).max(1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            code = codes(unit)
            table = np.tile(np.arange(TABLES), len(pick))
            at = np.repeat(np.arange(len(pick)), TABLES)
            key = (table.astype(np.int64) << BITS) | code.ravel()
            key = c.mixed((key.astype(np.uint64) << np.uint64(20)) ^ labels[pick][at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(size)).astype(np.int64)
            blob, sign = [x.tobytes() for x in unit], [x.tobytes() for x in code]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(table, pa.int32()), pa.array(ids[pick][at]), pa.array(labels[pick][at]), pa.array(n[pick][at]), pa.array([blob[i] for i in at], pa.binary()), pa.array([sign[i] for i in at], pa.binary())], names=["key", "tab", "node", "label", "n", "unit", "code"])


_LINKS = "node long, links long, other long"


def _compare(threshold: float, ids, labels, n, unit, code, table, part, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs between parts ``a`` and ``b`` that link and meet in no earlier table."""
    left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
    out = []
    for lo in range(0, len(left), PART):
        rows = left[lo : lo + PART]
        for at in range(0, len(right), PART):
            cols = right[at : at + PART]
            x, y = np.nonzero(unit[rows] @ unit[cols].T >= threshold)
            i, j = rows[x], cols[y]
            ok = (labels[i] == labels[j]) & ((i < j) if a == b else (ids[i] != ids[j]))
            i, j = i[ok], j[ok]
            ok = ~((code[i] == code[j]) & (np.arange(TABLES) < table)).any(1)
            out.append((i[ok], j[ok]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _linked(threshold: float):
    """Streams rows sorted by (key, a, b): compares each group and tells link counts and a spanning forest."""

    def group(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        if len(t) < 2:
            return
        col = {k: t.column(k).to_numpy(zero_copy_only=False) for k in ("tab", "node", "label", "n", "a", "b", "part")}
        unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(t), -1)
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int16).reshape(len(t), TABLES)
        i, j = _compare(threshold, col["node"], col["label"], col["n"], unit, code, int(col["tab"][0]), col["part"], int(col["a"][0]), int(col["b"][0]))
        if not len(i):
            return
        links = np.bincount(i, weights=col["n"][j], minlength=len(t)) + np.bincount(j, weights=col["n"][i], minlength=len(t))
        hit = np.flatnonzero(links)
        x, y = forest(col["node"][i], col["node"][j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((col["node"][hit], x))), pa.array(np.concatenate((links[hit].astype(np.int64), np.zeros(len(x), np.int64)))), pa.array(np.concatenate((col["node"][hit], y)))], names=["node", "links", "other"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            marks = [batch.column(k).to_numpy() for k in ("key", "a", "b")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                piece = batch.slice(lo, hi - lo)
                if held and k == 0 and any(held[-1].column(n)[0] != piece.column(n)[0] for n in ("key", "a", "b")):
                    yield from group(held)
                    held = []
                elif k:
                    yield from group(held)
                    held = []
                held.append(piece)
        if held:
            yield from group(held)

    return linked


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null, their sizes are equal
    and their cosine, in double precision, is at least ``threshold``.  Null,
    empty and zero vectors and those with null or non-finite components link
    with nothing.  Repeated rows link with each other; of rows with the smallest
    identifier of a component all are kept.  A null identifier ranks first.
    No rows give no rows; further columns are ignored.

    Every vector is hashed, and every pair that meets in one of TABLES tables is
    compared: pairs at the threshold are found with probability 0.997, closer
    ones with a higher one.  Codes that many vectors share are cut into parts of
    PART rows; each pair of parts is compared, so no pair is left out.
    """
    c.prepared(vectors)
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(c.key_of(id_col).alias("_id"), F.col(label_col).cast("long").alias("label"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    # two hashes and the label name a class
    # two hashes and the label name a class; a slot cuts a class with very many rows into parts
    key = ["label", "h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v", F.lit(2)), "slot": F.pmod(F.xxhash64("_id"), F.lit(64)).cast("int")})
    slots = rows.where("v IS NOT NULL").groupBy(*key, "slot").agg(F.min("_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"))
    slots = c.settled(slots)
    classes = c.settled(slots.groupBy(*key).agg(F.min("node").alias("node"), F.sum("n").alias("n"), F.first("v").alias("v")))
    spread = classes.select("node", "label", "n", "v").mapInArrow(_hashed, "key long, tab int, node long, label long, n long, unit binary, code binary")
    spread = c.settled(spread)
    busy = spread.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1")
    parts = F.ceil(F.col("_m") / PART).cast("int")
    met = spread.join(busy, "key").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    met = met.withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1))).select("key", F.least("part", "_with").alias("a"), F.greatest("part", "_with").alias("b"), "part", "tab", "node", "label", "n", "unit", "code")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = c.settled(met.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_linked(threshold), _LINKS))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.where("node <> other"), "node", "other")
    named = classes.select(*key, "node", "n").join(counts, "node", "left").join(roots, "node", "left")
    named = named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = slots.select(*key, "slot").join(named, key)
    # rows without a vector match no class: they are dealt by identifier
    mine = rows.select("_id", F.when(F.col("v").isNotNull(), F.col("label")).otherwise(F.xxhash64("_id")).alias("label"), "h1", F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2"), "slot")
    out = mine.join(named, [*key, "slot"], "left").select("_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "_id").alias("_root"))
    return out.select(c.id_back().alias("vec_id"), "n_links", c.id_back("_root").alias("component_id"), (F.col("_id") == F.col("_root")).alias("kept"))
