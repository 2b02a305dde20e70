"""N-gram Jaccard self-join by size: subsets of light sets, inverted lists of heavy ones.

Two sets of sizes s and t link at Jaccard similarity j when they share at least
o = ceil(j (s + t) / (1 + j)) elements.  Light sets are small enough to list all
their subsets of each such size o: sets that share a listed subset link, and
nothing is left to verify.  Heavy sets go through inverted lists of their
rarest elements, of which two similar sets must share one.  How many sets hold
an element is counted for all of them first, so an element of one set alone needs
no list, and a set with enough of those none at all.  The boundary is the size at
which listing subsets costs more than scanning lists.

Equal sets are one class from the start.  The sets of a list that can be similar
by size form a chain; chains give families, and each family is verified in one
place, with all elements of its sets, through lists of its own and without
comparing sets that are connected already.  A family too large for one task is
cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c
from windfold.llm import occurrences as occ
from windfold.llm.components import Union, components, forest

#: Bits of the filter of documents whose sets are needed again.
FILTER = 1 << 24
#: Bits of an element that its count goes by: elements that agree in them only look shared, which costs a list entry.
_SEEN = np.uint64(2**64 - 2**24)
#: Sets from this size on were listed by groups of elements; now those of all sizes are listed by single ones, and it is not read.
PARTS = 1024
#: Largest size that can be light, cost of a list entry in subsets, and sets of a family that one task verifies.
LIGHT_MOST, LIST_COST, FAMILY = 24, 8, 4096


def need(s: int, t: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes ``s`` and ``t`` with similarity num / den."""
    return -(-num * (s + t) // (num + den))


def overlaps(s: int, bound: int, num: int, den: int) -> list[int]:
    """Subset sizes that a light set of size ``s`` lists, for partners of size ``bound`` at most."""
    return sorted({o for t in range(-(-num * s // den), min(bound, den * s // num) + 1) if t and (o := need(s, t, num, den)) <= min(s, t)})


def prefix(s: np.ndarray, num: int, den: int) -> np.ndarray:
    return s - -(-num * s // den) + 1


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """Largest light size: subsets of light sets and list entries of heavy ones cost least; sets just below can meet heavy ones and are listed too."""

    def cost(x: int) -> int:
        light = sum(n * sum(comb(s, o) for o in overlaps(s, x, num, den)) for s, n in histogram.items() if s <= x)
        return light + LIST_COST * sum(n * int(prefix(np.int64(s), num, den)) for s, n in histogram.items() if den * s > num * x)

    return min(range(LIGHT_MOST + 1), key=cost)


def _sets(n: int, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending in a row, and where each row's begin."""
    starts, ends, first = c.words(data, offs)
    hashes = c.word_hashes(data, starts, ends, c.BYTE_LOWER)
    keys, _, counts = c.windows(hashes, first, n)
    row = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((np.diff(first) > 0) & (counts == 0))
    if len(short):
        sums, down = c.rolling(hashes)
        a, b = first[short], first[short + 1]
        row, keys = np.concatenate((row, short)), np.concatenate((keys, c.mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def _class_of(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit name of each row's set; empty sets have 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mixed(keys), dtype=np.uint64)))
    other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mixed(keys ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    size = np.diff(at).astype(np.uint64)
    name = c.mixed((sums[at[1:]] - sums[at[:-1]]) ^ c.mixed(other[at[1:]] - other[at[:-1]] + size))
    return np.where(size > 0, name, np.uint64(0)).view(np.int64)


def _named(n: int):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_sets(n, data, offs) for _, _, data, offs in c.slices(batch.column(1))]
            size = np.concatenate([np.diff(at) for _, at in out]) if out else np.zeros(0, np.int64)
            name = np.concatenate([_class_of(k, at) for k, at in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(name)], names=["_id", "size", "cls"])

    return named


def _subsets(keys: np.ndarray, bound: int, num: int, den: int) -> Iterator[int]:
    """Names of the listed subsets of a light set, each with its size in the low byte."""
    mixed = c.mixed(keys).tolist()
    total = sum(mixed)
    for o in overlaps(len(keys), bound, num, den):
        # a subset is named by the sum of its elements: what is left out is the smaller choice
        for out in combinations(mixed, len(keys) - o):
            yield (((total - sum(out)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFF00) ^ (o << 40) & 0xFFFFFFFFFFFFFF00) | o


def packed(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, buckets: int, shift: int = 0) -> list[tuple]:
    """Distinct postings as one row per bucket."""
    order = np.lexsort((names, keys))
    keys, names, sizes = keys[order], names[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
    keys, names, sizes = keys[new], names[new], sizes[new]
    bucket = occ.bucket_of(keys, buckets)
    cuts = occ._cuts(bucket)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        here, head, which = np.unique(names[a:b], return_index=True, return_inverse=True)
        rows.append((int(bucket[a]) + shift, occ.planes(keys[a:b]), occ.squeezed(which.astype(np.uint32)), occ.planes(here), occ.squeezed(sizes[a:b][head].astype(np.int64))))
    return rows


def _numbers(a: np.ndarray) -> bytes:
    """Small numbers in any order, byte by byte."""
    return occ.squeezed(np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel())


def _unnumbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(occ.unsqueezed(b, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


_SENT = "bucket long, share long, keys binary, which binary, names binary, sizes binary"
_SHARED = "share long, keys binary, which binary, names binary, sizes binary, seen binary"
_POSTED = "bucket long, keys binary, which binary, names binary, sizes binary"


def _as_table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table([pa.array(x, pa.int64() if k == "long" else pa.binary()) for x, k in zip(cols, kinds)], names=list(names))


def _sent(n: int, num: int, den: int, bound: int, buckets: int):
    """Elements of heavy sets packed by bucket, beside them names and sizes of the sets of a share, which one mapper gathers; subsets of light sets in the buckets behind."""

    def send(heavy: list, light: list, turn: int) -> pa.RecordBatch:
        rows: list[tuple] = []
        if heavy:
            names, sizes = np.concatenate([h[0] for h in heavy]), np.concatenate([h[1] for h in heavy])
            _, once = np.unique(names, return_index=True)
            keep = np.zeros(len(names), bool)
            keep[once] = True
            keys = np.concatenate([h[2] for h in heavy])[np.repeat(keep, sizes)]
            names, sizes = names[keep], sizes[keep]
            owner = np.repeat(np.arange(len(names)), sizes)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            task = np.uint64((TaskContext.get().partitionId() << 24) + turn)
            share = int(c.mixed(names.view(np.uint64) * np.uint64(2 * len(names) + 1) + c.mixed(task + np.arange(len(names), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64) >> np.uint64(2))
            bucket = occ.bucket_of(keys, buckets)
            cuts = occ._cuts(bucket)
            rows += [(int(bucket[a]), share, occ.planes(keys[a:b]), _numbers(owner[a:b]), None, None) for a, b in zip(cuts[:-1], cuts[1:])]
            rows.append((2 * buckets + share % buckets, share, None, None, occ.squeezed(names), occ.squeezed(sizes.astype(np.int64))))
        if light:
            rows += [(row[0], -1, *row[1:]) for row in packed(*(np.concatenate([x[i] for x in light]) for i in range(3)), buckets, buckets)]
        return _as_table(rows, _SENT).to_batches()[0]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, light, held, turn = [], [], 0, 0
        for batch in batches:
            for _, _, data, offs in c.slices(batch.column(1)):
                keys, at = _sets(n, data, offs)
                size, names = np.diff(at), _class_of(keys, at)
                large = (size > 0) & (den * size > num * bound)
                if large.any():
                    heavy.append((names[large], size[large], keys[np.repeat(large, size)] & _SEEN))
                    held += len(heavy[-1][2])
                for k in np.flatnonzero((size > 0) & (size <= bound)).tolist():
                    sub = np.fromiter(_subsets(keys[at[k] : at[k + 1]], bound, num, den), np.uint64)
                    light.append((sub, np.full(len(sub), names[k]), np.full(len(sub), size[k])))
                    held += len(sub)
                if held >= occ.FLUSH:
                    yield send(heavy, light, turn)
                    heavy, light, held, turn = [], [], 0, turn + 1
        if held:
            yield send(heavy, light, turn)

    return sent


def _shared(buckets: int):
    """Of a bucket's elements those that more than one set holds, back to their shares, with the number of sets; all else as it is."""

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        bucket, share = key[0].as_py(), table.column("share").to_pylist()
        if bucket >= buckets:
            back = share if bucket >= 2 * buckets else [-bucket] * len(share)
            return _as_table([(*row, None) for row in zip(back, *(table.column(k).to_pylist() for k in ("keys", "which", "names", "sizes")))], _SHARED)
        parts = [occ.unplanes(k, np.uint64) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        counts = np.diff(occ._cuts(keys[order]))
        seen = np.empty(len(keys), np.int64)
        seen[order] = np.repeat(counts, counts)
        rows, lo = [], 0
        for one, part, which in zip(share, parts, table.column("which").to_pylist()):
            here = seen[lo : lo + len(part)]
            lo += len(part)
            some = np.flatnonzero(here > 1)
            if len(some):
                rows.append((one, occ.planes(part[some]), _numbers(_unnumbers(which)[some]), None, None, _numbers(here[some])))
        return _as_table(rows, _SHARED)

    return shared


def _listed(num: int, den: int, buckets: int):
    """List entries (key, class, size) of a share's sets, packed by bucket: elements of one set alone come first and need no list, then those of the fewest sets."""

    def listed(key: tuple, table: pa.Table) -> pa.Table:
        cols = [table.column(k).to_pylist() for k in ("keys", "which", "names", "sizes", "seen")]
        if key[0].as_py() < 0:
            return _as_table([(-key[0].as_py(), *row[:4]) for row in zip(*cols)], _POSTED)
        heads = [(occ.unsqueezed(m, np.int64), occ.unsqueezed(s, np.int64)) for m, s in zip(cols[2], cols[3]) if m is not None]
        if len(heads) != 1:
            raise ValueError("a task was repeated with other rows: the documents must be read in one order")
        names, sizes = heads[0]
        found = [(occ.unplanes(k, np.uint64), _unnumbers(w), _unnumbers(s)) for k, w, s in zip(cols[0], cols[1], cols[4]) if s is not None]
        if not found:
            return _as_table([], _POSTED)
        keys, which, seen = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((keys, seen, which))
        both = np.bincount(which, minlength=len(names))
        few = np.maximum(0, prefix(sizes, num, den) - (sizes - both))
        pick = order[np.repeat(np.cumsum(both) - both, few) + c.spread(few)]
        owner = which[pick]
        return _as_table(packed(keys[pick], names[owner], sizes[owner], buckets) if len(pick) else [], _POSTED)

    return listed


def _met(num: int, den: int, buckets: int):
    """Of a bucket's lists, the chains of sets of similar size; of its subsets, the links."""

    def met(key: tuple, table: pa.Table) -> pa.Table:
        exact = key[0].as_py() >= buckets
        keys, names, sizes = [], [], []
        for k, w, m, s in zip(*(table.column(x).to_pylist() for x in ("keys", "which", "names", "sizes"))):
            which = occ.unsqueezed(w, np.uint32)
            keys.append(occ.unplanes(k, np.uint64))
            names.append(occ.unplanes(m, np.int64)[which])
            sizes.append(occ.unsqueezed(s, np.int64)[which])
        keys, names, sizes = np.concatenate(keys), np.concatenate(names), np.concatenate(sizes)
        order = np.lexsort((names, sizes, keys))
        keys, names, sizes = keys[order], names[order], sizes[order]
        if exact:
            # a list's smallest set links with each that the shared subset is large enough for, or none does
            cuts = occ._cuts(keys)
            head = np.repeat(cuts[:-1], np.diff(cuts))
            o = (keys & np.uint64(255)).astype(np.int64)
            ok = np.flatnonzero(((num + den) * o >= num * (sizes + sizes[head])) & (names != names[head]))
            x, y = names[head[ok]], names[ok]
        else:
            ok = np.flatnonzero((keys[1:] == keys[:-1]) & (den * sizes[:-1] >= num * sizes[1:]) & (names[1:] != names[:-1]))
            x, y = names[ok], names[ok + 1]
        pairs = np.unique(np.stack((x, y), 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        x, y = forest(pairs[:, 0], pairs[:, 1])
        return pa.table([pa.array(x), pa.array(y), pa.array(np.full(len(x), exact))], names=["a", "b", "exact"])

    return met


def verified(sets: list[np.ndarray], num: int, den: int, groups: list[int] | None = None, apart: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links, enough of them to connect what is connected, between sorted sets.

    Sets of one of ``groups`` are connected already.  With ``apart``, only pairs
    with one set on either side are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    u = Union(len(sets))
    mask = {}
    if groups is not None:
        seen: dict[int, int] = {}
        for p, i in enumerate(order):
            u.join(p, seen.setdefault(groups[i], p))
    flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(inverse)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    for p in range(len(order)):
        r = u.find(p)
        mask[r] = mask.get(r, 0) | 1 << p
    side = [0, 0]
    if apart is not None:
        for p, i in enumerate(order):
            side[apart[i]] |= 1 << p
    lists: dict[int, int] = {}
    sizes, low = [len(sets[i]) for i in order], 0
    links: list[tuple[int, int]] = []
    for p, i in enumerate(order):
        s = sizes[p]
        while den * sizes[low] < num * s:
            low += 1
        tokens = inverse[at[i] : at[i + 1]]
        first = tokens[np.lexsort((tokens, count[tokens]))[: int(prefix(np.int64(s), num, den))]]
        first = first[count[first] > 1].tolist()
        found = 0
        for t in first:
            found |= lists.get(t, 0)
        found = found >> low << low
        if apart is not None:
            found &= side[not apart[i]]
        root = u.find(p)
        found &= ~mask[root]
        while found:
            q = (found & -found).bit_length() - 1
            found &= found - 1
            j = order[q]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (s + len(sets[j]) - both):
                a, b = u.find(p), u.find(q)
                u.join(p, q)
                links.append((i, j))
                mask[u.find(p)] = mask.pop(a) | mask.pop(b)
                found &= ~mask[u.find(p)]
        for t in first:
            lists[t] = lists.get(t, 0) | 1 << p
    return links


_LINK = "a long, b long"


def _table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _families(num: int, den: int):
    """Streams rows sorted by family: its links."""

    def links(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(names[i], names[j]) for i, j in verified(sets, num, den)]

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, names, sets = None, [], []
        for batch in batches:
            out = []
            for fam, name, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if fam != family:
                    if len(sets) > 1:
                        out += links(names, sets)
                    family, names, sets = fam, [], []
                if name not in names[-1:]:
                    names.append(name)
                    sets.append(occ.unplanes(blob, np.uint64))
            yield _table(out)
        if len(sets) > 1:
            yield _table(links(names, sets))

    return families


def _block_links(num: int, den: int, across: bool):
    def linked(key: tuple, table: pa.Table) -> pa.Table:
        names = table.column("cls").to_pylist()
        pick = [i for i, n in enumerate(names) if names.index(n) == i] if not across else range(len(names))
        sets = [occ.unplanes(table.column("elements")[i].as_py(), np.uint64) for i in pick]
        groups = [table.column("comp")[i].as_py() for i in pick] if across else None
        apart = [table.column("side")[i].as_py() == 1 for i in pick] if across else None
        names = [names[i] for i in pick]
        return pa.Table.from_batches([_table([(names[i], names[j]) for i, j in verified(sets, num, den, groups, apart)])])

    return linked


def _bit(ids: np.ndarray) -> np.ndarray:
    return (c.mixed(ids.view(np.uint64)) % np.uint64(FILTER)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER, bool)
    for batch in batches:
        bits[_bit(batch.column(0).to_numpy())] = True
    parts = np.packbits(bits).reshape(64, -1)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([occ.squeezed(parts[k]) for k in some], pa.binary())], names=["chunk", "bits"])


def _either(key: tuple, table: pa.Table) -> pa.Table:
    both = np.bitwise_or.reduce([occ.unsqueezed(b, np.uint8) for b in table.column("bits").to_pylist()])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([occ.squeezed(both)], pa.binary())], names=["chunk", "bits"])


def _filter_of(ids: DataFrame):
    """Broadcast bits of the one long column of ``ids``, of fixed size: each of its numbers passes, and few others."""
    bits = np.zeros(FILTER // 8, np.uint8).reshape(64, -1)
    for r in ids.mapInArrow(_marked, "chunk int, bits binary").groupBy("chunk").applyInArrow(_either, "chunk int, bits binary").collect():
        bits[r["chunk"]] = occ.unsqueezed(bytes(r["bits"]), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.ravel())


def _passing(wanted):
    """Rows whose first column passes the filter."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[_bit(batch.column(0).to_numpy())])) if batch.num_rows else batch

    return passing


def _elements(n: int, wanted):
    """``_id, cls, size, elements`` of the rows whose identifier passes the filter."""
    passing = _passing(wanted)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pick in passing(batches):
            for lo, hi, data, offs in c.slices(pick.column(1)):
                keys, at = _sets(n, data, offs)
                names, keys = _class_of(keys, at), keys >> np.uint64(16)
                blobs = [occ.planes(keys[at[k] : at[k + 1]]) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pick.column(0).slice(lo, hi - lo), pa.array(names), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], names=["_id", "cls", "size", "elements"])

    return elements


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (80, 100), bucket_bytes: int = 4 << 20, family: int = FAMILY) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set are its distinct shingles of ``n`` words, lower-cased A to
    Z; with fewer words, all of them as one; without words it is empty and links
    with nothing.  Documents link at a Jaccard similarity of at least
    ``similarity`` (a fraction); ``component_id`` is the smallest identifier that
    links reach.  Null texts are empty.  Repeated rows, and rows that share an
    identifier, are documents that may link.  A null identifier ranks first.  No
    rows give no rows; further columns are ignored.  Shingles and sets are known
    by 64-bit hashes; a pair is verified on 48 bits of each.
    """
    num, den = similarity
    spark = c.prepared(docs)
    rows = c.texts(docs, id_col, text_col)
    buckets = c.blocks_for(rows, bucket_bytes)

    named = rows.mapInArrow(_named(n), "_id long, size long, cls long").withColumn("slot", F.pmod(F.xxhash64("_id"), F.lit(64)).cast("int"))
    named = c.settled(named)
    bound = boundary({r["size"]: r["count"] for r in named.where(F.col("size").between(1, 2 * LIGHT_MOST)).groupBy("size").count().collect()}, num, den)
    slots = named.where("size > 0").groupBy("cls", "slot").agg(F.min("_id").alias("rep"), F.first("size").alias("size"))
    classes = slots.groupBy("cls").agg(F.min("rep").alias("rep"), F.first("size").alias("size"))

    shared = rows.mapInArrow(_sent(n, num, den, bound, buckets), _SENT).groupBy("bucket").applyInArrow(_shared(buckets), _SHARED)
    lists = shared.groupBy("share").applyInArrow(_listed(num, den, buckets), _POSTED)
    edges = c.settled(lists.groupBy("bucket").applyInArrow(_met(num, den, buckets), "a long, b long, exact boolean"))
    members = components(edges.where("NOT exact")).select(F.col("node").alias("cls"), F.col("root").alias("fam"))
    members = c.settled(members.join(classes, "cls").select("fam", "cls", "rep"))
    large = members.groupBy("fam").agg(F.count("*").alias("m")).where(F.col("m") > family)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sets_of(some: DataFrame) -> DataFrame:
        # a filter of fixed size keeps most other sets off the shuffle; what it lets pass wrongly finds no member in the join
        sets = rows.mapInArrow(_elements(n, _filter_of(some.select("rep"))), "_id long, cls long, size long, elements binary")
        # repeated rows meet in the join's exchange, as a class has one representative
        return sets.join(some.withColumnRenamed("rep", "_id"), ["_id", "cls"]).dropDuplicates(["_id", "cls"]).select("fam", "cls", "size", "elements")

    def verify(sets: DataFrame) -> DataFrame:
        return sets.select("fam", "cls", "elements").repartition(parts, "fam").sortWithinPartitions("fam", "cls").mapInArrow(_families(num, den), _LINK)

    links = edges.where("exact").select("a", "b").unionByName(verify(sets_of(members.join(large, "fam", "left_anti"))))
    if not large.isEmpty():
        # once more with exact knowledge of which elements a family's sets share
        sets = c.settled(sets_of(members.join(large.select("fam"), "fam")))
        members = c.settled(components(_refined(sets, bucket_bytes, num, den)).select(F.col("node").alias("cls"), F.col("root").alias("fam")))
        large = members.groupBy("fam").agg(F.count("*").alias("m")).where(F.col("m") > family)
        sets = sets.select("cls", "elements").mapInArrow(_passing(_filter_of(members.select("cls"))), "cls long, elements binary").join(members, "cls").select("fam", "cls", "elements")
        links = links.unionByName(verify(sets.join(large, "fam", "left_anti")))
        if not large.isEmpty():
            links = links.unionByName(_large_families(sets.join(large.select("fam"), "fam"), large, family, num, den))
    roots = components(links)
    whole = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component"))
    answer = slots.select("cls", "slot").join(whole.join(least, "root").select("cls", "component"), "cls")
    mine = named.select("_id", "size", F.when(F.col("size") > 0, F.col("cls")).otherwise(F.xxhash64("_id")).alias("cls"), F.when(F.col("size") > 0, F.col("slot")).alias("slot"))
    out = mine.join(answer, ["cls", "slot"], "left")
    return out.withColumn("_component", F.coalesce("component", "_id")).select(c.id_back().alias("doc_id"), F.col("size").alias("n_shingles"), c.id_back("_component").alias("component_id"))


def _wide(keys: np.ndarray) -> np.ndarray:
    """The 48 bits of verification, spread over 64 again."""
    return keys << np.uint64(16)


def _refined(sets: DataFrame, bucket_bytes: int, num: int, den: int) -> DataFrame:
    """Chains (a, b) of the sets of large families, by lists of elements that more than one of these sets holds.

    An element of one set alone comes first in the order of elements: a set with
    enough of them needs no list at all.  The elements that a set shares come back
    to its size, so the sets themselves are not sent again.
    """
    rows = sets.select(F.col("cls").alias("_id"), "elements")
    blocks = c.blocks_for(rows, bucket_bytes, "elements")

    def held(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for one, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = _wide(occ.unplanes(blob, np.uint64))
            yield np.full(len(keys), one), keys

    def listed(key: tuple, some: pa.Table, found: pa.Table) -> pa.Table:
        shared = occ.Pairs(*occ.reported(found))
        got = []
        for one, size in zip(some.column("_id").to_pylist(), some.column("size").to_pylist()):
            both = np.unique(shared.of(one))
            few = both[: max(0, int(prefix(np.int64(size), num, den)) - (size - len(both)))]
            got.append((few, np.full(len(few), one), np.full(len(few), size)))
        out = packed(*(np.concatenate([g[i] for g in got]) for i in range(3)), blocks) if got else []
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.int64()] + [pa.binary()] * 4)], names=["bucket", "keys", "which", "names", "sizes"])

    found = occ.repeated(rows, held, blocks, blocks, with_first=True)
    lists = occ.blocked(sets.select(F.col("cls").alias("_id"), "size"), blocks).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(listed, "bucket long, keys binary, which binary, names binary, sizes binary")
    return lists.groupBy("bucket").applyInArrow(_met(num, den, blocks), "a long, b long, exact boolean").select("a", "b")


def _large_families(sets: DataFrame, large: DataFrame, family: int, num: int, den: int) -> DataFrame:
    """Links of families of more than ``family`` sets.

    Blocks are verified with a few pivots of their family in each.  What is then
    not connected with a family's largest component is compared with every
    block; pairs inside that component need no comparison.
    """
    half = max(family // 2, 2)
    sets = c.settled(sets.dropDuplicates(["fam", "cls"]).join(large, "fam").withColumns({"blocks": F.ceil(F.col("m") / half).cast("int")}).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    pivots = sets.select("fam", F.struct(F.xxhash64("cls", F.lit(3)).alias("h"), "cls").alias("p")).groupBy("fam").agg(F.min("p").alias("p1"), F.max("p").alias("p2"))
    pivots = pivots.select("fam", F.explode(F.array("p1.cls", "p2.cls")).alias("cls"))
    pivots = sets.join(pivots, ["fam", "cls"]).select("fam", "cls", "elements", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = c.settled(sets.select("fam", "cls", "elements", "block").unionByName(pivots).groupBy("fam", "block").applyInArrow(_block_links(num, den, False), _LINK))
    comps = components(first)
    placed = sets.join(comps, F.col("cls") == F.col("node"), "left").select("fam", "cls", "elements", "block", "blocks", F.coalesce("root", "cls").alias("comp"))
    placed = c.settled(placed)
    main = placed.groupBy("fam", "comp").agg(F.count("*").alias("k")).groupBy("fam").agg(F.max(F.struct("k", "comp")).alias("top")).select("fam", F.col("top.comp").alias("main"))
    others = placed.join(main, "fam").where("comp <> main")
    groups = others.groupBy("fam").agg(F.ceil(F.count("*") / half).cast("int").alias("groups"))
    left = placed.join(groups, "fam").select("fam", "cls", "elements", "comp", F.lit(0).alias("side"), "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
    right = others.join(groups, "fam").withColumn("grp", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("groups")).cast("int"))
    right = right.select("fam", "cls", "elements", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "grp")
    return first.unionByName(left.unionByName(right).groupBy("fam", "block", "grp").applyInArrow(_block_links(num, den, True), _LINK))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, with all their columns.

    The other identifiers, which are few, are written: with their size known, they go to the documents and not the documents to them.
    """
    found = similar_documents(docs, id_col, text_col, **options)
    gone = found.groupBy(F.coalesce("doc_id", F.lit(c.NULL_ID)).alias("_id")).agg(F.max(F.expr("doc_id <=> component_id")).alias("kept")).where("NOT kept").select("_id")
    return c.carried(docs, _id=c.key_of(id_col)).join(c.written(gone), "_id", "left_anti").select("_row.*")
