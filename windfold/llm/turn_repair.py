"""Cheapest repair of conversation structure by a run-length dynamic programme.

A conversation is a word over role and fault symbols; repaired, its role initials
must read ``(s?(ua)+)?``.  An edit of one row is a min-plus matrix over the four
states of that pattern.  Equal symbols in a row form a run, which is crossed with
binary powers of its matrix, kept for all runs of that symbol.  The costs so found
are then unrolled into edits from the front, the least letter first among the
cheapest.

Rows lie in range partitions of (conversation, turn, role, text), so that a large
conversation is spread over many of them.  Its part in one partition is again one
matrix; the few of these that belong to conversations cut by a partition's edge, two
for each partition at most, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c

INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
#: White space of the contract.
BLANKS = " \t\n\x0b\x0c\r"
#: Kinds of rows by role initial; all others are OTHER.
KINDS, OTHER = "sua", 3
#: Symbols: kind of a sound row, 4 + kind of a truncated one, GONE for one that must go.
GONE = 8
#: States: nothing yet, after the system row, after a user row, after an assistant row.
_NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_FAR = 1 << 40
#: Bytes of text in a range partition, and rows of one run unrolled at once.
PARTITION_BYTES, STRETCH = 32 << 20, 1 << 14
#: Characters of repaired text in one row of what is joined across partitions.
CHUNK = 8192


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or, row by row, with vectors."""
    return (a[:, :, None] + b[None]).min(1)


def _inserted() -> np.ndarray:
    m = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(m, 0)
    for (q, kind), to in _NEXT.items():
        if kind:
            m[q, to] = INSERT
    return _times(m, _times(m, m))


INSERTS = _inserted()
#: Cheapest way to end from each state.
END = (INSERTS + np.array([0, _FAR, _FAR, 0])).min(1)


@cache
def power(symbol: int, k: int) -> np.ndarray:
    """Min-plus matrix of ``2**k`` rows of one symbol, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(row, DELETE)
    for (q, kind), to in _NEXT.items():
        if symbol != GONE:
            extra = CUT_OFF * (symbol >= 4)
            if kind:
                row[q, to] = min(row[q, to], REROLE + extra)
            if kind == symbol % 4:
                row[q, to] = extra
    return _times(INSERTS, row)


def before(symbol: int, count: int, after: np.ndarray) -> np.ndarray:
    """Costs to the end by state before ``count`` rows of a symbol, from those after them; ``after`` is a vector, or a matrix."""
    k = 0
    while count:
        if count & 1:
            m = power(symbol, k)
            after = _times(m, after) if after.ndim == 2 else (m + after).min(1)
        count, k = count >> 1, k + 1
    return after


def along(symbol: int, count: int, after: np.ndarray) -> np.ndarray:
    """Costs by state with 0 to ``count`` rows of the run still to come, doubled power by power."""
    out, k = after[None], 0
    while len(out) <= count:
        out = np.concatenate((out, (power(symbol, k)[None] + out[:, None, :]).min(2)))
        k += 1
    return out[: count + 1]


def collapsed(symbols: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal symbols: each with its length."""
    symbols, counts = symbols[counts > 0], counts[counts > 0]
    if not len(symbols):
        return []
    starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    return list(zip(symbols[starts].tolist(), np.add.reduceat(counts, starts).tolist()))


def matrix(runs: list[tuple[int, int]]) -> np.ndarray:
    out = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(out, 0)
    for symbol, count in reversed(runs):
        out = before(symbol, count, out)
    return np.minimum(out, _FAR)


def edits(runs: list[tuple[int, int]], after: np.ndarray, state: int, ends: bool) -> Iterator[tuple[str, int, int]]:
    """Letter, kind of role and new state of each edit, in order.

    ``after`` has the costs to the end behind the runs; where they end the
    conversation, the insertions behind its last row are given too.
    """
    behind = [after]
    for symbol, count in reversed(runs):
        behind.append(before(symbol, count, behind[-1]))
    behind.reverse()
    for (symbol, count), end in zip(runs, behind[1:]):
        extra, kind = CUT_OFF * (symbol >= 4), OTHER if symbol == GONE else symbol % 4
        left = count
        while left:
            stretch = min(left, STRETCH)
            costs = along(symbol, stretch, before(symbol, left - stretch, end)).tolist()
            for r in range(stretch, 0, -1):
                here, then = costs[r], costs[r - 1]
                while True:
                    need = here[state]
                    if DELETE + then[state] == need:
                        yield "D", OTHER, state
                        break
                    adds = 2 if state == 2 else 1
                    to = _NEXT[state, adds]
                    if INSERT + here[to] == need:
                        state = to
                        yield "I", adds, state
                        continue
                    kept = _NEXT.get((state, kind))
                    if kept is not None and extra + then[kept] == need:
                        state = kept
                        yield "K", kind, state
                        break
                    state = to
                    yield "R", adds, state
                    break
            left -= stretch
    while ends and END[state]:
        adds = 2 if state == 2 else 1
        state = _NEXT[state, adds]
        yield "I", adds, state


# --- rows ----------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults made by ``crc32("conv_id:turn") % 20``, in which a null is one space.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the
    row, 4 makes it the user's.
    """
    rows = _plain(conversations)
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")])
    rows = rows.withColumn("_way", F.crc32(name) % 20).where("_way != 0")
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_way") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_way") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(k), F.lit(" ")).alias(k) for k in ("role", "text")])


def _trimmed(side: str) -> Column:
    blanks = "".join(f"\\u{ord(b):04x}" for b in BLANKS)
    return F.expr(f"trim({side} '{blanks}' FROM text)")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their faults, equal ones as one row with ``copies``.

    ``fault`` is that of the first copy: blank, duplicate, truncated or null;
    further copies of a row that is not blank are duplicates.
    """
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = _plain(rows).withColumn("conv_id", c.key_of("conv_id")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("_same", same)
    # the texts stay behind here: a digest and the first turn of what occurs at several turns
    firsts = rows.groupBy("conv_id", "_same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = F.col("_first").isNotNull() & ~F.col("_first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(_trimmed("BOTH") == "", "blank").when(again, "duplicate").when(~F.right(_trimmed("TRAILING"), F.lit(1)).isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(OTHER)
    rows = rows.join(firsts, ["conv_id", "_same"], "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), kind.alias("kind"))
    return rows.withColumn("symbol", F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(F.col("kind") + F.when(F.col("fault") == "truncated", 4).otherwise(0)))


def ordered(rows: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Marked rows in range partitions of bounded size, written once; ``part`` is a row's partition."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64)).first()[0] or 0
    parts = max(int(size // partition_bytes) + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size >> 20) + 1))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return c.settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


class Slice:
    """Rows of one partition, by conversation."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        got = list(batches)
        self.table = pa.Table.from_batches(got).combine_chunks() if got else None
        if self.table is None or not self.table.num_rows:
            self.bounds = [0]
            return
        conv, symbol, self.copies, self.kind, part = [self.table.column(k).to_numpy() for k in ("conv_id", "symbol", "copies", "kind", "part")]
        edges = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        self.bounds, self.conv, self.part = [0, *edges.tolist(), len(conv)], conv, int(part[0])
        # the first copy, then the others, which are duplicates
        self.symbols = np.column_stack((symbol, np.full(len(symbol), GONE))).astype(np.int64)
        self.counts = np.column_stack((np.ones(len(symbol), np.int64), self.copies - 1))

    def segments(self) -> Iterator[tuple[int, int, int]]:
        for lo, hi in zip(self.bounds, self.bounds[1:]):
            yield int(self.conv[lo]), lo, hi

    def runs(self, lo: int, hi: int) -> list[tuple[int, int]]:
        return collapsed(self.symbols[lo:hi].ravel(), self.counts[lo:hi].ravel())


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last conversation of a partition: its matrix, and the kinds of its first and last row."""
    rows = Slice(batches)
    ends = list(rows.segments())
    out = [(conv, rows.part, int(rows.kind[hi - 1]), matrix(rows.runs(lo, hi)).ravel().tolist()) for conv, lo, hi in {ends[0], ends[-1]}] if ends else []
    cols = list(zip(*out)) if out else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["conv_id", "part", "last", "matrix"])


def _exits(cut: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = Slice(batches), []
        for conv, lo, hi in rows.segments():
            here = cut.get((conv, rows.part))
            if here:
                runs, exits = rows.runs(lo, hi), []
                for state in range(4):
                    for _, _, state in edits(runs, np.array(here[0]), state, False):
                        pass
                    exits.append(state)
                out.append((conv, rows.part, exits))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["conv_id", "part", "exits"])

    return run


_SLIM = ["conv_id", "part", "copies", "kind", "symbol"]


def cut_by_edges(rows: DataFrame) -> dict[tuple[int, int], tuple[list[int], int, int, bool]]:
    """For each part of a conversation that lies in several partitions: costs behind it, state before it, kind of the row before it and whether it is the last."""
    ends = rows.select(*_SLIM).mapInArrow(_edges, "conv_id long, part int, last int, matrix array<long>").collect()
    by: dict[int, list] = {}
    for r in sorted(ends, key=lambda r: r.part):
        by.setdefault(r.conv_id, []).append(r)
    by = {k: v for k, v in by.items() if len(v) > 1}
    if not by:
        return {}
    cut = {}
    for conv, parts in by.items():
        after, last = END, True
        for r in reversed(parts):
            cut[conv, r.part] = (after.tolist(), last)
            after, last = (np.array(r.matrix).reshape(4, 4) + after).min(1), False
    exits = {(r.conv_id, r.part): r.exits for r in rows.select(*_SLIM).mapInArrow(_exits(cut), "conv_id long, part int, exits array<int>").collect()}
    out = {}
    for conv, parts in by.items():
        state, kind = 0, -1
        for r in parts:
            after, last = cut[conv, r.part]
            out[conv, r.part] = (after, state, kind, last)
            state, kind = exits[conv, r.part][state], r.last
    return out


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
_ROLE = {1: "user", 2: "assistant"}


def _repaired(cut: dict, turns: bool):
    """Repairs a partition: its turns, or digests of its whole conversations and pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = Slice(batches), []
        for conv, lo, hi in rows.segments():
            here = cut.get((conv, rows.part))
            after, state, kind, last = here or (END, 0, -1, True)
            runs, after = rows.runs(lo, hi), np.array(after)
            kinds = rows.kind[lo:hi]
            illegal = int((rows.copies[lo:hi] - 1).sum() + (~_LEGAL[kinds[:-1], kinds[1:]]).sum()) + (kind >= 0 and not _LEGAL[kind, kinds[0]])
            cost = after
            for symbol, count in reversed(runs):
                cost = before(symbol, count, cost)
            role, text = (rows.table.column(k)[lo:hi] for k in ("role", "text"))
            audit, parts, row, left = [], [], -1, 0
            for letter, as_kind, _ in edits(runs, after, state, last):
                audit.append(letter)
                if letter != "I":
                    if not left:
                        row += 1
                        left = int(rows.copies[lo + row])
                    left -= 1
                if letter != "D":
                    parts.append((role[row].as_py() if letter == "K" else _ROLE[as_kind], "" if letter == "I" else text[row].as_py()))
            if turns:
                out += [(conv, rows.part, k, r, t) for k, (r, t) in enumerate(parts)]
                continue
            lines = "".join(f"\n{r}:{t}" for r, t in parts)
            if not here:
                out.append((conv, -1, 0, int(cost[0]), illegal, "".join(audit), hashlib.sha256(lines[1:].encode()).hexdigest()))
                continue
            # the first piece has the numbers, the letters come beside it
            first, letters = (int(cost[0]) if kind < 0 else 0, illegal), "".join(audit)
            for k in range(max(1, -(-len(lines) // CHUNK), -(-len(letters) // CHUNK))):
                out.append((conv, rows.part, k, *(first if not k else (0, 0)), letters[k * CHUNK : (k + 1) * CHUNK], lines[k * CHUNK : (k + 1) * CHUNK]))
        if turns:
            yield _batch(out, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()), ["conv_id", "part", "place", "role", "text"])
        else:
            yield _batch(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), _PIECES)

    return run


_PIECES = ["conv_id", "part", "place", "cost", "illegal", "audit", "repaired_sha256"]
_PIECE_TYPES = "conv_id long, part int, place long, cost long, illegal long, audit string, repaired_sha256 string"


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of conversation and place to one row each."""
    now, cost, illegal, audit, digest, first = None, 0, 0, [], None, True
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        out = []
        for conv, _, _, more_cost, more_illegal, letters, lines in zip(*(col.to_pylist() for col in batch.columns)):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, -1, 0, cost, illegal, "".join(audit), digest.hexdigest()))
                now, cost, illegal, audit, digest, first = conv, 0, 0, [], hashlib.sha256(), True
            cost, illegal = cost + more_cost, illegal + more_illegal
            audit.append(letters)
            if lines:
                digest.update((lines[1:] if first else lines).encode())
                first = False
        yield _batch(out, types, _PIECES)
    if digest is not None:
        yield _batch([(now, -1, 0, cost, illegal, "".join(audit), digest.hexdigest())], types, _PIECES)


def repair(rows: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``: its faults, the cheapest repair's cost and letters, and the digest of what it leaves.

    Rows are taken by turn, nulls first; rows of one turn by role and text, so
    equal ones lie beside each other.  Null roles and texts are one space, null
    identifiers a conversation of their own.  Gaps beyond the range of a long are
    null.  Further columns are ignored; without rows there are no conversations.
    The digest of a conversation needs its texts in order, so it is made in one
    task, which they stream through.
    """
    spark = c.prepared(rows)
    placed = ordered(marked(rows), partition_bytes)
    cut = cut_by_edges(placed)
    done = placed.mapInArrow(_repaired(cut, False), _PIECE_TYPES)
    if cut:
        done = c.settled(done)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pieces = done.where("part >= 0").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_joined, _PIECE_TYPES)
        done = done.where("part < 0").unionByName(pieces)
    wide = {k: F.col(k).cast("decimal(38,0)") for k in ("low", "high")}
    counts = placed.groupBy("conv_id").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("copies")).when(F.col("fault") == "blank", 0).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum((F.col("fault").eqNullSafe("truncated")).cast("long")).alias("truncated"),
    )
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise((wide["high"] - wide["low"] + 1 - F.col("turns")).try_cast("long"))
    counts = counts.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated")
    return counts.join(done, "conv_id").select(c.id_back("conv_id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``conv_id, part, place, role, text``: the repaired turns, in order of part and place within a conversation.  Cases as in :func:`repair`."""
    c.prepared(rows)
    placed = ordered(marked(rows), partition_bytes)
    turns = placed.mapInArrow(_repaired(cut_by_edges(placed), True), "conv_id long, part int, place long, role string, text string")
    return turns.withColumn("conv_id", c.id_back("conv_id"))


def damage_and_repair(conversations: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """:func:`repair` of :func:`damaged` rows, one row for every identifier that the table has; of those left without rows the counts are 0 and the texts empty."""
    ids = conversations.select(c.key_of("conv_id").alias("_id")).distinct()
    found = repair(damaged(conversations), partition_bytes).withColumn("_id", c.key_of("conv_id")).drop("conv_id")
    zero = {k: F.coalesce(F.col(k), F.lit(0).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated", "illegal", "cost")}
    out = ids.join(found, "_id", "left")
    gaps = F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps"))
    return out.select(c.id_back().alias("conv_id"), gaps.alias("gaps"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
