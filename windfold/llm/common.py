"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windfold.session import checkpoint_dir, cut_lineage, ship

#: A null id counts as this one inside an operator and is null again in its result.
NULL_ID = -(2**63)
#: Bytes of text handled by one NumPy step.
STEP = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def prepared(df: DataFrame) -> SparkSession:
    """Session of ``df``, with this package on the Python workers' path."""
    ship(df.sparkSession)
    return df.sparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared checkpoint folder."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: of files the planner knows the size, of a checkpoint it does not."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def id_back(col: str = "_id") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _text`` without nulls; other columns go, whatever their names."""
    return df.select(key_of(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """``_row`` with all of ``df`` and the given columns beside it, so that names cannot clash; ``select("_row.*")`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("_row"), *[v.alias(k) for k, v in columns.items()])


def blocks_for(df: DataFrame, bytes_each: int, text_col: str = "_text") -> int:
    """Number of blocks that the texts of ``df`` make.

    A block has about ``bytes_each`` bytes; of a larger input it has more, up to
    64 MiB, so that what passes between every two blocks stays worth a row.
    """
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(total // max(bytes_each, min(64 << 20, int((total * (16 << 10)) ** 0.5)))) + 1


# --- bytes and words of Arrow text columns -------------------------------------------------


def slices(column: pa.Array, limit: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``lo, hi, bytes, offsets`` over runs of rows of about ``limit`` bytes; a row is never cut."""
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: As BYTE, A to Z like a to z.
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5
_UNDO = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse, to the powers 0 to n - 1, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP * 2)
        _powers[:] = []
        for base in (_BASE, _UNDO):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a Rabin-Karp hash modulo 2**64 and the inverse powers that shift a part of them to its start."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and, per row, where its words begin in that list."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    solid = ~space
    before = np.concatenate(([True], space[:-1])) | edge[:-1] if len(data) else solid
    after = np.concatenate((space[1:], [True])) | edge[1:] if len(data) else solid
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_places: list[np.ndarray] = []


def places(n: int) -> np.ndarray:
    """An unrelated odd factor for each of ``n`` places of a word."""
    if not _places or len(_places[0]) < n:
        _places[:] = [mixed(np.arange(1, max(n, STEP // 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)]
    return _places[0][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of each word: its bytes' numbers, each by the factor of its place, summed up.

    Powers of one base would not do: modulo 2**64 there are words of 1,024
    letters that collide for every odd base.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    first, longest = int(starts[0]), int((ends - starts).max())
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    sums = np.zeros(len(place) + 1, np.uint64)
    # places behind a word's end are between words and cancel out
    np.cumsum(table[data[first:]] * places(longest)[np.minimum(place, longest - 1)], out=sums[1:])
    return mixed(sums[ends - first] - sums[starts - first] + (ends - starts).astype(np.uint64))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``n`` consecutive words of a row, its first word and the windows of each row."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.repeat(first[:-1], counts) + spread(counts)
    sums, down = rolling(hashes)
    return mixed((sums[at + n] - sums[at]) * down[at]), at, counts
