"""Order statistics of a large table without sorting it.

A rank is found digit by digit: doubles map to whole numbers in the same order,
of which four passes read sixteen bits each.  A pass counts the rows by digit below
the digits already known, so every task and the driver hold at most one counter for
each of 65,536 digits and wanted rank, however many rows share a value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.session import cut_lineage

BITS, PASSES = 16, 4


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; both zeros are one, NaN comes last."""
    values = values + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits)


def _value(key: int) -> float:
    bits = np.int64(key)
    return float((bits if key >= 0 else ~(bits ^ np.int64(-(2**63)))).view(np.float64))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_ordered(batch.column(0).to_numpy(zero_copy_only=False).astype(float)))], names=["key"])


def at_ranks(values: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """Values of the only column of ``values`` at 0-based ranks among its rows that are not null, in rising order."""
    if not ranks:
        return {}
    name = values.columns[0]
    keys = cut_lineage(values.select(F.col(name).cast("double").alias("v")).where("v IS NOT NULL").mapInArrow(_keys, "key bigint"))
    # wanted rank: the digits known so far, as one number, and the rank among the rows that have them
    known = {r: (None, r) for r in ranks}
    for step in range(PASSES):
        shift = BITS * (PASSES - 1 - step)
        head, digit = F.shiftright("key", shift + BITS), F.shiftright("key", shift)
        rows = keys if step == 0 else keys.where(head.isin(sorted({h for h, _ in known.values()})))
        counts = sorted((r.digit, r.n) for r in rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
        for rank, (above, left) in known.items():
            for value, n in counts:
                if above is not None and value >> BITS != above:
                    continue
                if left < n:
                    known[rank] = (value, left)
                    break
                left -= n
            else:
                raise ValueError(f"rank {rank} is beyond the rows")
    return {rank: _value(key) for rank, (key, _) in known.items()}


def quantiles(values: DataFrame, shares: Sequence[float], n: int) -> list[float | None]:
    """Quantiles by linear interpolation between the neighbouring ranks of the ``n`` rows that are not null; None without rows."""
    if not n:
        return [None for _ in shares]
    at = [s * (n - 1) for s in shares]
    found = at_ranks(values, sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at}))
    low = [found[int(x)] for x in at]
    return [a + (x - int(x)) * (found[min(int(x) + 1, n - 1)] - a) for a, x in zip(low, at)]
