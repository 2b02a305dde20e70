"""Ordered replay of keyed rows with carried state.

A replay is a left fold over the rows of one key.  Grouping a key into one
pandas frame would tie memory to the longest key, so the rows of a partition
are streamed in (position, key) order instead: all keys of the partition step
from position h to h+1 together, as one NumPy operation over the live keys.
State is kept only for keys that still have rows, and a key of any length costs
constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.session import ship

State = dict[str, np.ndarray]
Step = Callable[[State | None, pd.DataFrame, int], tuple[State, dict[str, object]]]


def spread(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Hash-partition for a Python stage, with the session's partition count.

    Python work costs far more per byte than a shuffle read, so these partitions
    must not be merged by size; a stated count keeps AQE from doing it.
    """
    ship(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys])


def lockstep(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    step: Step,
    schema: str,
    carry: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Fold rows with dense ``order`` 0,1,2,.. per key.

    ``step(state, rows, position)`` gets the states of the keys in ``rows``
    (aligned row by row, ``None`` at position 0) and returns the new states,
    aligned the same way, plus output columns.  ``carry`` names input columns
    copied to the output.  ``schema`` must list keys, order, carry, then the
    columns ``step`` returns.  A gap or a duplicate in ``order`` fails the job.
    """
    keys, carry = list(keys), list(carry)
    key = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])
    laid = spread(df.withColumn("__key", key), keys, partitions).sortWithinPartitions(order, "__key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        position = -1
        done_keys: np.ndarray | None = None
        done_state: State = {}
        part_keys: list[np.ndarray] = []
        part_state: list[State] = []

        def close() -> None:
            nonlocal done_keys, done_state, part_keys, part_state
            done_keys = np.concatenate(part_keys)
            done_state = {k: np.concatenate([s[k] for s in part_state]) for k in part_state[0]}
            part_keys, part_state = [], []

        for frame in frames:
            at = frame[order].to_numpy()
            cuts = np.flatnonzero(np.diff(at)) + 1
            results = []
            for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                if lo == hi:
                    continue
                rows = frame.iloc[lo:hi]
                names = rows["__key"].to_numpy()
                here = int(at[lo])
                if here != position:
                    if part_keys:
                        close()
                    if here != position + 1:
                        raise ValueError(f"replay rows are not contiguous: position {here} after {position}")
                    position = here
                if len(names) > 1 and (names[1:] == names[:-1]).any() or (part_keys and part_keys[-1][-1] == names[0]):
                    raise ValueError(f"replay rows repeat a key at position {here}")
                state: State | None = None
                if here:
                    slot = np.searchsorted(done_keys, names)
                    ok = slot < len(done_keys)
                    if not ok.all() or (done_keys[slot] != names).any():
                        raise ValueError(f"replay rows skip a position before {here}")
                    state = {k: v[slot] for k, v in done_state.items()}
                new_state, columns = step(state, rows, here)
                part_keys.append(names)
                part_state.append(new_state)
                out = rows[[*keys, order, *carry]].reset_index(drop=True)
                for c, v in columns.items():
                    out[c] = list(v) if isinstance(v, np.ndarray) and v.ndim > 1 else v
                results.append(out)
            if results:
                yield results[0] if len(results) == 1 else pd.concat(results, ignore_index=True)

    return laid.mapInPandas(run, schema)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Stack an array column into (rows, width); nulls become NaN."""
    if len(column) == 0:
        return np.empty((0, width))
    return np.vstack([np.asarray(v, dtype=float) for v in column.to_numpy()])
