"""What-if replays around a factual trace: counterfactuals, branches, repeated corrections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windfold.functions import columns as col
from windfold.operators.replay import BELIEF, HORIZON, MIN_HOLD, Selector, advance, filter_step, is_free, pick, settle
from windfold.operators.windows import ahead

#: Anchors finished together.
ANCHORS = 1000
#: Odd factor that spreads the bits of a state over its hash.
MIXER = np.uint64(0x9E3779B97F4A7C15)

SNAPSHOT = ("pre_belief_hr_bpm", "pre_velocity", "pre_p00", "pre_p01", "pre_p10", "pre_p11", "pre_since_confident", "previous_action", "pre_hold_count")


def free_choice() -> Column:
    return F.col("previous_action").isNull() | (F.col("pre_hold_count") >= MIN_HOLD)


def what_if(trace: DataFrame, hops: DataFrame, channels: int, keys: Sequence[str] = ("clip_id", "hop_idx")) -> DataFrame:
    """Every action from the factual pre-state of every hop, as arrays by action.

    A row-wise expression, no fold: ``if_valid`` and ``if_belief`` hold, for each
    requested action, whether the executed channel is valid and the belief after it.
    """
    rows = trace.join(hops.select(*keys, "hr", "confidence"), list(keys)).withColumn("__free", free_choice())
    valid, belief = [], []
    for a in range(channels):
        executed = F.when(F.col("__free"), F.lit(a)).otherwise(F.col("previous_action")).cast("int") + 1
        value, confidence = F.element_at("hr", executed), F.element_at("confidence", executed)
        s = col.filter_step(F.col("pre_belief_hr_bpm"), F.col("pre_velocity"), F.col("pre_p00"), F.col("pre_p01"), F.col("pre_p10"), F.col("pre_p11"), value, confidence)
        valid.append(value.isNotNull())
        belief.append(s["mean"])
    return rows.select(*trace.columns, F.col("__free").alias("free"), F.array(*valid).alias("if_valid"), F.array(*belief).alias("if_belief"))


def anchors(trace: DataFrame, hop_counts: DataFrame, window: int = HORIZON, keys: Sequence[str] = ()) -> DataFrame:
    """Hops where every action is free and ``window`` hops remain, with their pre-state."""
    return (trace.join(hop_counts, "clip_id").where(free_choice() & (F.col("hop_count") - F.col("hop_idx") >= window))
            .select(*keys, "clip_id", F.col("hop_idx").alias("anchor"), *SNAPSHOT))


def _start(rows, width: int) -> dict[str, np.ndarray]:
    names = dict(zip((*BELIEF, "previous", "hold"), SNAPSHOT))
    out = {}
    for k, c in names.items():
        v = rows[c].to_numpy(dtype=float)
        v = np.where(np.isnan(v), -1, v) if k == "previous" else v
        kind = np.int64 if k in ("since_confident", "previous", "hold") else float
        out[k] = np.repeat(v.astype(kind)[:, None], width, axis=1)
    return out


def _listed(starts: DataFrame, hops: DataFrame, window: int, columns: Sequence[str], keys: Sequence[str], extra: dict[str, str]) -> DataFrame:
    """One row per anchor with its pre-state and the ``window`` hops from it on as arrays.

    An anchor is then finished in one step: no state outlives a batch of rows.  Anchors are
    laid beside the hops of their clip, so that a hop is sent once, not to every anchor
    that sees it.
    """
    heads = [k for k in keys if k not in ("clip_id", "anchor")]
    tables = {"__s": starts.select("clip_id", F.col("anchor").alias("hop_idx"), *heads, *SNAPSHOT), "__h": hops}
    both = ahead(tables, ["clip_id"], "hop_idx", {"__w": ("collect_list(__h)", window - 1)}).where("__s IS NOT NULL")
    rows = both.select("clip_id", F.col("hop_idx").alias("anchor"), *[f"__s.{c}" for c in (*heads, *SNAPSHOT)], "__w")
    here = [F.expr(f"transform(__w, h -> {extra[c]})") if c in extra else F.col(f"__w.{c}") for c in columns]
    return rows.select(*keys, *SNAPSHOT, F.col("__w.hop_idx").alias("hop_idx"), *[v.alias(c) for v, c in zip(here, columns)])


def _array(column: pa.Array, *shape: int) -> np.ndarray:
    """Nested lists of one shape as an array; null is NaN."""
    for _ in shape:
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)


def _nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array of two or more dimensions as a column of nested lists."""
    out = pa.array(values.ravel(), kind)
    for size in reversed(values.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(out) // size + 1) * size, pa.int32()), out)
    return out


def _leading(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The first of each row's values as a column of lists."""
    some = np.arange(values.shape[1]) < lengths[:, None]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values[some], kind))


def _by_anchor(listed: DataFrame, keys: Sequence[str], window: int, channels: int, policy: Selector, target: str | None, finish, schema: str) -> DataFrame:
    """``finish(channels, start, given, target)`` over slices of anchors gives the columns that follow the keys, and the row of the slice for each of its rows."""
    shaped = ("hr", "confidence", "ppr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(lo, ANCHORS)
                lengths = pc.list_value_length(batch.column("hop_idx"))
                if pc.any(pc.not_equal(lengths, window)).as_py():
                    raise ValueError("replay rows are not contiguous: an anchor lacks hops")
                ch = {c: _array(batch.column(c), window, channels) for c in shaped}
                given = {c: _array(batch.column(c), window) for c in policy.columns}
                start = batch.select(list(SNAPSHOT)).to_pandas()
                for rows, columns in finish(ch, start, given, None if target is None else _array(batch.column(target), window)):
                    heads = [batch.column(k).take(pa.array(rows)) for k in (*keys, "hop_idx")]
                    yield pa.RecordBatch.from_arrays([*heads, *columns.values()], names=[*keys, "hop_idx", *columns])

    types = dict(listed.dtypes)
    heads = ", ".join(f"{k} {types[k]}" for k in keys) + ", hop_idx array<bigint>, "
    return listed.mapInArrow(run, heads + schema)


def branch_windows(starts: DataFrame, hops: DataFrame, policy: Selector, channels: int, window: int = HORIZON, keys: Sequence[str] = ("clip_id", "anchor"), extra: dict[str, str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Force each action once at each anchor, then follow the policy.

    One row per anchor, with arrays by (offset, action); no label is read.  ``extra`` has
    SQL of columns for the policy that need both the anchor and the hop ``h``, made of the
    columns ``also`` of the hops.
    """
    keys, extra = list(keys), extra or {}
    taken = [*also, *[c for c in policy.columns if c not in extra]]
    listed = _listed(starts, hops.select("clip_id", "hop_idx", "hr", "confidence", "ppr", *taken), window, ["hr", "confidence", "ppr", *policy.columns], keys, extra)

    def finish(ch, start, given, _):
        s, n = _start(start, channels), len(start)
        out = {k: np.empty((n, window, channels)) for k in ("proposed", "executed", "legal", "belief")}
        for at in range(window):
            here = {c: v[:, at] for c, v in ch.items()}
            free = is_free(s)
            if at == 0:
                proposed = np.broadcast_to(np.arange(channels), (n, channels))
            else:
                rows = pd.DataFrame({c: v[:, at].astype(np.int64) for c, v in given.items()}, index=range(n))
                proposed = np.stack([policy.choose(here, rows, s["previous"][:, j], free[:, j]) for j in range(channels)], axis=1)
            executed, hold, legal = settle(s, proposed.astype(np.int64))
            s = advance(s, pick(here["hr"], executed), pick(here["confidence"], executed), executed, hold)
            for k, v in (("proposed", proposed), ("executed", executed), ("legal", legal), ("belief", s["mean"])):
                out[k][:, at] = v
        kinds = {"proposed": pa.int64(), "executed": pa.int64(), "legal": pa.bool_(), "belief": pa.float64()}
        yield np.arange(n), {k: _nested(v.astype(bool if k == "legal" else v.dtype if k == "belief" else np.int64), kinds[k]) for k, v in out.items()}

    return _by_anchor(listed, keys, window, channels, policy, None, finish, "proposed array<array<bigint>>, executed array<array<bigint>>, legal array<array<boolean>>, belief array<array<double>>")


def branches(starts: DataFrame, hops: DataFrame, policy: Selector, channels: int, window: int = HORIZON, keys: Sequence[str] = ("clip_id", "anchor"), extra: dict[str, str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """``branch_windows`` with one row per (keys, action, offset)."""
    out = branch_windows(starts, hops, policy, channels, window, keys, extra, also)
    by_hop = out.select(*keys, F.posexplode(F.arrays_zip("hop_idx", "proposed", "executed", "legal", "belief")).alias("offset", "o"))
    by_action = by_hop.select(*keys, F.col("offset").cast("bigint").alias("offset"), F.col("o.hop_idx").alias("hop_idx"), F.posexplode(F.arrays_zip("o.proposed", "o.executed", "o.legal", "o.belief")).alias("branch_action", "b"))
    return by_action.selectExpr(*keys, "branch_action", "offset", "hop_idx", "b.proposed AS proposed_action", "b.executed AS executed_action", "b.legal", "b.belief AS post_belief_hr_bpm")


_COUNTS = ("generated", "deduped", "retained", "pruned")
_PATH = "array<struct<total: double, seq: array<bigint>, errors: array<double>, corrected: array<boolean>, policy: array<bigint>>>"


def correction_windows(starts: DataFrame, hops: DataFrame, policy: Selector, channels: int, widths: Sequence[int] = (8,), window: int = HORIZON, target: str = "gt_hr_bpm",
                       keys: Sequence[str] = ("clip_id", "anchor"), extra: dict[str, str] | None = None, also: Sequence[str] = (), with_paths: bool = True) -> DataFrame:
    """Beam of paths that at each hop either take the best immediate action or follow the policy, at several widths.

    Children with the same controller state are merged to the one with the
    smaller (total, endpoint, sequence).  One row per (keys, width): the accounting of
    every depth as arrays and, unless ``with_paths`` is off, the surviving paths in rank
    order.  A null target ends an anchor's search: its arrays stop before that hop and no
    path survives.  All widths are finished from one reading of an anchor, and an anchor that a
    width did not prune has the same paths at every larger one.
    """
    keys, extra = list(keys), extra or {}
    taken = [*also, *[c for c in policy.columns if c not in extra]]
    listed = _listed(starts, hops.select("clip_id", "hop_idx", "hr", "confidence", "ppr", target, *taken), window, ["hr", "confidence", "ppr", target, *policy.columns], keys, extra)

    def finish(ch, start, given, wanted):
        n, done = len(start), None
        blank = np.isnan(wanted)
        reach = np.where(blank.any(axis=1), blank.argmax(axis=1), window)
        wanted = np.where(blank, 0.0, wanted)
        for width in sorted(widths):
            todo = np.arange(n) if done is None else np.flatnonzero(done["counts"][:, -1].any(axis=1))
            if len(todo):
                cut = lambda columns: {c: v[todo] for c, v in columns.items()}
                found = _beam(cut(ch), start.iloc[todo], cut(given), wanted[todo], policy, width, window, with_paths)
                done = found if done is None else _replaced(done, todo, found)
            columns = {"width": pa.array(np.full(n, width), pa.int64())} | {k: _leading(done["counts"][:, i], reach, pa.int64()) for i, k in enumerate(_COUNTS)}
            columns |= {"best_total": _leading(done["best"][:, 0], reach, pa.float64()), "best_endpoint": _leading(done["best"][:, 1], reach, pa.float64())}
            if with_paths:
                kept = np.isfinite(done["total"]) & (reach == window)[:, None]
                inner = [pa.array(done["total"][kept])] + [_nested(done[k][kept], t) for k, t in (("seq", pa.int64()), ("errors", pa.float64()), ("corrected", pa.bool_()), ("policy", pa.int64()))]
                columns["paths"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept.sum(axis=1)))), pa.int32()), pa.StructArray.from_arrays(inner, names=["total", "seq", "errors", "corrected", "policy"]))
            yield np.arange(n), columns

    schema = "width bigint, " + ", ".join(f"{k} array<bigint>" for k in _COUNTS) + ", best_total array<double>, best_endpoint array<double>"
    return _by_anchor(listed, keys, window, channels, policy, target, finish, schema + (f", paths {_PATH}" if with_paths else ""))


def repeated_corrections(starts: DataFrame, hops: DataFrame, policy: Selector, channels: int, widths: Sequence[int] = (8,), window: int = HORIZON, target: str = "gt_hr_bpm",
                         keys: Sequence[str] = ("clip_id", "anchor"), extra: dict[str, str] | None = None, also: Sequence[str] = (), with_paths: bool = True) -> DataFrame:
    """``correction_windows`` with one row per (keys, width, offset); the last depth also lists the surviving paths."""
    out = correction_windows(starts, hops, policy, channels, widths, window, target, keys, extra, also, with_paths)
    listed = ["paths"] if with_paths else []
    by_hop = out.select(*keys, "width", *listed, F.posexplode(F.arrays_zip(*_COUNTS, "best_total", "best_endpoint")).alias("offset", "o"))
    return by_hop.select(*keys, "width", F.col("offset").cast("bigint").alias("offset"), "o.*", *[F.when(F.col("offset") == window - 1, F.col(c)).alias(c) for c in listed])


def _beam(ch, start, given, wanted, policy, width, window, with_paths):
    """All depths of the beam of every anchor: counts and best path by depth, and the paths that survive.

    A depth keeps the parent of each path; paths are walked back from the last one.
    """
    n = len(start)
    s = _start(start, 1) | {"total": np.zeros((n, 1)), "lex": np.zeros((n, 1), np.int64)}
    counts, best, trail = np.empty((n, len(_COUNTS), window), np.int64), np.empty((n, 2, window)), []
    for at in range(window):
        rows = pd.DataFrame({c: v[:, at].astype(np.int64) for c, v in given.items()}, index=range(n))
        s, step, counts[:, :, at] = _deepen(s, {c: v[:, at] for c, v in ch.items()}, wanted[:, at], policy, rows, width)
        best[:, 0, at], best[:, 1, at] = s["total"][:, 0], step["errors"][:, 0]
        trail.append(step)
    found = {"counts": counts, "best": best}
    if with_paths:
        found["total"] = s["total"]
        on = np.broadcast_to(np.arange(s["total"].shape[1]), s["total"].shape)
        kinds = (("seq", np.int64), ("errors", float), ("corrected", bool), ("policy", np.int64))
        found |= {k: np.empty((*on.shape, window), kind) for k, kind in kinds}
        for at in range(window - 1, -1, -1):
            for k, _ in kinds:
                found[k][:, :, at] = np.take_along_axis(trail[at][k], on, axis=1)
            on = np.take_along_axis(trail[at]["parent"], on, axis=1)
    return found


def _replaced(done, rows, found):
    """``done`` with the results of ``rows`` taken from ``found``, which may list more paths."""
    out = {}
    for k, v in done.items():
        more = found[k].shape[1] - v.shape[1]
        if more > 0:
            v = np.concatenate([v, np.full((len(v), more, *v.shape[2:]), np.inf if k == "total" else 0, v.dtype)], axis=1)
        elif more < 0:
            v = v.copy()
        if k == "total":
            v[rows] = np.inf
        v[rows, : found[k].shape[1]] = found[k]
        out[k] = v
    return out


def _deepen(s, ch, wanted, policy, rows, width):
    """One depth of the beam of every anchor: the new state, the step of each path in it and the four counts."""
    n, actions = ch["hr"].shape
    live = s["total"].shape[1]
    trial = filter_step({k: s[k][:, :, None] for k in BELIEF}, ch["hr"][:, None, :], ch["confidence"][:, None, :])
    error = np.abs(trial["mean"] - wanted[:, None, None])
    free = is_free(s)
    ids = np.arange(actions)[None, None, :]
    legal = free[:, :, None] | (ids == s["previous"][:, :, None])
    first = np.where(legal, error, np.inf).argmin(axis=2)
    follow = np.stack([policy.choose(ch, rows, s["previous"][:, j], free[:, j]) for j in range(live)], axis=1).astype(np.int64)
    follow_legal = np.take_along_axis(legal, follow[:, :, None], axis=2)[:, :, 0]
    alive = np.isfinite(s["total"])
    both = lambda m: np.concatenate([m, m], axis=1)
    action = np.concatenate([first, follow], axis=1)
    exists = np.concatenate([alive, alive & follow_legal & (follow != first)], axis=1)
    at_action = lambda m: np.take_along_axis(both(np.broadcast_to(m, (n, live, actions))), action[:, :, None], axis=2)[:, :, 0]
    end = at_action(error)
    if s["lex"].max(initial=0) >= 2**62 // actions:
        # the sequences themselves became too long for a number: their ranks are kept
        s["lex"] = s["lex"].argsort(axis=1).argsort(axis=1)
    child = {k: at_action(trial[k]) for k in BELIEF}
    child |= {"previous": action, "hold": np.where(action == both(s["previous"]), both(s["hold"]) + 1, 1)}
    child |= {"total": np.where(exists, both(s["total"]) + end, np.inf), "lex": both(s["lex"]) * actions + action}
    corrected = np.concatenate([follow_legal & (first != follow), np.zeros_like(follow_legal)], axis=1)
    step = {"parent": both(np.broadcast_to(np.arange(live), (n, live))), "seq": action, "errors": end, "corrected": corrected, "policy": both(follow)}
    # rank by (total, endpoint, sequence)
    order = np.lexsort((child["lex"], end, child["total"]), axis=1)
    ranked = {k: np.take_along_axis(v, order, axis=1) for k, v in child.items()}
    real = np.take_along_axis(exists, order, axis=1)
    duplicate = _repeated([ranked[k] for k in (*BELIEF, "previous", "hold")], real)
    kept = real & ~duplicate
    generated, merged, retained = real.sum(axis=1), duplicate.sum(axis=1), np.minimum(kept.sum(axis=1), width)
    keep = (~kept).argsort(axis=1, kind="stable")[:, : retained.max(initial=1)]
    ranked["total"] = np.where(kept, ranked["total"], np.inf)
    new = {k: np.take_along_axis(v, keep, axis=1) for k, v in ranked.items()}
    keep = np.take_along_axis(order, keep, axis=1)
    return new, {k: np.take_along_axis(v, keep, axis=1) for k, v in step.items()}, np.stack((generated, merged, retained, generated - merged - retained), axis=1)


def _repeated(columns: list[np.ndarray], real: np.ndarray) -> np.ndarray:
    """Entries of each row that equal an earlier one in all columns; hashes find them, values decide."""
    n, size = real.shape
    mixed = np.zeros((n, size), np.uint64)
    for v in columns:
        # adding zero makes the two zeros one
        bits = (v + 0.0).view(np.uint64) if v.dtype == float else v.astype(np.uint64)
        mixed = (mixed ^ bits) * MIXER
        mixed ^= mixed >> np.uint64(29)
    mixed = np.where(real, mixed, np.arange(size, dtype=np.uint64))
    order = mixed.argsort(axis=1, kind="stable")
    at = lambda m: np.take_along_axis(m, order, axis=1)
    hashes, usable = at(mixed), at(real)
    met = hashes[:, 1:] == hashes[:, :-1]
    equal = met & usable[:, 1:] & usable[:, :-1]
    where = np.nonzero(equal)
    for v in columns:
        v = at(v)
        equal[where] &= v[:, 1:][where] == v[:, :-1][where]
    if (met & ~equal).any():
        # unequal entries with one hash: compare all pairs
        same = np.tril(np.ones((size, size), dtype=bool), -1)[None] & real[:, None, :] & real[:, :, None]
        for v in columns:
            same = same & (v[:, :, None] == v[:, None, :])
        return same.any(axis=2)
    out = np.zeros((n, size), dtype=bool)
    np.put_along_axis(out, order[:, 1:], equal, axis=1)
    return out


def paths(beam: DataFrame, window: int = HORIZON, keys: Sequence[str] = ("clip_id", "anchor")) -> DataFrame:
    """Surviving paths, one row each."""
    return beam.where(F.col("offset") == window - 1).select(*keys, "width", F.posexplode("paths").alias("path_rank", "p")).select(*keys, "width", "path_rank", "p.*")


def recovery_class(gains: Column, tolerance: float = 1e-6) -> Column:
    """Shape of a gain series: sign pattern of the gains over the offsets."""
    ahead = F.transform(gains, lambda g: g > tolerance)
    first_not, first_yes = F.array_position(ahead, False), F.array_position(ahead, True)
    last_yes = F.size(gains) + 1 - F.array_position(F.reverse(ahead), True)
    last_not = F.size(gains) + 1 - F.array_position(F.reverse(ahead), False)
    return (F.when(first_not == 0, "better_throughout").when(first_yes == 0, "never_better")
            .when((first_yes == 1) & (last_yes < first_not) & (F.element_at(gains, -1) < -tolerance), "briefly_better_then_ends_worse")
            .when((first_yes > 1) & (last_not < first_yes), "only_ends_better_late").otherwise("mixed_intermittent"))
