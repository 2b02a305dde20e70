"""Controller replays: belief filter, minimum hold, selectors, greedy and beam.

Input is one row per (clip, hop) whose per-channel values are arrays in channel
order (null = invalid).  All replays run on :func:`windfold.operators.fold.lockstep`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.operators.fold import State, lockstep, matrix

# Fixed values of the filter and the hold rule.
START_MEAN, START_VELOCITY = 70.0, 0.0
START_P00, START_P11 = 400.0, 25.0
PROCESS_NOISE = 0.1
MEASUREMENT_NOISE = 200.0
MIN_CONFIDENCE = 1e-6
CONFIDENT_AT = 0.2
MIN_HOLD = 2
HORIZON = 15
HORIZONS = (1, 5, 15)

BELIEF = ("mean", "velocity", "p00", "p01", "p10", "p11", "since_confident")


def start_state(shape: tuple[int, ...]) -> State:
    fill = lambda value, kind=float: np.full(shape, value, dtype=kind)
    return {
        "mean": fill(START_MEAN), "velocity": fill(START_VELOCITY),
        "p00": fill(START_P00), "p01": fill(0.0), "p10": fill(0.0), "p11": fill(START_P11),
        "since_confident": fill(0, np.int64), "previous": fill(-1, np.int64), "hold": fill(0, np.int64),
    }


def filter_step(s: State, value: np.ndarray, confidence: np.ndarray) -> State:
    """Constant-velocity predict, then update where the measurement is usable."""
    mean = s["mean"] + s["velocity"]
    p00 = s["p00"] + s["p01"] + s["p10"] + s["p11"] + PROCESS_NOISE / 3
    p01 = s["p01"] + s["p11"] + PROCESS_NOISE / 2
    p10 = s["p10"] + s["p11"] + PROCESS_NOISE / 2
    p11 = s["p11"] + PROCESS_NOISE
    use = np.isfinite(value) & np.isfinite(confidence) & (confidence > 0)
    c = np.where(use, confidence, 1.0)
    total = p00 + MEASUREMENT_NOISE / np.maximum(c, MIN_CONFIDENCE)
    g0 = np.where(use, p00 / total, 0.0)
    g1 = np.where(use, p10 / total, 0.0)
    miss = np.where(use, value, mean) - mean
    return {
        "mean": mean + g0 * miss,
        "velocity": s["velocity"] + g1 * miss,
        "p00": p00 - g0 * p00,
        "p01": p01 - g0 * p01,
        "p10": p10 - g1 * p00,
        "p11": p11 - g1 * p01,
        "since_confident": np.where(use & (c >= CONFIDENT_AT), 0, s["since_confident"] + 1),
    }


def is_free(s: State) -> np.ndarray:
    """Whether every action would execute as proposed."""
    return (s["previous"] < 0) | (s["hold"] >= MIN_HOLD)


def settle(s: State, proposed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum-hold rule: (executed action, hold after, legal)."""
    free = is_free(s)
    executed = np.where(free, proposed, s["previous"])
    hold = np.where(executed == s["previous"], s["hold"] + 1, 1)
    return executed, hold, free | (proposed == s["previous"])


def advance(s: State, value: np.ndarray, confidence: np.ndarray, executed: np.ndarray, hold: np.ndarray) -> State:
    return {**filter_step(s, value, confidence), "previous": executed, "hold": hold}


def pick(values: np.ndarray, action: np.ndarray) -> np.ndarray:
    """``values`` is (rows, channels); ``action`` is (rows, ...)."""
    flat = action.reshape(len(values), -1)
    return np.take_along_axis(values, flat, axis=1).reshape(action.shape)


# --- selectors -------------------------------------------------------------------

Choose = Callable[[dict[str, np.ndarray], pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Selector:
    """``choose(channels, rows, previous, free)`` returns one action per row.

    ``channels`` holds the (rows, channels) matrices, ``previous`` is -1 before
    the first action, ``free`` tells where a switch would be executed.
    """

    method: str
    choose: Choose
    columns: tuple[str, ...] = ()


def fixed_selector(action: int, method: str | None = None) -> Selector:
    return Selector(method or f"arm_{action}", lambda ch, rows, prev, free: np.full(len(prev), action))


def max_ratio_selector(method: str = "max_ppr") -> Selector:
    """Largest peak-power ratio; a tie keeps the current action, else the lowest
    index; with nothing valid the current action stays (0 at the start)."""

    def choose(ch, rows, prev, free):
        usable = np.isfinite(ch["ppr"]) & np.isfinite(ch["hr"])
        ratio = np.where(usable, ch["ppr"], -np.inf)
        top = ratio.max(axis=1)
        best = ratio.argmax(axis=1)
        current = np.maximum(prev, 0)
        keep = (prev >= 0) & usable[np.arange(len(prev)), current] & (pick(ratio, current[:, None])[:, 0] == top)
        return np.where(~usable.any(axis=1) | keep, current, best)

    return Selector(method, choose)


def random_selector(column: str, method: str) -> Selector:
    """Legal action drawn with the integer in ``column`` (a hash of seed, clip, hop)."""

    def choose(ch, rows, prev, free):
        draw = rows[column].to_numpy() % ch["hr"].shape[1]
        return np.where(free, draw, prev)

    return Selector(method, choose, (column,))


def proposal_selector(column: str, method: str) -> Selector:
    """Any policy supplied as data: the proposed action is read from ``column``."""
    return Selector(method, lambda ch, rows, prev, free: rows[column].to_numpy(), (column,))


# --- replays -----------------------------------------------------------------------

_REPLAY_DOUBLES = ("selected_hr_bpm", "selected_confidence", "selected_ppr", "selected_coverage",
                   "pre_belief_hr_bpm", "post_belief_hr_bpm", "post_velocity", "post_std_bpm",
                   "pre_p00", "pre_p01", "pre_p10", "pre_p11", "pre_velocity")
_REPLAY_INTS = ("proposed_action", "executed_action", "previous_action", "pre_hold_count", "post_hold_count", "pre_since_confident")
_REPLAY_FLAGS = ("legal", "selected_valid")


_REPLAY = (*_REPLAY_DOUBLES, *_REPLAY_INTS, *_REPLAY_FLAGS)


def replay(hops: DataFrame, selectors: Sequence[Selector], keys: Sequence[str] = ("clip_id",), order: str = "hop_idx") -> DataFrame:
    """Replay every selector over every clip in one pass; one row per (clip, hop, method).

    ``hops`` needs ``hr``, ``confidence``, ``ppr``, ``coverage`` arrays and the
    columns the selectors name.  No label column is read.
    """
    return unpacked(packed_replay(hops, selectors, keys, order), [s.method for s in selectors], (*keys, order))


def packed_replay(hops: DataFrame, selectors: Sequence[Selector], keys: Sequence[str] = ("clip_id",), order: str = "hop_idx") -> DataFrame:
    """``replay`` with one row per (clip, hop) and arrays by selector, for joins and neighbours ahead of ``unpacked``."""
    keys = list(keys)
    extra = sorted({c for s in selectors for c in s.columns})
    lean = hops.select(*keys, order, "hr", "confidence", "ppr", "coverage", *extra)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.select(*keys, order).schema)
    width = len(selectors)

    def step(state, rows, at):
        n = len(rows)
        ch = {c: _channels(rows[c]) for c in ("hr", "confidence", "ppr", "coverage")}
        s = start_state((n, width)) if state is None else state
        free = is_free(s)
        proposed = np.stack([sel.choose(ch, rows, s["previous"][:, j], free[:, j]) for j, sel in enumerate(selectors)], axis=1).astype(np.int64)
        executed, hold, legal = settle(s, proposed)
        value, confidence = pick(ch["hr"], executed), pick(ch["confidence"], executed)
        new = advance(s, value, confidence, executed, hold)
        out = {
            "selected_hr_bpm": value, "selected_confidence": confidence,
            "selected_ppr": pick(ch["ppr"], executed), "selected_coverage": pick(ch["coverage"], executed),
            "pre_belief_hr_bpm": s["mean"], "post_belief_hr_bpm": new["mean"], "post_velocity": new["velocity"],
            "post_std_bpm": np.sqrt(np.maximum(new["p00"], 0.0)),
            "pre_p00": s["p00"], "pre_p01": s["p01"], "pre_p10": s["p10"], "pre_p11": s["p11"], "pre_velocity": s["velocity"],
            "proposed_action": proposed, "executed_action": executed, "previous_action": s["previous"],
            "pre_hold_count": s["hold"], "post_hold_count": hold, "pre_since_confident": s["since_confident"],
            "legal": legal, "selected_valid": np.isfinite(value),
        }
        return new, out

    schema = ", ".join([key_types] + [f"{c} array<double>" for c in _REPLAY_DOUBLES]
                       + [f"{c} array<bigint>" for c in _REPLAY_INTS] + [f"{c} array<boolean>" for c in _REPLAY_FLAGS])
    return lockstep(lean, keys, order, step, schema)


def unpacked(packed: DataFrame, methods: Sequence[str], beside: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """One row per (packed row, method), with the columns ``beside``; arrays named with ``prefix``, null where there is no neighbour, come along.

    Arrays are read by place and not zipped, so those that nobody asks for are dropped ahead of the joins before.
    """
    near = [c for c in packed.columns if c.startswith(prefix) and c[len(prefix):] in _REPLAY]
    rows = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(methods) - 1))).alias("__at"))
    # NaN travels through NumPy for "no measurement"; it becomes null again here.
    value = lambda c, name: f"nullif({c}[__at], double('NaN')) AS {c}" if name in _REPLAY_DOUBLES else f"{c}[__at] AS {c}"
    names = ", ".join(f"'{m}'" for m in methods)
    return rows.selectExpr(
        f"array({names})[__at] AS method_id", *beside, *[value(c, c) for c in _REPLAY_DOUBLES],
        *[value(c, c) for c in _REPLAY_INTS if c != "previous_action"], "if(previous_action[__at] >= 0, previous_action[__at], NULL) AS previous_action",
        *[value(c, c) for c in _REPLAY_FLAGS], "if(legal[__at], NULL, 'minimum_hold') AS override_reason", *[value(c, c[len(prefix):]) for c in near])


def _channels(column: pd.Series) -> np.ndarray:
    return matrix(column, 0)


def greedy(hops: DataFrame, target: str = "gt_hr_bpm", keys: Sequence[str] = ("clip_id",), order: str = "hop_idx") -> DataFrame:
    """Per hop the legal action whose belief is closest to the target (ties: lowest index)."""
    keys = list(keys)
    lean = hops.select(*keys, order, "hr", "confidence", target)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.select(*keys, order).schema)

    def step(state, rows, at):
        hr, conf = _channels(rows["hr"]), _channels(rows["confidence"])
        n, width = hr.shape
        s = start_state((n,)) if state is None else state
        trial = filter_step({k: s[k][:, None] for k in BELIEF}, hr, conf)
        error = np.abs(trial["mean"] - rows[target].to_numpy(dtype=float)[:, None])
        legal = is_free(s)[:, None] | (np.arange(width)[None, :] == s["previous"][:, None])
        action = np.where(legal, error, np.inf).argmin(axis=1)
        executed, hold, ok = settle(s, action)
        one = lambda m: pick(m, executed[:, None])[:, 0]
        new = {**{k: one(trial[k]) for k in BELIEF}, "previous": executed, "hold": hold}
        return new, {
            "proposed_action": action, "executed_action": executed, "pre_hold_count": s["hold"], "post_hold_count": hold,
            "selected_valid": np.isfinite(one(hr)), "pre_belief_hr_bpm": s["mean"],
            "post_belief_hr_bpm": new["mean"], "abs_error_bpm": one(error),
        }

    return lockstep(lean, keys, order, step, key_types + ", proposed_action bigint, executed_action bigint, pre_hold_count bigint,"
                    " post_hold_count bigint, selected_valid boolean, pre_belief_hr_bpm double, post_belief_hr_bpm double, abs_error_bpm double")


def beam(hops: DataFrame, width: int = 8, target: str = "gt_hr_bpm", keys: Sequence[str] = ("clip_id",), order: str = "hop_idx") -> DataFrame:
    """Best complete path of a width-limited search on cumulative error.

    Ties go to the lexicographically smaller action sequence.  The forward pass
    keeps, per hop, only the parent rank and action of the survivors; a second
    pass in descending order follows the parents from the winner, so no path is
    ever held in memory.
    """
    keys = list(keys)
    # the length of a key comes from the input, so that the forward pass has one reader
    ends = hops.groupBy(*keys).agg(F.max(order).alias("__last"))
    lean = hops.select(*keys, order, "hr", "confidence", target).join(ends, keys)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.select(*keys, order, "__last").schema)

    def forward(state, rows, at):
        hr, conf = _channels(rows["hr"]), _channels(rows["confidence"])
        n, actions = hr.shape
        if state is None:
            s = start_state((n, 1))
            s["total"] = np.zeros((n, 1))
            s["lex"] = np.zeros((n, 1), dtype=np.int64)
        else:
            s = state
        live = s["mean"].shape[1]
        trial = filter_step({k: s[k][:, :, None] for k in BELIEF}, hr[:, None, :], conf[:, None, :])
        error = np.abs(trial["mean"] - rows[target].to_numpy(dtype=float)[:, None, None])
        ids = np.broadcast_to(np.arange(actions), (n, live, actions))
        same = ids == s["previous"][:, :, None]
        allowed = (is_free(s)[:, :, None] | same) & np.isfinite(s["total"])[:, :, None]
        total = np.where(allowed, s["total"][:, :, None] + error, np.inf)
        sequence = s["lex"][:, :, None] * actions + ids
        flat = lambda m: np.broadcast_to(m, (n, live, actions)).reshape(n, live * actions)
        by_sequence = np.argsort(flat(sequence), axis=1, kind="stable")
        ranked = np.take_along_axis(flat(total), by_sequence, axis=1).argsort(axis=1, kind="stable")
        keep = np.take_along_axis(by_sequence, ranked, axis=1)[:, :width]
        take = lambda m: np.take_along_axis(flat(m), keep, axis=1)
        new = {k: take(trial[k]) for k in BELIEF}
        new["previous"] = take(ids)
        new["hold"] = np.where(take(same), take(s["hold"][:, :, None]) + 1, 1)
        new["total"] = take(total)
        kept_sequence = take(sequence)
        new["lex"] = kept_sequence.argsort(axis=1).argsort(axis=1)
        parent = keep // actions
        old = lambda m: np.take_along_axis(m, parent, axis=1)
        # Slots that hold no path keep a total of infinity and are never followed.
        return _pad(new, width), {
            "parent": parent, "action": take(ids), "error": take(error), "pre_hold": old(s["hold"]),
            "post_hold": new["hold"], "pre": old(s["mean"]), "post": new["mean"],
        }

    trail = lockstep(lean, keys, order, forward, key_types + ", parent array<bigint>, action array<bigint>, error array<double>,"
                     " pre_hold array<bigint>, post_hold array<bigint>, pre array<double>, post array<double>", carry=["__last"])
    back = trail.withColumn("__back", F.col("__last") - F.col(order))

    def backward(state, rows, at):
        rank = np.zeros(len(rows), dtype=np.int64) if state is None else state["rank"]
        on = lambda c: np.array([v[r] for v, r in zip(rows[c], rank)])
        return {"rank": on("parent")}, {c: on(c) for c in ("action", "error", "pre_hold", "post_hold", "pre", "post")}

    order_type = dict(lean.dtypes)[order]
    walked = lockstep(back, keys, "__back", backward, ", ".join(f"{k} {dict(lean.dtypes)[k]}" for k in keys)
                      + f", __back bigint, {order} {order_type}, action bigint, error double, pre_hold bigint, post_hold bigint, pre double, post double",
                      carry=[order])
    return walked.select(
        *keys, order, F.col("action").alias("proposed_action"), F.col("action").alias("executed_action"),
        F.col("pre_hold").alias("pre_hold_count"), F.col("post_hold").alias("post_hold_count"),
        F.col("pre").alias("pre_belief_hr_bpm"), F.col("post").alias("post_belief_hr_bpm"), F.col("error").alias("abs_error_bpm"))


def _pad(state: State, width: int) -> State:
    """Give every state the same number of slots, so keys can be stacked."""
    have = state["mean"].shape[1]
    if have >= width:
        return state
    out = {}
    for k, v in state.items():
        fill = np.inf if k == "total" else 0
        extra = np.full((len(v), width - have), fill, dtype=v.dtype)
        if k == "lex":
            extra += np.arange(have, width)
        out[k] = np.concatenate([v, extra], axis=1)
    return out
