"""Spectra over overlapping windows of keyed series.

Frames are cut into (key, block) groups with a halo (``hop_blocks``), sorted rows
go to Python once, and the windows and channels of many groups are handled by
array operations together.  A filter with zero initial state over a window of n samples is a
lower-triangular n x n matrix, so filtering is a matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windfold.operators.fold import spread
from windfold.operators.windows import hop_blocks

# Fixed values of the pulse signal chain.
WINDOW_SECONDS, STEP_SECONDS, SUBWINDOW_SECONDS = 8.0, 1.0, 1.6
POST_BAND, POST_ORDER = (0.75, 3.0), 1
RATE_BAND, RATE_ORDER = (0.5, 3.0), 3
MIN_FFT = 4096
TOLERANCE = 1e-8
#: Windows that are transformed at a time.
SPECTRA = 256
PROJECTION = ((0.0, 1.0, -1.0), (-2.0, 1.0, 1.0))
REASONS = ("missing_required_rgb", "degenerate_channel_mean", "degenerate_projection", "degenerate_pos_postprocess", "degenerate_spectrum")


@lru_cache(maxsize=64)
def bandpass_coefficients(order: int, low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth band-pass (pre-warped bilinear transform), transfer-function form."""
    w1, w2 = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    width, centre2 = w2 - w1, w1 * w2
    proto = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half * half - centre2 + 0j)
    poles = np.concatenate([half + root, half - root])
    k = 2 * fs
    gain = width**order * np.real(k**order / np.prod(k - poles))
    b = gain * np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    a = np.real(np.poly((k + poles) / (k - poles)))
    return b, a


@lru_cache(maxsize=64)
def filter_matrix(order: int, low: float, high: float, fs: float, n: int) -> np.ndarray:
    """(n, n) matrix M with ``x @ M`` = causal filter of x from a zero state."""
    b, a = bandpass_coefficients(order, low, high, fs)
    h = np.zeros(n)
    for i in range(n):
        h[i] = (b[i] if i < len(b) else 0.0) - sum(a[j] * h[i - j] for j in range(1, min(i, len(a) - 1) + 1))
    lag = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(lag >= 0, h[np.clip(lag, 0, n - 1)], 0.0)


def pulse_projection(rgb: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Plane-orthogonal-to-skin projection (Wang et al. 2017, Algorithm 1).

    ``rgb`` is (series, n, 3).  Returns the pulse (series, n) and, per series,
    0 = fine, 1 = a channel mean vanishes, 2 = the projection is constant.
    """
    length = math.ceil(SUBWINDOW_SECONDS * fps)
    series, n, _ = rgb.shape
    out, problem = np.zeros((series, n)), np.zeros(series, dtype=int)
    basis = np.array(PROJECTION).T
    for start in range(n - length + 1):
        part = rgb[:, start:start + length]
        mean = part.mean(axis=1, keepdims=True)
        flat = (np.abs(mean) <= TOLERANCE).any(axis=(1, 2))
        pair = part / np.where(np.abs(mean) <= TOLERANCE, 1.0, mean) @ basis
        spread = pair.std(axis=1)
        still = ~np.isfinite(spread[:, 1]) | (spread[:, 1] <= TOLERANCE)
        problem = np.where(problem > 0, problem, np.where(flat, 1, np.where(still, 2, 0)))
        mix = pair[:, :, 0] + (spread[:, 0] / np.where(still, 1.0, spread[:, 1]))[:, None] * pair[:, :, 1]
        out[:, start:start + length] += mix - mix.mean(axis=1, keepdims=True)
    return out, problem


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x - x.mean(axis=1, keepdims=True)
    scale = x.std(axis=1)
    bad = ~np.isfinite(scale) | (scale <= TOLERANCE)
    return x / np.where(bad, 1.0, scale)[:, None], bad


@lru_cache(maxsize=64)
def _band_rows(n: int, nfft: int, fs: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    freq = np.arange(nfft // 2 + 1) * fs / nfft
    inside = (freq >= low) & (freq <= high)
    return freq[inside], inside


def _power(x: np.ndarray, fs: float, nfft: int) -> np.ndarray:
    """One-sided density of the mean-removed, Hann-weighted rows."""
    n = x.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)
    spectrum = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, nfft, axis=1)) ** 2 / (fs * (window**2).sum())
    spectrum[:, 1:(-1 if nfft % 2 == 0 else None)] *= 2
    return spectrum


def dominant_rate(x: np.ndarray, fs: float, band: tuple[float, float] = RATE_BAND, floor: float = TOLERANCE,
                  order: int = RATE_ORDER, min_fft: int = MIN_FFT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (series, n) -> rate per minute of the first maximum on the padded grid,
    share of the largest line on the natural grid, and a failure mask."""
    n = x.shape[1]
    y = (x - x.mean(axis=1, keepdims=True)) @ filter_matrix(order, *band, fs, n)
    scale = y.std(axis=1)
    bad = ~np.isfinite(scale) | (scale <= floor)
    freq, inside = _band_rows(n, max(min_fft, 1 << (n - 1).bit_length()), fs, *band)
    _, natural = _band_rows(n, n, fs, *band)
    padded = _power(y, fs, max(min_fft, 1 << (n - 1).bit_length()))[:, inside]
    lines = _power(y, fs, n)[:, natural]
    total = lines.sum(axis=1)
    bad |= ~np.isfinite(total) | (total <= floor)
    ratio = lines.max(axis=1) / np.where(bad, 1.0, total)
    return freq[padded.argmax(axis=1)] * 60.0, ratio, bad


def window_rates(rgb: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(series, n, 3) windows -> rate, ratio, reason code (0 fine, else 1-based in REASONS)."""
    missing = ~np.isfinite(rgb).all(axis=(1, 2))
    clean = np.where(missing[:, None, None], 1.0, rgb)
    pulse, problem = pulse_projection(clean, fps)
    post, flat = standardise(pulse @ filter_matrix(POST_ORDER, *POST_BAND, fps, rgb.shape[1]))
    rate, ratio, bad = dominant_rate(post, fps)
    code = np.where(missing, 1, np.where(problem == 1, 2, np.where(problem == 2, 3, np.where(flat, 4, np.where(bad, 5, 0)))))
    return rate, ratio, code


def _by_block(blocked: DataFrame, keys: Sequence[str], order: str, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str) -> DataFrame:
    """Sorted rows through ``run(rows, cuts)``, many whole (key, block) groups at a time; group ``i`` has the rows from ``cuts[i]`` to ``cuts[i + 1]``.

    Short keys make many small blocks, and a call of its own would cost each far
    more than its windows.  The last group of a frame waits for the next frame,
    so a task holds one frame and one block.
    """
    by = [*keys, "block"]
    laid = spread(blocked, by).sortWithinPartitions(*by, order)

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            cuts = _starts(rows, by)
            if len(cuts) > 1:
                out = run(rows.iloc[:cuts[-1]], cuts)
                if out is not None:
                    yield out
            held = rows.iloc[cuts[-1]:].reset_index(drop=True)
        if held is not None:
            out = run(held, np.array([0, len(held)]))
            if out is not None:
                yield out

    return laid.mapInPandas(streamed, schema)


def _starts(rows: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Where groups of equal neighbours begin; null keys are equal."""
    new = np.ones(len(rows), dtype=bool)
    new[1:] = False
    for k in by:
        v, gone = rows[k].to_numpy(), rows[k].isna().to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])
    return np.flatnonzero(new)


def _places(cuts: np.ndarray, block: np.ndarray, size: int, step: int, hops_per_block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, hop and first row of every whole window of the groups."""
    here = np.clip((np.diff(cuts) - size) // step + 1, 0, hops_per_block)
    owner = np.repeat(np.arange(len(here)), here)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(here) - here, here)
    return owner, block[owner] * hops_per_block + within, cuts[owner] + within * step


def hop_measurements(frames: DataFrame, fps: float, keys: Sequence[str] = ("clip_id",), hops_per_block: int = 60) -> DataFrame:
    """Per (key, hop, channel): rate, confidence, ratio, coverage or an invalid reason.

    ``frames`` has a dense ``frame_idx`` and ``rois``, an array of structs with
    ``r, g, b, coverage`` (null r/g/b = missing or imputed).
    """
    keys = list(keys)
    size, step = round(WINDOW_SECONDS * fps), round(STEP_SECONDS * fps)
    types = dict(frames.dtypes)
    names = ["r", "g", "b", "coverage"]
    lean = frames.select(*keys, "frame_idx", *[F.col(f"rois.{c}").alias(c) for c in names])
    blocked = hop_blocks(lean, "frame_idx", size, step, hops_per_block)

    def run(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        first, block = cuts[:-1], rows["block"].to_numpy()[cuts[:-1]]
        if (rows["frame_idx"].to_numpy() != np.repeat(block * hops_per_block * step - first, np.diff(cuts)) + np.arange(len(rows))).any():
            raise ValueError("frame index is not contiguous")
        owner, hop, at = _places(cuts, block, size, step, hops_per_block)
        done = []
        for k in range(0, len(at), SPECTRA):
            some = slice(k, k + SPECTRA)
            picked = at[some, None] + np.arange(size)
            a, z = picked[0, 0], picked[-1, -1] + 1
            cube = np.stack([np.vstack(rows[c].to_numpy()[a:z]).astype(float) for c in names], axis=2)
            w = cube[picked - a]
            hops, _, rois, _ = w.shape
            flat = np.moveaxis(w, 2, 1).reshape(hops * rois, size, 4)
            rate, ratio, code = window_rates(flat[:, :, :3], fps)
            cover = flat[:, :, 3].mean(axis=1)
            ok = code == 0
            reasons = np.array([None, *REASONS], dtype=object)
            done.append(pd.DataFrame({
                **{k: np.repeat(rows[k].to_numpy()[first[owner[some]]], rois) for k in keys}, "hop_idx": np.repeat(hop[some], rois), "roi_index": np.tile(np.arange(rois), hops),
                "hr_bpm": np.where(ok, rate, np.nan), "confidence": np.where(ok, ratio * cover, np.nan), "ppr": np.where(ok, ratio, np.nan), "coverage": cover,
                "valid": ok, "invalid_reason": reasons[code]}))
        return pd.concat(done, ignore_index=True) if done else None

    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    out = _by_block(blocked, keys, "frame_idx", run, f"{key_types}, hop_idx bigint, roi_index int, hr_bpm double, confidence double, ppr double, coverage double, valid boolean, invalid_reason string")
    return out.select(*keys, "hop_idx", "roi_index", *[F.expr(f"nullif({c}, double('NaN')) AS {c}") for c in ("hr_bpm", "confidence", "ppr", "coverage")], "valid", "invalid_reason")


def hop_labels(truth: DataFrame, fps: float, keys: Sequence[str] = ("clip_id",), hop_count: int | None = None, hops_per_block: int = 60) -> DataFrame:
    """Ground-truth rate per hop over +-4 s around the hop end, clipped at the clip edges.

    ``truth`` has a dense ``frame_idx``, ``n_frames`` and ``gt_ppg``.  With
    ``hop_count`` every key must have exactly that many hops.
    """
    keys = list(keys)
    size, step, half = round(WINDOW_SECONDS * fps), round(STEP_SECONDS * fps), round(WINDOW_SECONDS * fps / 2)
    types = dict(truth.dtypes)
    # A label window ends ``half`` samples after the measurement window: same blocks, longer halo.
    blocked = hop_blocks(truth.select(*keys, "frame_idx", "n_frames", "gt_ppg"), "frame_idx", size + half, step, hops_per_block)

    def run(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        first, length = cuts[:-1], np.diff(cuts)
        block, n = rows["block"].to_numpy()[first], rows["n_frames"].to_numpy()[first]
        start = block * hops_per_block * step
        if (rows["frame_idx"].to_numpy() != np.repeat(start - first, length) + np.arange(len(rows))).any():
            raise ValueError("frame index is not contiguous")
        hops = np.maximum(0, (n - size) // step + 1)
        if hop_count is not None and (hops != hop_count).any():
            raise ValueError(f"expected {hop_count} hops")
        values = rows["gt_ppg"].to_numpy(dtype=float)
        here = np.clip(hops - block * hops_per_block, 0, hops_per_block)
        owner = np.repeat(np.arange(len(first)), here)
        hop = block[owner] * hops_per_block + np.arange(len(owner)) - np.repeat(np.cumsum(here) - here, here)
        end = hop * step + size
        # windows are cut only at the end of a key, so they have few different lengths
        low = np.maximum(0, end - half)
        frames = np.minimum(n[owner], end + half) - low
        rates, code = np.full(len(owner), np.nan), np.zeros(len(owner), dtype=int)
        for m in np.unique(frames):
            of = np.flatnonzero(frames == m)
            for k in range(0, len(of), SPECTRA):
                some = of[k:k + SPECTRA]
                x = values[(low[some] - start[owner[some]] + first[owner[some]])[:, None] + np.arange(m)]
                wild = ~np.isfinite(x).all(axis=1)
                x = np.where(wild[:, None], 0.0, x)
                constant = x.std(axis=1) <= 0
                rate, _, bad = dominant_rate(x, fps, floor=0.0)
                code[some] = np.where(wild, 1, np.where(constant, 2, np.where(bad, 3, 0)))
                rates[some] = np.where(code[some] > 0, np.nan, rate)
        reasons = np.array([None, "non_finite_ground_truth", "constant_ground_truth", "degenerate_spectrum"], dtype=object)
        return pd.DataFrame({**{k: rows[k].to_numpy()[first[owner]] for k in keys}, "hop_idx": hop, "gt_hr_bpm": rates, "invalid_reason": reasons[code], "valid": code == 0})

    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    out = _by_block(blocked, keys, "frame_idx", run, f"{key_types}, hop_idx bigint, gt_hr_bpm double, invalid_reason string, valid boolean")
    return out.selectExpr(*keys, "hop_idx", f"(hop_idx * {step} + {size}) / {float(fps)}D AS hop_time_s", "nullif(gt_hr_bpm, double('NaN')) AS gt_hr_bpm", "valid", "invalid_reason")


# --- table operators on any keyed series ------------------------------------------------


def _per_window(df: DataFrame, keys, order, columns, size, step, hops_per_block, compute, schema) -> DataFrame:
    keys = list(keys)
    types = dict(df.dtypes)
    blocked = hop_blocks(df.select(*keys, order, *columns), order, size, step, hops_per_block)

    def run(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        owner, hop, at = _places(cuts, rows["block"].to_numpy()[cuts[:-1]], size, step, hops_per_block)
        values, done = rows[list(columns)].to_numpy(dtype=float), []
        for k in range(0, len(at), SPECTRA):
            some = slice(k, k + SPECTRA)
            out = pd.DataFrame({**{c: rows[c].to_numpy()[cuts[owner[some]]] for c in keys}, "hop_idx": hop[some]})
            for c, v in compute(values[at[some, None] + np.arange(size)]).items():
                out[c] = list(v) if v.ndim > 1 else v
            done.append(out)
        return pd.concat(done, ignore_index=True) if done else None

    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    return _by_block(blocked, keys, order, run, f"{key_types}, hop_idx bigint, {schema}")


def project_windows(df: DataFrame, keys: Sequence[str], order: str, rgb: Sequence[str], fps: float, size: int, step: int, hops_per_block: int = 256) -> DataFrame:
    """Pulse projection of every window as an array column ``pulse`` (null when degenerate)."""

    def compute(w):
        pulse, problem = pulse_projection(w, fps)
        return {"pulse": np.where(problem[:, None] > 0, np.nan, pulse)}

    return _per_window(df, keys, order, rgb, size, step, hops_per_block, compute, "pulse array<double>")


def bandpass(df: DataFrame, keys: Sequence[str], order: str, value: str, fs: float, band: tuple[float, float], n: int, size: int, step: int, hops_per_block: int = 256) -> DataFrame:
    """Order-``n`` band-pass of every window, mean removed and scaled to unit deviation."""

    def compute(w):
        y, bad = standardise(w[:, :, 0] @ filter_matrix(n, *band, fs, size))
        return {"filtered": np.where(bad[:, None], np.nan, y)}

    return _per_window(df, keys, order, [value], size, step, hops_per_block, compute, "filtered array<double>")


def dominant_frequency(df: DataFrame, keys: Sequence[str], order: str, value: str, fs: float, band: tuple[float, float], size: int, step: int,
                       filter_order: int = RATE_ORDER, min_fft: int = MIN_FFT, hops_per_block: int = 256) -> DataFrame:
    """Rate per minute and peak-power ratio of every window."""

    def compute(w):
        rate, ratio, bad = dominant_rate(w[:, :, 0], fs, band, order=filter_order, min_fft=min_fft)
        return {"rate": np.where(bad, np.nan, rate), "ratio": np.where(bad, np.nan, ratio)}

    return _per_window(df, keys, order, [value], size, step, hops_per_block, compute, "rate double, ratio double")
