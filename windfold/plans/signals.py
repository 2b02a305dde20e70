"""Windowed signal queries (R1, R2, W10, G1-G6) over the event role.

Samples of a user, in time order, stand for frames at a nominal rate; the bands
of the small-rate queries are scaled to stay below half that rate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from windfold.functions.columns import r6
from windfold.operators import signal as sg
from windfold.operators.windows import centred_windows, hop_windows
from windfold.plans.registry import query, view
from windfold.sources import roles

FPS, SIZE, STEP, HALF = 2.0, 16, 2, 8
BAND = (0.1, 0.8)
SUB = 4
NFFT = sg.MIN_FFT


@roles.reuse_plan
def frames(spark, sf):
    """Frames with three positive channels."""
    return roles.frames(spark, sf).selectExpr("clip_id", "frame_idx", "value + 1D AS r", "k + 1D AS g", "roi_index * 10 + 5D AS b", "value", "k", "roi_index")


def counted(df):
    n = df.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return df.join(n, "clip_id")


view("v_fr", "SELECT clip_id, frame_idx, value + 1.0::DOUBLE AS r, k + 1.0::DOUBLE AS g, roi_index * 10 + 5.0::DOUBLE AS b, value, cents FROM v_frames")
view("v_fhops", f"SELECT clip_id, unnest(range(greatest(0, (count(*) - {SIZE}) // {STEP} + 1))) AS hop_idx, count(*) AS n_frames FROM v_fr GROUP BY clip_id")


@query("r01_wide_to_long", """SELECT clip_id, roi_index, count(*) AS hops, count(*) FILTER (valid) AS valid_hops, round(avg(coverage), 6) AS coverage FROM v_meas GROUP BY 1, 2""")
def wide_to_long(spark, sf):
    return roles.measurements(spark, sf).groupBy("clip_id", "roi_index").agg(
        F.count(F.lit(1)).alias("hops"), F.sum(F.col("valid").cast("bigint")).alias("valid_hops"), r6(F.avg("coverage")).alias("coverage"))


@query("r02_hop_windows", f"""SELECT h.clip_id, h.hop_idx, count(*) AS frames, min(f.frame_idx) AS first_frame, max(f.frame_idx) AS last_frame, round(avg(f.value), 6) AS mean_value
  FROM v_fhops h JOIN v_fr f ON f.clip_id = h.clip_id AND f.frame_idx BETWEEN h.hop_idx * {STEP} AND h.hop_idx * {STEP} + {SIZE - 1} GROUP BY 1, 2""")
def windows(spark, sf):
    w = hop_windows(counted(frames(spark, sf)), "frame_idx", F.col("n_frames"), SIZE, STEP)
    return w.groupBy("clip_id", "hop_idx").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), r6(F.avg("value")).alias("mean_value"))


@query("w10_centred_windows", f"""SELECT h.clip_id, h.hop_idx, count(*) AS frames, min(f.frame_idx) AS first_frame, max(f.frame_idx) AS last_frame, round(avg(f.value), 6) AS mean_value
  FROM v_fhops h JOIN v_fr f ON f.clip_id = h.clip_id AND f.frame_idx BETWEEN h.hop_idx * {STEP} + {SIZE - HALF} AND h.hop_idx * {STEP} + {SIZE + HALF - 1} GROUP BY 1, 2""")
def centred(spark, sf):
    w = centred_windows(counted(frames(spark, sf)), "frame_idx", F.col("n_frames"), SIZE, STEP, HALF)
    return w.groupBy("clip_id", "hop_idx").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), r6(F.avg("value")).alias("mean_value"))


view("v_subwin", f"""SELECT w.clip_id, w.start, avg(f.r) AS mr, avg(f.g) AS mg, avg(f.b) AS mb FROM (SELECT clip_id, unnest(range(greatest(0, count(*) - {SUB} + 1))) AS start FROM v_fr GROUP BY 1) w
  JOIN v_fr f ON f.clip_id = w.clip_id AND f.frame_idx BETWEEN w.start AND w.start + {SUB - 1} GROUP BY 1, 2""")
view("v_subproj", f"""SELECT s.clip_id, s.start, f.frame_idx, f.g / mg - f.b / mb AS s0, -2 * (f.r / mr) + f.g / mg + f.b / mb AS s1 FROM v_subwin s JOIN v_fr f ON f.clip_id = s.clip_id AND f.frame_idx BETWEEN s.start AND s.start + {SUB - 1}""")
view("v_submix", """SELECT *, s0 + d0 / d1 * s1 AS mix FROM (SELECT *, stddev_pop(s0) OVER w AS d0, stddev_pop(s1) OVER w AS d1 FROM v_subproj WINDOW w AS (PARTITION BY clip_id, start))""")
view("v_sublocal", "SELECT *, mix - avg(mix) OVER (PARTITION BY clip_id, start) AS local FROM v_submix")


@query("g01_pulse_projection", f"""SELECT h.clip_id, h.hop_idx, l.frame_idx - h.hop_idx * {STEP} AS pos, round(sum(l.local), 6) + 0 AS pulse FROM v_fhops h
  JOIN v_sublocal l ON l.clip_id = h.clip_id AND l.start >= h.hop_idx * {STEP} AND l.start + {SUB} <= h.hop_idx * {STEP} + {SIZE} GROUP BY 1, 2, 3""")
def pulse(spark, sf):
    p = sg.project_windows(frames(spark, sf), ["clip_id"], "frame_idx", ["r", "g", "b"], FPS, SIZE, STEP)
    return p.select("clip_id", "hop_idx", F.posexplode("pulse").alias("pos", "v")).select("clip_id", "hop_idx", F.col("pos").cast("bigint").alias("pos"), (r6("v") + 0).alias("pulse"))


def impulse(order):
    """Filter response over one window, as SQL list text."""
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in sg.filter_matrix(order, *BAND, FPS, SIZE)[0].tolist()) + "]"


def filtered_sql(order: int, centred: bool) -> str:
    x = "value - avg(value) OVER (PARTITION BY clip_id, hop_idx)" if centred else "value"
    return f"""SELECT a.clip_id, a.hop_idx, a.pos, sum({impulse(order)}[CAST(a.pos - b.pos + 1 AS BIGINT)] * b.x) AS y FROM v_win a JOIN (SELECT *, {x} AS x FROM v_win) b ON b.clip_id = a.clip_id AND b.hop_idx = a.hop_idx AND b.pos <= a.pos GROUP BY 1, 2, 3"""


view("v_win", f"SELECT h.clip_id, h.hop_idx, f.frame_idx - h.hop_idx * {STEP} AS pos, f.value FROM v_fhops h JOIN v_fr f ON f.clip_id = h.clip_id AND f.frame_idx BETWEEN h.hop_idx * {STEP} AND h.hop_idx * {STEP} + {SIZE - 1}")
view("v_filtered1", filtered_sql(1, False))
view("v_filtered3", filtered_sql(3, True))


@query("g02_bandpass_standardise", """SELECT clip_id, hop_idx, pos, round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) + 0 AS filtered FROM v_filtered1 WINDOW w AS (PARTITION BY clip_id, hop_idx)""")
def band(spark, sf):
    b = sg.bandpass(frames(spark, sf), ["clip_id"], "frame_idx", "value", FPS, BAND, 1, SIZE, STEP)
    return b.select("clip_id", "hop_idx", F.posexplode("filtered").alias("pos", "v")).select("clip_id", "hop_idx", F.col("pos").cast("bigint").alias("pos"), (r6("v") + 0).alias("filtered"))


def density_sql(nfft: int) -> str:
    return f"""SELECT x.clip_id, x.hop_idx, b.j, b.j * {FPS} / {nfft} AS freq, pow(sum(v * cos(2 * pi() * b.j * pos / {nfft})), 2) + pow(sum(v * sin(2 * pi() * b.j * pos / {nfft})), 2) AS power
  FROM (SELECT *, (y - avg(y) OVER (PARTITION BY clip_id, hop_idx)) * (0.5 - 0.5 * cos(2 * pi() * pos / {SIZE})) AS v FROM v_filtered3) x
  CROSS JOIN (SELECT range AS j FROM range({nfft // 2 + 1}) WHERE range * {FPS} / {nfft} BETWEEN {BAND[0]} AND {BAND[1]}) b GROUP BY 1, 2, 3"""


view("v_padded", density_sql(NFFT))
view("v_natural", density_sql(SIZE))


@query("g03_dominant_frequency", """SELECT p.clip_id, p.hop_idx, round(p.rate, 6) AS rate, round(n.ratio, 6) AS ratio FROM (SELECT clip_id, hop_idx, arg_max(freq, power) * 60 AS rate FROM v_padded GROUP BY 1, 2) p
  JOIN (SELECT clip_id, hop_idx, max(power) / sum(power) AS ratio FROM v_natural GROUP BY 1, 2) n ON n.clip_id = p.clip_id AND n.hop_idx = p.hop_idx""")
def dominant(spark, sf):
    d = sg.dominant_frequency(frames(spark, sf), ["clip_id"], "frame_idx", "value", FPS, BAND, SIZE, STEP)
    return d.select("clip_id", "hop_idx", r6("rate").alias("rate"), r6("ratio").alias("ratio"))


def roi_frames(spark, sf):
    """Frames with three regions, each a rotation of the channels; a sample without points is missing."""
    f = frames(spark, sf)
    region = lambda r, g, b: f"named_struct('r', if(k > 0, {r}, NULL), 'g', if(k > 0, {g}, NULL), 'b', if(k > 0, {b}, NULL), 'coverage', k / 100D)"
    return f.selectExpr("clip_id", "frame_idx", f"array({region('r', 'g', 'b')}, {region('g', 'b', 'r')}, {region('b', 'r', 'g')}) AS rois")


RATE = 7.0


@query("g04_hop_measurements")
def measurements(spark, sf):
    return sg.hop_measurements(roi_frames(spark, sf), RATE).select("clip_id", "hop_idx", "roi_index", *[r6(c).alias(c) for c in ("hr_bpm", "confidence", "ppr", "coverage")], "valid", "invalid_reason")


@query("g05_hop_labels")
def label_rates(spark, sf):
    truth = counted(frames(spark, sf)).select("clip_id", "frame_idx", "n_frames", F.col("value").alias("gt_ppg"))
    return sg.hop_labels(truth, RATE).select("clip_id", "hop_idx", r6("hop_time_s").alias("hop_time_s"), r6("gt_hr_bpm").alias("gt_hr_bpm"), "valid", "invalid_reason")


@query("g06_second_label_rule")
def second_labels(spark, sf):
    """The label rule with another parameter row: rate and expected hops per clip."""
    truth = counted(frames(spark, sf)).select("clip_id", "frame_idx", "n_frames", F.col("k").cast("double").alias("gt_ppg"))
    rules = spark.createDataFrame([("rate-7", 7.0), ("rate-8", 8.0)], "rule_id string, fps double")
    out = None
    for r in ((rid, fps) for rid, fps in [("rate-7", 7.0), ("rate-8", 8.0)]):
        part = sg.hop_labels(truth, r[1]).select(F.lit(r[0]).alias("rule_id"), "clip_id", "hop_idx", r6("gt_hr_bpm").alias("gt_hr_bpm"), "valid", "invalid_reason")
        out = part if out is None else out.unionByName(part)
    return out.join(rules, "rule_id")
