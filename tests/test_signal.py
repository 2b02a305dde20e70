import numpy as np
import pytest
from pyspark.sql import functions as F

from windfold.operators import signal as sg


def test_projection_known_answer():
    rgb = np.array([[[1, 2, 3], [2, 4, 6], [3, 2, 1], [4, 5, 2]]], dtype=float)
    pulse, problem = sg.pulse_projection(rgb, 2.0)
    assert problem[0] == 0
    assert np.allclose(pulse[0], [0.01978209784325878, 0.03956419568651763, -0.43772536911724674, 0.37837907558747036], rtol=0, atol=1e-14)


def test_bandpass_matches_its_definition():
    b, a = sg.bandpass_coefficients(1, 0.75, 3.0, 30.0)
    x = np.random.default_rng(1).normal(size=50)
    y = np.zeros(50)
    for i in range(50):
        y[i] = sum(b[j] * x[i - j] for j in range(3) if i >= j) - sum(a[j] * y[i - j] for j in range(1, 3) if i >= j)
    assert np.allclose(x @ sg.filter_matrix(1, 0.75, 3.0, 30.0, 50), y, atol=1e-12)
    # Unit gain at the centre, -3 dB at both edges, none at 0 and half the rate.
    w = lambda f, n: (lambda z: abs(np.polyval(sg.bandpass_coefficients(n, 0.5, 3.0, 30.0)[0], z) / np.polyval(sg.bandpass_coefficients(n, 0.5, 3.0, 30.0)[1], z)))(np.exp(2j * np.pi * f / 30.0))
    for n in (1, 3):
        assert w(0.5, n) == pytest.approx(2**-0.5, abs=1e-9)
        assert w(3.0, n) == pytest.approx(2**-0.5, abs=1e-9)
        assert w(0.0, n) < 1e-9 and w(15.0, n) < 1e-9


@pytest.mark.parametrize("fps,tolerance", [(24.0, 0.3515625), (30.0, 0.439453125)])
def test_tone_known_answer(fps, tolerance):
    n = round(8 * fps)
    phase = 2 * np.pi * 1.2 * np.arange(n) / fps
    rgb = np.stack([100 + 2 * np.sin(phase), 100 + 3 * np.sin(phase + 0.4), 100 + 4 * np.sin(phase + 0.8)], axis=1)[None]
    rate, ratio, code = sg.window_rates(rgb, fps)
    assert code[0] == 0 and abs(rate[0] - 72.0703125) <= tolerance and 0 < ratio[0] <= 1


def frames(spark, n, fps, clips=("a", "b")):
    rows = []
    for c in clips:
        for i in range(n):
            p = 2 * np.pi * 1.2 * i / fps
            rows.append((c, i, [(float(100 + 2 * np.sin(p + k / 10)), float(100 + 3 * np.sin(p + 0.4 + k / 10)), float(100 + 4 * np.sin(p + 0.8 + k / 10)), 1.0) for k in range(3)]))
    return spark.createDataFrame(rows, "clip_id string, frame_idx bigint, rois array<struct<r: double, g: double, b: double, coverage: double>>")


def test_blocks_do_not_change_measurements(spark):
    f = frames(spark, round(13.5 * 24), 24.0)
    key = lambda df: sorted((r.clip_id, r.hop_idx, r.roi_index, r.hr_bpm, r.ppr) for r in df.collect())
    whole = key(sg.hop_measurements(f, 24.0, hops_per_block=100))
    assert len(whole) == 2 * 6 * 3
    split = key(sg.hop_measurements(f.repartition(5), 24.0, hops_per_block=2))
    assert [r[:4] for r in split] == [r[:4] for r in whole]
    assert [r[4] for r in split] == pytest.approx([r[4] for r in whole], abs=1e-12)


def test_prefix_invariance_and_missing(spark):
    f = frames(spark, round(10 * 24), 24.0, ("a",))
    short = f.where("frame_idx < 216")
    a = {(r.hop_idx, r.roi_index): r.hr_bpm for r in sg.hop_measurements(f, 24.0).collect()}
    b = {(r.hop_idx, r.roi_index): r.hr_bpm for r in sg.hop_measurements(short, 24.0).collect()}
    assert b and all(a[k] == v for k, v in b.items())
    broken = f.withColumn("rois", F.expr("transform(rois, (x, i) -> if(frame_idx = 200 AND i = 1, named_struct('r', cast(NULL AS double), 'g', x.g, 'b', x.b, 'coverage', 0D), x))"))
    got = {(r.hop_idx, r.roi_index): (r.valid, r.invalid_reason) for r in sg.hop_measurements(broken, 24.0).collect()}
    assert got[(0, 1)] == (True, None) and got[(1, 1)] == (False, "missing_required_rgb") and got[(1, 0)][0]


def test_labels_follow_the_tone_in_any_blocking(spark):
    fps, n = 24.0, round(14 * 24)
    rows = [("a", i, n, float(np.sin(2 * np.pi * 1.2 * i / fps))) for i in range(n)]
    t = spark.createDataFrame(rows, "clip_id string, frame_idx bigint, n_frames bigint, gt_ppg double")
    one = sorted((r.hop_idx, r.hop_time_s, r.gt_hr_bpm) for r in sg.hop_labels(t, fps).collect())
    two = sorted((r.hop_idx, r.hop_time_s, r.gt_hr_bpm) for r in sg.hop_labels(t, fps, hops_per_block=2).collect())
    assert one == two and len(one) == 7 and one[0][1] == 8.0
    assert all(abs(r[2] - 72.07) < 2 for r in one)


def test_short_keys_share_a_call(spark):
    fps, n = 7.0, 66
    t = spark.range(300).selectExpr("id AS clip_id", f"explode(sequence(0L, {n - 1}L)) AS frame_idx", f"{n}L AS n_frames").withColumn("gt_ppg", F.expr("if(clip_id % 50 = 7, 1D, if(clip_id % 50 = 9 AND frame_idx = 30, NULL, pmod(hash(clip_id, frame_idx), 100) * 1D))"))
    got = {(r.clip_id, r.hop_idx): (r.gt_hr_bpm, r.valid, r.invalid_reason) for r in sg.hop_labels(t, fps).collect()}
    values = {}
    for r in sorted(t.collect(), key=lambda r: r.frame_idx):
        values.setdefault(r.clip_id, []).append(np.nan if r.gt_ppg is None else r.gt_ppg)
    want = {}
    for k, v in values.items():
        for h in range((n - 56) // 7 + 1):
            x = np.array(v[h * 7 + 28:min(n, h * 7 + 84)])
            if not np.isfinite(x).all():
                want[k, h] = (None, False, "non_finite_ground_truth")
            elif x.std() <= 0:
                want[k, h] = (None, False, "constant_ground_truth")
            else:
                want[k, h] = (sg.dominant_rate(x[None, :], fps, floor=0.0)[0][0], True, None)
    assert got == want and len(want) == 600
    rows = sg.dominant_frequency(t, ["clip_id"], "frame_idx", "gt_ppg", 2.0, (0.1, 0.8), 16, 2, hops_per_block=7)
    assert rows.count() == 300 * 26 and rows.select("clip_id", "hop_idx").distinct().count() == 300 * 26
    # there was a call for each block
    assert "FlatMapGroupsInPandas" not in sg.hop_labels(t, fps)._jdf.queryExecution().toString()
