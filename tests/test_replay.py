import itertools

import numpy as np
import pytest

from windfold.operators import replay as rp
from windfold.operators import search as se

A = 3


def scalar_step(s, z, c):
    """One filter step written out with matrices."""
    x, p = np.array(s[:2], float), np.array([[s[2], s[3]], [s[4], s[5]]], float)
    f = np.array([[1.0, 1.0], [0.0, 1.0]])
    x, p = f @ x, f @ p @ f.T + 0.1 * np.array([[1 / 3, 0.5], [0.5, 1.0]])
    if z is not None and c is not None and c > 0:
        h = np.array([1.0, 0.0])
        k = p @ h / (h @ p @ h + 200.0 / max(c, 1e-6))
        x, p = x + k * (z - h @ x), (np.eye(2) - np.outer(k, h)) @ p
    return (*x, *p.ravel())


START = (70.0, 0.0, 400.0, 0.0, 0.0, 25.0)


def rows(n, seed=0, clips=("a", "b"), lengths=None):
    g = np.random.default_rng(seed)
    out = []
    for j, c in enumerate(clips):
        for h in range(lengths[j] if lengths else n):
            hr = [None if g.random() < 0.2 else float(g.uniform(50, 110)) for _ in range(A)]
            conf = [None if v is None else float(g.uniform(0.01, 1)) for v in hr]
            out.append((c, h, hr, conf, conf, [1.0] * A, float(g.uniform(55, 100))))
    return out


SCHEMA = "clip_id string, hop_idx bigint, hr array<double>, confidence array<double>, ppr array<double>, coverage array<double>, gt_hr_bpm double"


def legal(prev, hold):
    return range(A) if prev is None or hold >= 2 else (prev,)


def brute_beam(hops, width):
    beam = [(0.0, (), START, None, 0)]
    for _, _, hr, conf, _, _, gt in hops:
        nxt = []
        for total, seq, s, prev, hold in beam:
            for a in legal(prev, hold):
                n = scalar_step(s, hr[a], conf[a])
                nxt.append((total + abs(n[0] - gt), seq + (a,), n, a, hold + 1 if a == prev else 1))
        beam = sorted(nxt, key=lambda t: (t[0], t[1]))[:width]
    return beam[0]


def test_fixed_arm_and_random_length_clips(spark):
    data = rows(0, 1, ("a", "b", "c"), (9, 4, 1))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {(r.clip_id, r.hop_idx): r.post_belief_hr_bpm for r in rp.replay(df, [rp.fixed_selector(1)]).collect()}
    for clip, group in itertools.groupby(data, key=lambda r: r[0]):
        s = START
        for r in group:
            s = scalar_step(s, r[2][1], r[3][1])
            assert got[(clip, r[1])] == pytest.approx(s[0], abs=1e-10)
    assert len(got) == 14


def test_greedy_and_beam_against_brute_force(spark):
    data = rows(8, 2)
    df = spark.createDataFrame(data, SCHEMA)
    for width in (1, 4, 8):
        got = {}
        for r in rp.beam(df, width).collect():
            got.setdefault(r.clip_id, {})[r.hop_idx] = r
        for clip, group in itertools.groupby(data, key=lambda r: r[0]):
            total, seq, *_ = brute_beam(list(group), width)
            path = [got[clip][h] for h in range(8)]
            assert tuple(p.executed_action for p in path) == seq
            assert sum(p.abs_error_bpm for p in path) == pytest.approx(total, abs=1e-9)
    greedy = {(r.clip_id, r.hop_idx): r.executed_action for r in rp.greedy(df).collect()}
    narrow = {(r.clip_id, r.hop_idx): r.executed_action for r in rp.beam(df, 1).collect()}
    assert greedy == narrow


def test_wide_beam_is_exhaustive(spark):
    data = rows(6, 3, ("a",))
    best = brute_beam(data, 10**9)
    total = sum(r.abs_error_bpm for r in rp.beam(spark.createDataFrame(data, SCHEMA), 729).collect())
    assert total == pytest.approx(best[0], abs=1e-9)


def test_hold_rule_and_ratio_ties(spark):
    hops = [("a", h, [60.0, 60.0, 60.0], [0.5] * A, p, [1.0] * A, 60.0) for h, p in enumerate(([0.5, 0.5, 0.1], [0.1, 0.9, 0.1], [0.9, 0.9, 0.1], [0.1, 0.9, 0.9], [0.1, 0.9, 0.9]))]
    out = sorted(rp.replay(spark.createDataFrame(hops, SCHEMA), [rp.max_ratio_selector()]).collect(), key=lambda r: r.hop_idx)
    assert [r.proposed_action for r in out] == [0, 1, 0, 1, 1]
    assert [r.executed_action for r in out] == [0, 0, 0, 1, 1]
    assert [r.legal for r in out] == [True, False, True, True, True]
    assert [r.post_hold_count for r in out] == [1, 2, 3, 1, 2]
    assert out[1].override_reason == "minimum_hold" and out[0].previous_action is None


def test_gaps_and_duplicates_fail(spark):
    data = rows(4, 4, ("a",))
    for bad in ([r for r in data if r[1] != 2], data + [data[1]]):
        with pytest.raises(Exception, match="contiguous|repeat|skip"):
            rp.replay(spark.createDataFrame(bad, SCHEMA), [rp.fixed_selector(0)]).collect()


def test_labels_do_not_change_a_replay(spark):
    df = spark.createDataFrame(rows(5, 5), SCHEMA)
    sel = [rp.max_ratio_selector(), rp.fixed_selector(2)]
    key = lambda d: sorted((r.method_id, r.clip_id, r.hop_idx, r.post_belief_hr_bpm) for r in rp.replay(d, sel).collect())
    from pyspark.sql import functions as F
    assert key(df) == key(df.withColumn("gt_hr_bpm", F.lit(0.0)))


def test_unpruned_repeated_corrections_cover_all_leaves(spark):
    data = rows(4, 6, ("a",))
    df = spark.createDataFrame(data, SCHEMA)
    policy = rp.fixed_selector(1)
    trace = rp.replay(df, [policy])
    starts = se.anchors(trace, df.groupBy("clip_id").count().withColumnRenamed("count", "hop_count"), 4)
    channels = len(data[0][2])
    out = se.repeated_corrections(starts, df, policy, channels, (1, 4, 32), 4)
    got = {tuple(r.seq): r.total for r in se.paths(out, 4).where("anchor = 0 AND width = 32").collect()}
    want = {(): (0.0, START, None, 0)}
    for _, _, hr, conf, _, _, gt in data:
        nxt = {}
        for seq, (total, s, prev, hold) in want.items():
            trial = {a: scalar_step(s, hr[a], conf[a]) for a in legal(prev, hold)}
            first = min(trial, key=lambda a: (abs(trial[a][0] - gt), a))
            for a in {first} | ({1} & set(trial)):
                nxt[seq + (a,)] = (total + abs(trial[a][0] - gt), trial[a], a, hold + 1 if a == prev else 1)
        want = nxt
    assert set(got) <= set(want) and min(v[0] for v in want.values()) == pytest.approx(min(got.values()), abs=1e-9)
    stats = out.collect()
    assert all(r.generated == r.deduped + r.retained + r.pruned and r.retained <= r.width for r in stats)
    # widths finished together are the same as each alone
    alone = se.repeated_corrections(starts, df, policy, channels, (4,), 4).collect()
    assert sorted(map(repr, alone)) == sorted(repr(r) for r in stats if r.width == 4) and {r.width for r in stats} == {1, 4, 32}


def test_recovery_classes(spark):
    from pyspark.sql import functions as F
    cases = {"better_throughout": [1.0, 1, 1], "never_better": [0.0, -1, 0], "briefly_better_then_ends_worse": [1.0, 0, -1], "only_ends_better_late": [0.0, -1, 2], "mixed_intermittent": [1.0, -1, 1]}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in cases.items()], "name string, gains array<double>")
    for r in df.select("name", se.recovery_class(F.col("gains")).alias("c")).collect():
        assert r.c == r.name


def test_scoring_refuses_gaps(spark):
    from windfold.operators import score as sc
    from windfold.operators.constraints import ConstraintError
    hops = spark.createDataFrame([("a", 0, 70.0), ("a", 1, 71.0)], "clip_id string, hop_idx long, post_belief_hr_bpm double")
    label = lambda *rows: spark.createDataFrame(rows, "clip_id string, hop_idx long, gt_hr_bpm double, valid boolean")
    keys = ["clip_id", "hop_idx"]
    whole = label(("a", 0, 72.0, True), ("a", 1, 71.0, True))
    assert sorted(r.abs_error_bpm for r in sc.score(hops, whole, keys).collect()) == [0.0, 2.0]
    for broken in (label(("a", 0, 72.0, True)), label(("a", 0, 72.0, True), ("a", 1, None, False)), whole.unionByName(label(("b", 0, 1.0, True)))):
        with pytest.raises(ConstraintError):
            sc.score(hops, broken, keys)
    some = label(("a", 0, 72.0, True), ("a", 1, None, False))
    assert sc.score(hops, some, keys, strict=False).count() == 1
    assert [tuple(r) for r in sc.label_coverage(hops, some, keys, ["clip_id"]).collect()] == [("a", 2, 1)]


def test_monitor_orders_all_frames_of_a_batch():
    import pandas as pd
    from windfold.streaming.live import IndexMonitor

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        def update(self, v): self.held = v

    m = IndexMonitor()
    m.state = Value()
    frames = [pd.DataFrame({"arrival": [5, 1, 3], "frame_idx": [5, 0, 2]}), pd.DataFrame({"arrival": [0, 4, 2], "frame_idx": [0, 1, 1]})]
    out = next(m.handleInputRows((7,), iter(frames), None))
    # in order of arrival: 0 0 1 2 1 5
    assert out.iloc[0].tolist() == [7, 6, 1, 1, 2, 5]
    out = next(m.handleInputRows((7,), iter([pd.DataFrame({"arrival": [7, 6], "frame_idx": [8, 6]})]), None))
    assert out.iloc[0].tolist() == [7, 8, 1, 1, 3, 8]


def test_hops_meet_labels_and_neighbours_before_methods_are_unpacked(spark):
    from windfold.operators import score as sc
    from windfold.plans import common, scores
    from windfold.sources import roles

    sf = "/root/testdata/sf0.001"
    lines = scores.clip_table(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, l in enumerate(lines) if "Generate" in l and "__at" in l)
    assert not any("Window" in l for l in lines[:at]) and any("Window" in l for l in lines[at:]) and any("Join" in l for l in lines[at:])
    rows = sc.score(common.replayed(spark, sf), roles.labels(spark, sf), ["clip_id", "hop_idx"], strict=False)
    plain = sc.clip_rows(rows, ["method_id", "clip_id"], scores.CH)
    known = roles.clips(spark, sf).select("clip_id")
    want = sorted((r.asDict() for r in plain.join(known, "clip_id").collect()), key=lambda r: (r["method_id"], r["clip_id"]))
    got = sorted((r.asDict() for r in scores.clip_table(spark, sf).select(*plain.columns).collect()), key=lambda r: (r["method_id"], r["clip_id"]))
    assert len(got) == len(want) and got
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9, nan_ok=True)
