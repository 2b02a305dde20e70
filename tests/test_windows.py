import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from windfold.operators import constraints as co
from windfold.operators import resample as rs
from windfold.operators import windows as w


def test_hop_and_centred_windows_against_loops(spark):
    n, size, step, half = 23, 8, 3, 4
    df = spark.createDataFrame([(i, n) for i in range(n)], "i bigint, n bigint")
    hops = max(0, (n - size) // step + 1)
    got = {(r.i, r.hop_idx) for r in w.hop_windows(df, "i", F.col("n"), size, step).collect()}
    assert got == {(i, h) for h in range(hops) for i in range(h * step, h * step + size)}
    got = {(r.i, r.hop_idx) for r in w.centred_windows(df, "i", F.col("n"), size, step, half).collect()}
    assert got == {(i, h) for h in range(hops) for i in range(max(0, h * step + size - half), min(n, h * step + size + half))}


def test_index_rows_and_neighbour_on_a_hot_key(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("hot", i, t0 + dt.timedelta(minutes=7 * ((i * 37) % 500))) for i in range(500)] + [("c", 0, t0)]
    df = spark.createDataFrame(rows, "k string, id bigint, ts timestamp_ntz")
    ix = w.index_rows(df, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), "pos")
    got = {(r.k, r.id): r.pos for r in ix.collect()}
    want = {("hot", r[1]): p for p, r in enumerate(sorted(rows[:500], key=lambda r: (r[2], r[1])))}
    assert got == {**want, ("c", 0): 0}
    near = w.neighbour(ix, ["k"], "pos", ["id"], block=16).collect()
    back = {v: k for k, v in got.items()}
    by = {(k, p): i for (k, i), p in got.items()}
    assert len(near) == 501 and all(r.prev_id == by.get((r.k, r.pos - 1)) for r in near)


def test_neighbour_needs_an_adjacent_index(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 2, 2), ("a", 3, 3)], "k string, i bigint, v int")
    got = {r.i: r.prev_v for r in w.neighbour(df, ["k"], "i", ["v"], block=2).collect()}
    assert got == {0: None, 2: None, 3: 2}


def test_constraints(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 0), ("b", 0)], "k string, i bigint")
    assert [(r.k, r.i) for r in co.contiguous(df, ["k"], "i").collect()] == [("a", 3)]
    assert {r.k for r in co.lattice(df, ["k"], "i").collect()} == {"a", "b"}
    with pytest.raises(co.ConstraintError):
        co.require_none(co.lattice(df, ["k"], "i"), "lattice")
    with pytest.raises(co.ConstraintError):
        co.check_observation_names(["obs_000", "gt_hr_bpm"])
    co.check_observation_names([f"obs_{i:03d}" for i in range(101)])


def test_bootstrap_carries_clips_and_is_paired(spark):
    clips = spark.createDataFrame([("m", "s1", 1.0), ("m", "s1", 3.0), ("m", "s2", 10.0), ("n", "s1", 1.0), ("n", "s1", 3.0), ("n", "s2", 10.0)], "method_id string, subject_id string, mae double")
    sums = rs.subject_sums(clips, "mae")
    b = rs.bootstrap(sums, 50, 7).collect()
    values = {round(r.estimate, 9) for r in b}
    assert values <= {2.0, 10.0, round(14 / 3, 9)}
    by = {}
    for r in b:
        by.setdefault(r.replicate, set()).add(r.estimate)
    assert len(by) == 50 and all(len(v) == 1 for v in by.values())
    again = rs.bootstrap(sums, 50, 7).collect()
    assert sorted(map(tuple, b)) == sorted(map(tuple, again))
    point = rs.bootstrap(sums, 20, 8101, draws=rs.numpy_draws(spark, 2, 20, 8101)).where("method_id = 'm'").collect()
    import numpy as np
    d = np.random.default_rng(8101).integers(0, 2, size=(20, 2))
    t, c = np.array([4.0, 10.0]), np.array([2, 1])
    want = t[d].sum(1) / c[d].sum(1)
    assert [r.estimate for r in sorted(point, key=lambda r: r.replicate)] == pytest.approx(list(want))


def test_sliding_windows_from_panes(spark, tmp_path):
    from windfold.streaming import live
    from windfold.streaming.run import latest, run_available

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 3, t0 + dt.timedelta(minutes=17 * k + k % 5), k % 7 / 4) for k in range(400)]
    spark.createDataFrame(rows, "clip_id bigint, ts timestamp, coverage double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("clip_id bigint, ts timestamp, coverage double").parquet(f"{tmp_path}/in")
    key = lambda df: sorted((r.clip_id, r.start, r.samples, round(r.coverage, 9)) for r in df.collect())
    whole = latest(run_available(live.sliding_hops(stream, "8 hours", "1 hour", "1 hour"), "update"), ["clip_id", "start", "end"])
    emitted = run_available(live.pane_sums(stream, "1 hour", "1 hour"), "update")
    panes = latest(emitted.repartition("clip_id"), ["clip_id", "start", "end"])
    windows = live.windows_of_panes(panes, 8, "1 hour")
    assert key(windows) == key(whole) and len(key(whole)) > 100
    # one state row in each hour of a clip, not one in each window
    assert emitted.count() < whole.count()
    assert windows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_window_errors_against_loops(spark, tmp_path):
    """Hops and labels with repeated, missing and late rows, nulls, and labels across a window's edge."""
    import math
    import random

    from windfold.streaming import live
    from windfold.streaming.run import run_deliveries

    rng, t0, day, reach = random.Random(5), dt.datetime(2024, 1, 1), dt.timedelta(days=1), dt.timedelta(minutes=10)
    hops, labels = [], []
    for i in range(600):
        # half of the hops lie within ten minutes of midnight
        at = t0 + (dt.timedelta(seconds=rng.randrange(9 * 86400)) if i % 2 else (1 + i // 2 % 8) * day + dt.timedelta(seconds=rng.randrange(-600, 600)))
        clip, hop = None if i % 31 == 0 else i % 5, None if i % 37 == 0 else 2 ** 53 + i
        value = float("nan") if i % 97 == 0 else None if i % 11 == 0 else i / 8
        hops += [(None if i % 7 == 0 else f"m{i % 3}", clip, hop, value, at, (at - t0).days // 3)] * (1 + (i % 13 == 0))
        for j in range(i % 3):
            label_at = at + dt.timedelta(seconds=rng.choice([0, -600, 600, 601, -601, 300, -300]))
            labels.append((clip, hop, None if i % 17 == 0 else 50.0 + j, label_at, (at - t0).days // 3 + (i % 4 == 0)))
    end = t0 + 100 * day
    hops.append(("beat", -1, -1, 0.0, end, 9))
    labels.append((-1, -2, 0.0, end, 9))
    p = spark.createDataFrame(hops, "method_id string, clip_id bigint, hop_idx bigint, predicted double, ts timestamp, delivery int")
    l = spark.createDataFrame(labels, "clip_id bigint, hop_idx bigint, gt_hr_bpm double, label_ts timestamp, delivery int")
    out = run_deliveries(spark, {"hops": p, "labels": l}, lambda s: live.live_window_errors(s["hops"], s["labels"], "1 day", "12 hours"), "append", folder=str(tmp_path))
    shown = lambda v: v if v is None or math.isnan(v) else round(v, 9)
    got = sorted((str(r.method_id), r.clip_id, r.start, str(shown(r.mae_bpm)), r.hop_count) for r in out.collect())

    top, mark, known_hops, known_labels, late_labels = [dt.datetime.min] * 2, dt.datetime.min, [], [], 0
    for d in (0, 1, 2, 3, 9):
        now = [[r for r in rows if r[-1] == d] for rows in (hops, labels)]
        known_hops += [r for r in now[0] if r[-2] > mark]
        known_labels += [r for r in now[1] if r[-2] > mark]
        late_labels += sum(r[-2] <= mark for r in now[1])
        top = [max([t, *[r[-2] for r in rows]]) for t, rows in zip(top, now)]
        mark = max(mark, min(top) - dt.timedelta(hours=12)) if min(top) > t0 else mark
    errors = {}
    for m, clip, hop, value, at, _ in known_hops:
        for clip2, hop2, truth, label_at, _ in known_labels:
            if clip is not None and hop is not None and (clip, hop) == (clip2, hop2) and abs(label_at - at) <= reach:
                errors.setdefault((str(m), clip, at.replace(hour=0, minute=0, second=0, microsecond=0)), []).append(None if value is None or truth is None else abs(value - truth))
    want = []
    for k, all_errors in errors.items():
        some = [e for e in all_errors if e is not None]
        want.append((*k, str(shown(sum(some) / len(some) if some else None)), len(all_errors)))
    assert late_labels > 20 and any(w[3] == "nan" for w in want) and any(w[3] == "None" for w in want) and any(w[0] == "None" for w in want)
    assert got == sorted(want)


def test_window_errors_keep_packed_rows(spark, tmp_path):
    from windfold.streaming import live
    from windfold.streaming.run import ROCKSDB, STORE

    n, t0 = 4000, dt.datetime(2024, 1, 1)
    rows = [("m", i % 50, i, 1.0, t0 + dt.timedelta(seconds=30 * i), 2.0) for i in range(n)]
    schema = "method_id string, clip_id bigint, hop_idx bigint, predicted double, ts timestamp, gt_hr_bpm double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    spark.conf.set(STORE, ROCKSDB)
    try:
        out = live.live_window_errors(read().drop("gt_hr_bpm"), read().selectExpr("clip_id", "hop_idx", "gt_hr_bpm", "ts AS label_ts"), "1 day", "10 days")
        q = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = max(sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in q.recentProgress)
    finally:
        spark.conf.unset(STORE)
    # 64 groups of clips and two windows, with their timers; not an entry for each hop and label
    assert 0 < kept <= 64 * 2 * 4 < n
