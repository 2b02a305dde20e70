"""Boosted trees, subject folds, order statistics and numbering against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windfold.operators import boosting as bo
from windfold.operators import screen as sn
from windfold.operators import selection as se
from windfold.operators.windows import numbered
from windfold.plans import screens


# --- folds -----------------------------------------------------------------------------------


def greedy(sizes, folds):
    loads, out = [0] * folds, {}
    for key, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        k = loads.index(min(loads))
        out[key] = k
        loads[k] += n
    return out


@pytest.mark.parametrize("folds", [1, 3, 5])
def test_subject_folds(spark, folds):
    r = np.random.default_rng(folds)
    for sizes in ([], [("a", 0), ("b", 0), ("c", 4)], [(f"s{k:04d}", int(n)) for k, n in enumerate(r.integers(0, 9, 900))], [(f"s{k}", int(n)) for k, n in enumerate(r.integers(1, 10**9, 60))]):
        df = spark.createDataFrame(sizes, "subject_id string, n bigint").withColumn("more", F.lit(1))
        out = sn.subject_folds(df, folds).collect()
        assert {x.subject_id: x.fold for x in out} == greedy(sizes, folds) and len(out) == len(sizes)


def test_equal_items_are_dealt_in_closed_form():
    r = np.random.default_rng(0)
    for _ in range(200):
        loads, size, n = r.integers(0, 30, 4), int(r.integers(0, 8)), int(r.integers(1, 40))
        fold, items = sn.dealt(np.repeat(loads[None], n, 0), np.full(n, size), np.arange(n))
        now = loads.copy()
        for k in range(n):
            at = int(now.argmin())
            now[at] += size
            assert fold[k] == at and (fold[: k + 1, None] == np.arange(4)).sum(0).tolist() == items[k].tolist()


def test_no_stage_has_a_constant_key(spark):
    sizes = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("subject_id"), (F.col("id") % 7).alias("n"))
    plan = sn.subject_folds(sizes, 5)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_numbered(spark):
    rows = [(k * 7919 % 1000, "x") for k in range(1000)]
    out = numbered(spark.createDataFrame(rows, "v bigint, w string").repartition(7), [F.col("v").desc()], "no").collect()
    assert all(r.no == 999 - r.v for r in out) and len(out) == 1000
    assert numbered(spark.createDataFrame([], "v bigint"), [F.col("v")], "no").collect() == []


# --- order statistics --------------------------------------------------------------------------


def test_ranks_and_quantiles(spark):
    r = np.random.default_rng(3)
    values = np.concatenate((r.normal(size=400), -(10.0 ** r.uniform(-300, 300, 200)), np.full(300, 2.5), [0.0, -0.0, np.inf, -np.inf, 5e-324]))
    df = spark.createDataFrame([(float(v),) for v in r.permutation(values)] + [(None,)] * 9, "v double").repartition(6)
    order = np.sort(values)
    found = se.at_ranks(df, range(0, len(values), 37))
    assert all(order[k] == v for k, v in found.items()) and len(found) == len(range(0, len(values), 37))
    inside = order[np.isfinite(order)]
    got = se.quantiles(df.where("abs(v) < double('inf')"), (0.0, 0.13, 0.5, 0.9, 1.0), len(inside))
    assert np.allclose(got, np.quantile(inside, (0.0, 0.13, 0.5, 0.9, 1.0)), rtol=1e-12)
    assert se.quantiles(df.where("v IS NULL"), (0.5,), 0) == [None]
    with pytest.raises(ValueError):
        se.at_ranks(df, [len(values)])


# --- boosted trees -----------------------------------------------------------------------------


def plain_boosting(x, targets, s, edges):
    """One model after the other, one tree after the other, every split by trying all."""
    cut = np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)])
    out = np.zeros(targets.shape)
    for m in range(targets.shape[1]):
        use = ~np.isnan(targets[:, m])
        p = np.full(len(x), targets[use, m].mean() if use.any() else 0.0)
        for _ in range(s.rounds):
            g = np.rint((p - np.where(use, targets[:, m], 0)) * bo.UNIT) / bo.UNIT
            value, leaves, level_nodes = np.zeros(len(x)), 1, [(0, np.ones(len(x), bool))]
            for _ in range(s.depth):
                found = []
                for name, rows in level_nodes:
                    mine = rows & use
                    n, total = mine.sum(), g[mine].sum()
                    if n:
                        value[rows] = -s.rate * total / n
                    best = (0.0,)
                    if n >= 2 * s.least or name == 0:
                        for f in range(x.shape[1]):
                            for b in range(len(edges[f])):
                                left = mine & (cut[:, f] <= b)
                                a = left.sum()
                                if a >= s.least and n - a >= s.least:
                                    gain = g[left].sum() ** 2 / a + (total - g[left].sum()) ** 2 / (n - a) - total**2 / n
                                    if gain > best[0] + 1e-9:
                                        best = (gain, f, b)
                    if len(best) > 1:
                        found.append((-best[0], name, rows, *best[1:]))
                level_nodes = []
                for _, name, rows, f, b in sorted(found, key=lambda y: y[:2]):
                    if leaves < s.leaves:
                        leaves += 1
                        for child, side in ((2 * name + 1, rows & (cut[:, f] <= b)), (2 * name + 2, rows & (cut[:, f] > b))):
                            value[side] = -s.rate * g[side & use].sum() / (side & use).sum()
                            level_nodes.append((child, side))
            p = p + value
        out[:, m] = p
    return out


def boosting_rows(n=400):
    r = np.random.default_rng(6)
    x = np.column_stack((r.normal(size=n), r.integers(0, 3, n), r.random(n).round(2), np.ones(n)))
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 2] + 0.1 * r.normal(size=n)
    fold = r.integers(0, 3, n)
    targets = np.column_stack([np.where(fold != k, y, np.nan) for k in range(3)] + [np.where(fold != k, r.permutation(y), np.nan) for k in range(3)] + [np.full(n, np.nan)])
    return x, y, fold, targets


def test_boosting(spark):
    x, y, fold, targets = boosting_rows()
    s = bo.Boosting(rounds=7, rate=0.3, leaves=6, depth=3, bins=16, least=15, keep=3)
    df = spark.createDataFrame([(k, a.tolist(), t.tolist(), "clash") for k, (a, t) in enumerate(zip(x, targets))], "id bigint, features array<double>, targets array<double>, __x string").repartition(6)
    edges = bo.bin_edges(df, "features", 4, s.bins)
    got = np.zeros(targets.shape)
    for r in bo.boosted(df, ["id"], "features", "targets", 4, targets.shape[1], s).collect():
        got[r.id] = r.predictions
    want = plain_boosting(x, targets, s, edges)
    assert np.allclose(got, want, atol=1e-6)
    # held-out rows: the true targets are learnt, the shuffled ones are not; a model without rows predicts 0
    own = np.arange(len(x))
    real, shuffled = got[own, fold], got[own, 3 + fold]
    assert ((real - y) ** 2).mean() < 0.3 * y.var() < ((shuffled - y) ** 2).mean() and not got[:, 6].any()
    # regret of each fold, of four candidates at a time the one predicted least
    for k in range(3):
        at = np.flatnonzero(fold == k)[: len(np.flatnonzero(fold == k)) // 4 * 4].reshape(-1, 4)
        regret = lambda p: (y[at][np.arange(len(at)), p[at].argmin(1)] - y[at].min(1)).mean()
        assert abs(regret(got[:, k]) - regret(want[:, k])) < 1e-9 and regret(got[:, k]) < regret(got[:, 3 + k])


def test_levels_read_blocks_and_plan_no_query(spark):
    x, _, _, targets = boosting_rows(200)
    df = spark.createDataFrame([(k, a.tolist(), t.tolist()) for k, (a, t) in enumerate(zip(x, targets))], "id bigint, features array<double>, targets array<double>")
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    planned = []
    for rounds in (1, 4):
        sc.listenerBus().waitUntilEmpty(30_000)
        before = store.executionsCount()
        bo.boosted(df, ["id"], "features", "targets", 4, targets.shape[1], bo.Boosting(rounds=rounds, depth=2)).collect()
        sc.listenerBus().waitUntilEmpty(30_000)
        planned.append(store.executionsCount() - before)
    assert 0 < planned[0] == planned[1]


def test_boosting_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "id bigint, features array<double>, targets array<double>")
    assert bo.boosted(empty, ["id"], "features", "targets", 2, 2, bo.Boosting(rounds=2, keep=1)).collect() == []
    rows = [(k, [None if k % 3 else 1.0, float(k)], [float(k % 3 > 0) if k else None]) for k in range(90)]
    out = bo.boosted(spark.createDataFrame(rows, empty.schema), ["id"], "features", "targets", 2, 1, bo.Boosting(rounds=40, rate=0.5, least=5)).collect()
    assert all(abs(r.predictions[0] - (r.id % 3 > 0)) < 0.01 for r in out)


def test_probe_protocol(spark):
    hops = screens.probe_hops(spark, "/root/testdata/sf0.001").collect()
    for r in hops:
        assert sorted(r.other) == [k for k in range(screens.FOLDS) if k != r.fold]
    for k in range(screens.FOLDS):
        # each fold's shuffle is a permutation of its own training rows
        train = [r for r in hops if r.fold != k]
        assert sorted(tuple(r.if_error) for r in train) == sorted(tuple(r.other[k]) for r in train)
    few = screens.probe_choices(spark, "/root/testdata/sf0.001", settings=bo.Boosting(rounds=2)).collect()
    assert len(few) == 2 * len(hops) and all(r.regret >= 0 for r in few)
