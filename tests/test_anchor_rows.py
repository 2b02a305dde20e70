"""Anchors are one row each: no exchange has a row for each of their branches' offsets, paths' steps or hops ahead."""

import itertools
import os
import shutil

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from windfold.operators import search as se
from windfold.operators import windows as w
from tools.check import TABLES, table

SF = "/root/testdata/sf0.001"


def shuffled_rows(spark, df):
    """Result rows, and rows written to exchanges while they were made."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    n = len(df().collect())
    return n, sum(v for k, v in stages().items() if k not in before)


# rows of exchanges for each anchor; a branch has 15 offsets for each of 5 actions
@pytest.mark.parametrize("name", ["a15_anchor_regret", "t04_best_single_tuple", "w07_running_error", "t05_path_order"])
def test_exchanges_have_a_few_rows_an_anchor(spark, name):
    anchors = sum(r.anchors for r in entry.queries()["k13_eligible_anchors"](spark, SF).collect())
    rows, moved = shuffled_rows(spark, lambda: entry.queries()[name](spark, SF))
    assert rows and moved < 25 * anchors


def test_ahead_lists_rows_of_all_tables_over_block_edges(spark):
    a = spark.createDataFrame([("x", i, i * 10) for i in range(11)] + [("y", 3, 7)], "k string, i bigint, v int")
    b = spark.createDataFrame([("x", i) for i in (2, 3, 7)], "k string, i bigint")
    got = w.ahead({"a": a, "b": b}, ["k"], "i", {"vs": ("collect_list(a)", 2), "far": ("max(i)", 4)}, block=4).collect()
    assert len(got) == 15
    for r in got:
        assert [x.v for x in r.vs] == ([7] if r.k == "y" else [i * 10 for i in range(r.i, min(r.i + 3, 11))])
        assert r.far == (3 if r.k == "y" else min(r.i + 4, 10))
    assert sorted((r.i for r in got if r.b is not None)) == [2, 3, 7]


def test_repeated_entries_with_zeros_and_colliding_hashes(monkeypatch):
    g = np.random.default_rng(3)
    floats, whole = g.choice([0.0, -0.0, 1.5], (50, 12)), g.integers(0, 2, (50, 12))
    real = g.random((50, 12)) < 0.8
    want = np.zeros((50, 12), bool)
    for n, j in itertools.product(range(50), range(12)):
        want[n, j] = real[n, j] and any(real[n, i] and floats[n, i] == floats[n, j] and whole[n, i] == whole[n, j] for i in range(j))
    assert (se._repeated([floats, whole], real) == want).all()
    # one hash for all entries: unequal ones meet, and values decide
    monkeypatch.setattr(se, "MIXER", np.uint64(0))
    assert (se._repeated([floats, whole], real) == want).all()


def test_shuffle_control_copies_rows_after_their_exchange(spark):
    hops = sum(r.n for r in entry.queries()["b12_subject_folds"](spark, SF).collect())
    rows, moved = shuffled_rows(spark, lambda: entry.queries()["b10_shuffle_control"](spark, SF))
    assert rows == 20 and moved < 20 * hops


def test_shuffled_targets_replay_once(spark):
    plan = entry.queries()["b11_shuffled_targets"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "Relation" not in plan


def test_rows_are_placed_by_whole_columns():
    from windfold.operators import boosting as bo
    g = np.random.default_rng(4)
    x = g.integers(0, 255, (3, 500)).astype(np.uint8)
    for depth in (1, 3, 8):
        tree = bo.Tree.start(depth)
        tree.feature[:] = np.where(np.arange(len(tree.feature)) < 2**depth - 1, g.integers(-1, 3, len(tree.feature)), -1)
        tree.bin[:] = g.integers(0, 254, len(tree.bin))
        want = []
        for row in x.T:
            node = 0
            while tree.feature[node] >= 0:
                node = 2 * node + 1 + int(row[tree.feature[node]] > tree.bin[node])
            want.append(node)
        assert tree.place(x).tolist() == want


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """The smallest tables, where some clips lack all samples of nine days or more, so that hops in their midst have no label."""
    at = tmp_path_factory.mktemp("gaps")
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", at)
    os.remove(at / "events.parquet")
    lost = "user_id = 0 AND d BETWEEN 8 AND 19 OR user_id = 1 AND d BETWEEN 3 AND 11 OR user_id = 2 AND d BETWEEN 16 AND 25 OR user_id = 3 AND (d BETWEEN 3 AND 12 OR d BETWEEN 18 AND 27)"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * EXCLUDE d FROM (SELECT *, day(ts) AS d FROM '{SF}/events.parquet') WHERE NOT ({lost})) TO '{at}/events.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["k12_width_sensitivity", "v19_beam_accounting", "a15_anchor_regret", "j11_best_single_correction", "v19_branch_inventory", "a17_anchor_analysis", "a17_anchor_rows", "w08_recovery_class", "a18_measures"])
def test_hops_without_a_label_end_a_search(spark, gaps, name):
    sf, con = gaps
    df = entry.queries()[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall()) and got[1]
