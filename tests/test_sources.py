import numpy as np
import pytest

from windfold.operators import signal as sg
from windfold.operators.constraints import ConstraintError
from windfold.sources import sensor as sn


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for s in ("S1", "S2"):
        for cam, _, fps in sn.CAMERAS[::2]:
            n = round(9 * fps)
            stem = root / f"{s}_{cam}_before"
            head = ",".join(sn.STATE.names)
            lines = []
            for i in range(n):
                p = 2 * np.pi * 1.2 * i / fps
                cells = [str(i), "0.1", "0.2", "0.3"]
                for k in range(12):
                    cells += [repr(float(100 + a * np.sin(p + k / 10 + d))) for a, d in ((2, 0), (3, 0.4), (4, 0.8))] + ["1.0", "1.0"]
                lines.append(",".join(cells))
            (root / (stem.name + sn.STATE_SUFFIX)).write_text("\n".join([head, *lines]) + "\n")
            (root / (stem.name + sn.TRUTH_SUFFIX)).write_text("frame_idx,gt_ppg\n" + "\n".join(f"{i},{np.sin(2 * np.pi * 1.2 * i / fps)!r}".replace("np.float64(", "").replace(")", "") for i in range(n)) + "\n")
    (root / "split.csv").write_text("subject_id,split\nS1,train\nS2,eval\n")
    return root


def test_manifest_and_measurements_end_to_end(spark, corpus, tmp_path):
    m = sn.build_manifest(spark, str(corpus), str(corpus / "split.csv"))
    assert m["dataset"].first().asDict() == {"clips": 4, "subjects": 2, "frames": 2 * (270 + 216), "hops": 8}
    sn.write_tables(m, str(tmp_path / "m"))
    with pytest.raises(Exception):
        sn.write_tables(m, str(tmp_path / "m"))
    assert sn.load_tables(spark, str(tmp_path / "m"))["clips"].count() == 4
    states = sn.read_states(spark, str(corpus))
    slow = states.where("camera_id = 'IriunWebcam'")
    got = sg.hop_measurements(sn.roi_frames(slow), 24.0).collect()
    assert len(got) == 2 * 2 * 12 and all(r.valid and abs(r.hr_bpm - 72.07) < 0.4 for r in got)
    long = sn.long_frames(slow)
    assert long.count() == 2 * 216 * 12
    wide = sn.wide_frames(long, "g_mean")
    assert wide.count() == 2 * 216 and set(sn.ROIS) <= set(wide.columns)
    assert sn.inventory(spark, str(corpus / "*.csv")).count() == 9


def test_bad_inputs_fail(spark, corpus, tmp_path):
    (tmp_path / "dup.csv").write_text("subject_id,split\nS1,train\nS1,eval\n")
    with pytest.raises(ConstraintError):
        sn.read_split(spark, str(tmp_path / "dup.csv"))
    (tmp_path / "odd.csv").write_text("subject_id,fold\nS1,train\n")
    with pytest.raises(Exception):
        sn.read_split(spark, str(tmp_path / "odd.csv")).collect()
    (tmp_path / "miss.csv").write_text("subject_id,split\nS1,train\n")
    with pytest.raises(ConstraintError):
        sn.build_manifest(spark, str(corpus), str(tmp_path / "miss.csv"))
    (tmp_path / "t.csv").write_text("frame_idx,gt_ppg\n0,0.5\n1,abc\n")
    good, bad = sn.read_typed(spark, str(tmp_path / "t.csv"), sn.TRUTH)
    assert good.count() == 1 and bad.first().gt_ppg == "abc"


def cache(hr, **changed):
    share = np.nan_to_num(hr) / 100
    return {"stem": "S1_x", "view": "Frontal", "condition": "before", "fs": 24.0, "hr_meas": hr, "conf": share, "ppr": share, "cov": share, "gt_hr": np.array([1.0, 2, 3]), "cache_schema_version": 3, "gt_subharmonic_labels": False} | changed


def test_cache_rules(tmp_path):
    hr = np.full((3, 12), 70.0)
    hr[1, 2] = np.nan
    broken = [{"view": ""}, {"fs": 25.0}, {"fs": np.array([24.0])}, {"cache_schema_version": 2}, {"gt_subharmonic_labels": True}, {"gt_hr": np.array([1.0, 2])}, {"gt_hr": np.array([1.0, np.nan, 2])},
              {"ppr": np.full((3, 12), np.inf)}, {"conf": np.full((3, 12), 0.5)}, {"conf": -np.ones((3, 12))}, {"hr_meas": hr[:, :11]}, {"extra": 1}]
    for i, changed in enumerate([{}, *broken]):
        np.savez(tmp_path / f"{i}.npz", **cache(hr, **changed))
        with np.load(tmp_path / f"{i}.npz") as z:
            assert (sn._cache_fault(z) is None) == (not changed), changed
    del hr


def test_cache_inventory_subsets_and_extractor(spark, tmp_path):
    hr = np.full((3, 12), 70.0)
    hr[1, 2] = np.nan
    np.savez(tmp_path / "c.npz", **cache(hr))
    rows = sn.read_cache(spark, str(tmp_path / "*.npz")).orderBy("hop_idx").collect()
    assert len(rows) == 3 and rows[1].hr[2] is None and rows[0].hr[0] == 70.0
    (tmp_path / "i.json").write_text('{"files": [{"path": "a", "sha256": "00", "size": 3}]}')
    assert sn.read_inventory_json(spark, str(tmp_path / "i.json")).first().size == 3
    r = spark.createDataFrame([("a", 0, h, "f") for h in range(3)] + [("b", 1, 0, "g")], "clip_id string, seed int, hop_idx bigint, family string")
    index = sn.write_task_subsets(r, str(tmp_path / "t"), "f").collect()
    assert [(x.clip_id, x.seed, x.rows) for x in index] == [("a", 0, 3)]
    assert sn.read_task_subset(spark, str(tmp_path / "t"), "a", 0).count() == 3
    assert sn.cohort_grid(spark, 15, 20, [(3, 4)]).count() == 299
    make = lambda s, c: {"labels": s.createDataFrame([(0, 1.0)], sn.TRUTH)}
    assert sn.run_extractor(make, spark, {}, {"labels": sn.TRUTH})["labels"].count() == 1
    with pytest.raises(ConstraintError):
        sn.run_extractor(make, spark, {}, {"labels": sn.SPLIT})


def test_observation_shards(spark, tmp_path):
    for i in range(2):
        d = tmp_path / f"shard-{i}"
        d.mkdir()
        (d / "obs.csv").write_text(",".join(sn.OBSERVATION.names) + "\n" + ",".join([f"c{i}", "0"] + ["0.5"] * 101 + ["1.0"] * 12 + ["3", "70.0"]) + "\n")
    rows = sn.read_observations(spark, str(tmp_path / "shard-*" / "*.csv")).collect()
    assert len(rows) == 2 and len(rows[0].obs) == 101 and len(rows[0].errors) == 12


def test_subsets_are_pruned_and_layouts_join_without_exchange(spark, tmp_path):
    rows = spark.range(600).selectExpr("id % 30 AS clip_id", "cast(id % 3 AS int) AS seed", "id AS hop_idx", "cast(id % 5 AS int) AS executed_action")
    index = sn.write_subsets(rows, str(tmp_path / "s"), parts=4)
    assert index.count() == 30 and sum(r.rows for r in index.collect()) == 600
    wanted = spark.range(30).where("id > 3 AND id < 6").selectExpr("id AS clip_id", "cast(id % 3 AS int) AS seed")
    back = sn.read_subsets(spark, str(tmp_path / "s"), wanted, rows.schema)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert sorted(tuple(r) for r in back.select(*rows.columns).collect()) == sorted(tuple(r) for r in rows.where("clip_id IN (4, 5)").collect())
    empty = sn.write_subsets(rows.where("hop_idx < 0"), str(tmp_path / "e"))
    assert empty.count() == 0
    keys = ["clip_id", "hop_idx"]
    a = sn.write_bucketed(rows, str(tmp_path / "a"), keys, 4)
    b = sn.write_bucketed(rows.selectExpr(*keys, "hop_idx * 2 AS twice"), str(tmp_path / "b"), keys, 4)
    joined = a.join(b.hint("merge"), keys)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 600 and joined.where("twice <> hop_idx * 2").count() == 0
