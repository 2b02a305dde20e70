"""Registry checks and a sample of queries against DuckDB at the smallest scale."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from windfold.plans import catalog
from tools.check import TABLES, table

SF = "/root/testdata/sf0.001"
SAMPLE = ["a03_run_rows", "k05_rule_selector_replay", "k09_beam_replay", "k12_repeated_corrections", "g01_pulse_projection", "g03_dominant_frequency",
          "w04_relative_features", "b02_paired_bootstrap", "v10_hop_lattice", "j02_trajectory_compare", "st1_sliding_windows", "st3_index_monitor"]


def test_registry_is_consistent():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert not any(re.search("pipeline|^op\\d", n) for n in q)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_stream_belief_equals_batch(spark):
    live = entry.queries()["st2_live_belief"](spark, SF)
    from windfold.plans import common
    batch = common.replayed(spark, SF, ["tabled_seed0"])
    a = {(r.clip_id, r.hop_idx): (r.executed_action, r.post_hold_count, r.post_belief_hr_bpm) for r in live.collect()}
    b = {(r.clip_id, r.hop_idx): (r.executed_action, r.post_hold_count, round(r.post_belief_hr_bpm, 6)) for r in batch.collect()}
    assert a.keys() == b.keys() and all(a[k][:2] == b[k][:2] and abs(a[k][2] - b[k][2]) < 2e-6 for k in a)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3
