"""Keyed ordered replays (K1-K13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from windfold.functions.columns import r6
from windfold.operators import replay as rp
from windfold.plans import common
from windfold.plans.registry import query, view
from windfold.sources import roles

HOP_COLUMNS = ("proposed_action", "executed_action", "previous_action", "pre_hold_count", "post_hold_count", "legal", "override_reason", "selected_valid")
HOP_SQL = """SELECT method_id, clip_id, hop_idx, proposed_action, executed_action, previous_action, pre_hold_count, post_hold_count, legal,
  override_reason, selected_valid, round(selected_hr_bpm, 6) AS selected_hr_bpm, round(selected_confidence, 6) AS selected_confidence,
  round(pre_belief_hr_bpm, 6) AS pre_belief_hr_bpm, round(post_belief_hr_bpm, 6) AS post_belief_hr_bpm,
  round(post_velocity, 6) AS post_velocity, round(post_std_bpm, 6) AS post_std_bpm FROM v_replay"""


def hop_view(df):
    return df.select("method_id", "clip_id", "hop_idx", *HOP_COLUMNS, *[r6(c).alias(c) for c in (
        "selected_hr_bpm", "selected_confidence", "pre_belief_hr_bpm", "post_belief_hr_bpm", "post_velocity", "post_std_bpm")])


@query("k01_belief_filter", """SELECT clip_id, hop_idx, round(pre_belief_hr_bpm, 6) AS pre_mean, round(post_belief_hr_bpm, 6) AS post_mean,
  round(post_velocity, 6) AS velocity, round(post_std_bpm, 6) AS std, pre_since_confident AS hops_since_confident FROM v_replay WHERE method_id = 'arm_0'""")
def belief_filter(spark, sf):
    r = common.replayed(spark, sf, ["arm_0"])
    return r.select("clip_id", "hop_idx", r6("pre_belief_hr_bpm").alias("pre_mean"), r6("post_belief_hr_bpm").alias("post_mean"),
                    r6("post_velocity").alias("velocity"), r6("post_std_bpm").alias("std"), F.col("pre_since_confident").alias("hops_since_confident"))


@query("k02_minimum_hold", """SELECT method_id, clip_id, hop_idx, proposed_action, executed_action, previous_action, pre_hold_count, post_hold_count, legal, override_reason
  FROM v_replay WHERE method_id = 'tabled_seed0'""")
def minimum_hold(spark, sf):
    r = common.replayed(spark, sf, ["tabled_seed0"])
    return r.select("method_id", "clip_id", "hop_idx", "proposed_action", "executed_action", "previous_action", "pre_hold_count", "post_hold_count", "legal", "override_reason")


@query("k04_fixed_arm_replay", HOP_SQL + " WHERE family = 'fixed'")
def fixed_arms(spark, sf):
    return hop_view(common.replayed(spark, sf, [m[0] for m in common.METHODS if m[1] == "fixed"]))


@query("k05_rule_selector_replay", HOP_SQL + " WHERE family IN ('simple_selector', 'random_null')")
def rule_selectors(spark, sf):
    return hop_view(common.replayed(spark, sf, ["max_ppr", *[f"random_seed{s}" for s in roles.RANDOM_SEEDS]]))


@query("k06_proposal_table_replay", HOP_SQL + " WHERE family = 'tabled'")
def proposals(spark, sf):
    return hop_view(common.replayed(spark, sf, [f"tabled_seed{s}" for s in roles.RANDOM_SEEDS]))


view("v_greedy_in", """SELECT w.clip_id, w.hop_idx, w.hr, w.conf, l.gt_hr_bpm AS gt FROM v_wide w JOIN v_labels l ON l.clip_id = w.clip_id AND l.hop_idx = w.hop_idx AND l.valid""")
# One filter step for every (state row, action); ``kind`` rows carry whatever path columns they need.
STEP_SQL = """SELECT *, x + g0 * y AS n_mean, velocity + g1 * y AS n_velocity, q00 - g0 * q00 AS n00, q01 - g0 * q01 AS n01, q10 - g1 * q00 AS n10, q11 - g1 * q01 AS n11,
    abs(x + g0 * y - gt) AS err, CASE WHEN a = prev THEN hold + 1 ELSE 1 END AS n_hold
  FROM (SELECT *, CASE WHEN ok THEN q00 / (q00 + 200.0::DOUBLE / greatest(c, 1e-6::DOUBLE)) ELSE 0.0::DOUBLE END AS g0,
          CASE WHEN ok THEN q10 / (q00 + 200.0::DOUBLE / greatest(c, 1e-6::DOUBLE)) ELSE 0.0::DOUBLE END AS g1, CASE WHEN ok THEN z - x ELSE 0.0::DOUBLE END AS y
    FROM (SELECT *, mean + velocity AS x, p00 + p01 + p10 + p11 + 0.1::DOUBLE / 3 AS q00, p01 + p11 + 0.1::DOUBLE / 2 AS q01, p10 + p11 + 0.1::DOUBLE / 2 AS q10, p11 + 0.1::DOUBLE AS q11,
            hr[a + 1] AS z, conf[a + 1] AS c, coalesce(hr[a + 1] IS NOT NULL AND conf[a + 1] > 0, FALSE) AS ok
      FROM ({source})))"""
START_SQL = """70.0::DOUBLE AS mean, 0.0::DOUBLE AS velocity, 400.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p10, 25.0::DOUBLE AS p11, CAST(-1 AS BIGINT) AS prev, CAST(0 AS BIGINT) AS hold"""
view("v_greedy", f"""
SELECT clip_id, CAST(-1 AS BIGINT) AS hop_idx, {START_SQL}, CAST(0 AS BIGINT) AS pre_hold, 0.0::DOUBLE AS pre_mean, TRUE AS selected_valid, 0.0::DOUBLE AS err FROM (SELECT DISTINCT clip_id FROM v_greedy_in)
UNION ALL
SELECT clip_id, hop_idx, n_mean, n_velocity, n00, n01, n10, n11, a, n_hold, hold, mean, z IS NOT NULL, err FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY err, a) AS rn FROM (
    {STEP_SQL.format(source="SELECT g.clip_id, i.hop_idx, g.mean, g.velocity, g.p00, g.p01, g.p10, g.p11, g.prev, g.hold, i.hr, i.conf, i.gt, act.a FROM v_greedy g JOIN v_greedy_in i ON i.clip_id = g.clip_id AND i.hop_idx = g.hop_idx + 1 CROSS JOIN (SELECT range AS a FROM range(5)) act WHERE g.prev < 0 OR g.hold >= 2 OR g.prev = act.a")}
  )) WHERE rn = 1""")
view("v_beam", f"""
SELECT clip_id, CAST(-1 AS BIGINT) AS hop_idx, {START_SQL}, 0.0::DOUBLE AS total, CAST([] AS BIGINT[]) AS seq, CAST([] AS DOUBLE[]) AS errs, CAST([] AS DOUBLE[]) AS means, CAST(1 AS BIGINT) AS rn FROM (SELECT DISTINCT clip_id FROM v_greedy_in)
UNION ALL
SELECT clip_id, hop_idx, n_mean, n_velocity, n00, n01, n10, n11, a, n_hold, n_total, n_seq, list_append(errs, err), list_append(means, n_mean), rn FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n_total, n_seq) AS rn FROM (
  SELECT *, total + err AS n_total, list_append(seq, a) AS n_seq FROM (
    {STEP_SQL.format(source="SELECT g.clip_id, i.hop_idx, g.mean, g.velocity, g.p00, g.p01, g.p10, g.p11, g.prev, g.hold, g.total, g.seq, g.errs, g.means, i.hr, i.conf, i.gt, act.a FROM v_beam g JOIN v_greedy_in i ON i.clip_id = g.clip_id AND i.hop_idx = g.hop_idx + 1 CROSS JOIN (SELECT range AS a FROM range(5)) act WHERE g.prev < 0 OR g.hold >= 2 OR g.prev = act.a")}
  ))) WHERE rn <= 8""")
view("v_beam_best", """SELECT clip_id, unnest(range(len(seq))) AS hop_idx, unnest(seq) AS action, unnest(errs) AS abs_error_bpm, unnest(means) AS post_belief_hr_bpm
  FROM (SELECT * FROM v_beam WHERE rn = 1 QUALIFY hop_idx = max(hop_idx) OVER (PARTITION BY clip_id)) WHERE hop_idx >= 0""")


@query("k08_greedy_replay", """SELECT clip_id, hop_idx, prev AS executed_action, pre_hold AS pre_hold_count, hold AS post_hold_count, selected_valid,
  round(pre_mean, 6) AS pre_belief_hr_bpm, round(mean, 6) AS post_belief_hr_bpm, round(err, 6) AS abs_error_bpm FROM v_greedy WHERE hop_idx >= 0""")
def greedy(spark, sf):
    g = rp.greedy(common.labelled_hops(spark, sf))
    return g.select("clip_id", "hop_idx", "executed_action", "pre_hold_count", "post_hold_count", "selected_valid",
                    *[r6(c).alias(c) for c in ("pre_belief_hr_bpm", "post_belief_hr_bpm", "abs_error_bpm")])


@query("k09_beam_replay", """SELECT clip_id, hop_idx, action AS executed_action, round(post_belief_hr_bpm, 6) AS post_belief_hr_bpm, round(abs_error_bpm, 6) AS abs_error_bpm FROM v_beam_best""")
def beam(spark, sf):
    b = rp.beam(common.labelled_hops(spark, sf), 8)
    return b.select("clip_id", "hop_idx", "executed_action", *[r6(c).alias(c) for c in ("post_belief_hr_bpm", "abs_error_bpm")])
