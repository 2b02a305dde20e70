"""SQL forms of the role views (see ``windfold.sources.roles``)."""

from windfold.plans.registry import view

view("v_samples", """
SELECT event_id, ts, user_id AS clip_id,
  CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS roi_index,
  value, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
  CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day
FROM events""")
view("v_frames", """
SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ts, event_id) - 1 AS frame_idx FROM v_samples""")
view("v_span", """
SELECT clip_id, min(day) AS first_day, max(day) - min(day) + 1 AS n_days,
  greatest(0, max(day) - min(day) + 1 - 3 + 1) AS n_hops FROM v_samples GROUP BY clip_id""")
view("v_lattice", "SELECT clip_id, unnest(generate_series(0, n_hops - 1)) AS hop_idx FROM v_span WHERE n_hops > 0")
view("v_daily", """
SELECT s.clip_id, s.day - p.first_day AS day_idx, roi_index, count(*) AS n, sum(cents) AS c, sum(k) AS k
FROM v_samples s JOIN v_span p USING (clip_id) GROUP BY 1, 2, 3""")
view("v_hop_sums", """
SELECT l.clip_id, l.hop_idx, r.roi_index, CAST(coalesce(sum(d.n), 0) AS DOUBLE) AS n,
  CAST(coalesce(sum(d.c), 0) AS DOUBLE) AS c, CAST(coalesce(sum(d.k), 0) AS DOUBLE) AS k
FROM v_lattice l CROSS JOIN (SELECT CAST(range AS INTEGER) AS roi_index FROM range(5)) r
LEFT JOIN v_daily d ON d.clip_id = l.clip_id AND d.roi_index = r.roi_index AND d.day_idx BETWEEN l.hop_idx AND l.hop_idx + 2
GROUP BY 1, 2, 3""")
view("v_meas", """
SELECT clip_id, hop_idx, roi_index,
  CASE WHEN n > 0 THEN c / (100.0::DOUBLE * n) END AS hr_bpm,
  CASE WHEN n > 0 THEN (k / (100.0::DOUBLE * n)) * (n / (n + 1.0::DOUBLE)) END AS confidence,
  CASE WHEN n > 0 THEN k / (100.0::DOUBLE * n) END AS ppr,
  n / (n + 1.0::DOUBLE) AS coverage, n > 0 AS valid,
  CASE WHEN n = 0 THEN 'missing_required_samples' END AS invalid_reason
FROM v_hop_sums""")
view("v_hist_meas", """
SELECT s.clip_id, s.hop_idx, s.roi_index, CASE WHEN n >= 2 THEN floor(c / n) / 100.0::DOUBLE END AS hr_bpm,
  CASE WHEN n >= 2 THEN (floor(k / n) / 100.0::DOUBLE) * (n / (n + 1.0::DOUBLE)) END AS confidence,
  CASE WHEN n >= 2 THEN floor(k / n) / 100.0::DOUBLE END AS ppr, n / (n + 1.0::DOUBLE) AS coverage
FROM v_hop_sums s JOIN v_span p ON p.clip_id = s.clip_id WHERE s.hop_idx < p.n_hops - 1""")
view("v_labels", """
SELECT l.clip_id, l.hop_idx, CASE WHEN sum(d.n) > 0 THEN CAST(sum(d.c) AS DOUBLE) / (100.0::DOUBLE * sum(d.n)) END AS gt_hr_bpm,
  coalesce(sum(d.n), 0) > 0 AS valid,
  CASE WHEN coalesce(sum(d.n), 0) = 0 THEN 'missing_required_samples' END AS invalid_reason
FROM v_lattice l LEFT JOIN v_daily d ON d.clip_id = l.clip_id AND d.day_idx BETWEEN l.hop_idx - 1 AND l.hop_idx + 6
GROUP BY 1, 2""")
view("v_clips", """
SELECT c_custkey AS clip_id, 'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS subject_id, c_mktsegment AS view,
  CASE WHEN c_acctbal < 2000 THEN 'after' ELSE 'before' END AS condition, c_acctbal FROM customer""")
view("v_wide", """
SELECT m.clip_id, m.hop_idx, list(hr_bpm ORDER BY roi_index) AS hr, list(confidence ORDER BY roi_index) AS conf,
  list(ppr ORDER BY roi_index) AS ppr, list(coverage ORDER BY roi_index) AS cov
FROM v_meas m GROUP BY 1, 2""")
view("v_best", """
SELECT clip_id, hop_idx, roi_index AS best FROM v_meas WHERE valid
QUALIFY row_number() OVER (PARTITION BY clip_id, hop_idx ORDER BY confidence DESC, roi_index) = 1""")
view("v_draws", """
SELECT l.clip_id, l.hop_idx, s.seed,
  CAST('0x' || substr(md5(s.seed || '|' || l.clip_id || '|' || l.hop_idx), 1, 8) AS BIGINT) AS draw,
  CAST('0x' || substr(md5('p|' || s.seed || '|' || l.clip_id || '|' || l.hop_idx), 1, 8) AS BIGINT) AS pdraw,
  coalesce(b.best, 0) AS best
FROM v_lattice l CROSS JOIN (SELECT range AS seed FROM range(3)) s LEFT JOIN v_best b USING (clip_id, hop_idx)""")
view("v_line", """
SELECT l_orderkey AS clip_id, p_brand AS subject_id, l_linenumber AS hop_idx, l_returnflag AS view, l_linestatus AS condition,
  p_retailprice AS label, m.method_id, (l_extendedprice / l_quantity) * (1 - l_discount * m.share) AS predicted,
  abs((l_extendedprice / l_quantity) * (1 - l_discount * m.share) - p_retailprice) AS abs_error
FROM lineitem JOIN part ON l_partkey = p_partkey
CROSS JOIN (VALUES ('list', 0.0::DOUBLE), ('half', 0.5::DOUBLE), ('full', 1.0::DOUBLE)) m(method_id, share)""")
view("v_methods", """
SELECT * FROM (VALUES (0, 'arm_0', 'fixed', NULL::INTEGER), (1, 'arm_1', 'fixed', NULL), (2, 'arm_2', 'fixed', NULL), (3, 'arm_3', 'fixed', NULL),
 (4, 'arm_4', 'fixed', NULL), (5, 'max_ppr', 'simple_selector', NULL), (6, 'random_seed0', 'random_null', 0), (7, 'random_seed1', 'random_null', 1),
 (8, 'random_seed2', 'random_null', 2), (9, 'tabled_seed0', 'tabled', 0), (10, 'tabled_seed1', 'tabled', 1), (11, 'tabled_seed2', 'tabled', 2)) t(m, method_id, family, seed)""")
view("v_replay_in", """
SELECT w.clip_id, w.hop_idx, m.m, m.method_id, w.hr, w.conf, w.ppr, w.cov,
  CASE m.family WHEN 'fixed' THEN m.m WHEN 'random_null' THEN d.draw % 5
    WHEN 'tabled' THEN CASE WHEN d.pdraw % 4 = 0 THEN (d.pdraw // 4) % 5 ELSE d.best END END AS given, m.family,
  CASE WHEN m.family = 'simple_selector' THEN list_max(list_transform(list_zip(w.hr, w.ppr), lambda z: CASE WHEN z[1] IS NOT NULL THEN z[2] END)) END AS top
FROM v_wide w CROSS JOIN v_methods m LEFT JOIN v_draws d ON d.clip_id = w.clip_id AND d.hop_idx = w.hop_idx AND d.seed = m.seed""")
STEPS = """
SELECT clip_id, m, CAST(-1 AS BIGINT) AS hop_idx, CAST(NULL AS BIGINT) AS proposed, CAST(-1 AS BIGINT) AS executed, CAST(NULL AS BIGINT) AS previous,
  CAST(0 AS BIGINT) AS pre_hold, CAST(0 AS BIGINT) AS hold, TRUE AS legal, CAST(NULL AS DOUBLE) AS hr, CAST(NULL AS DOUBLE) AS conf,
  70.0::DOUBLE AS pre_mean, 70.0::DOUBLE AS mean, 0.0::DOUBLE AS velocity, 400.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p10, 25.0::DOUBLE AS p11,
  CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS pre_since, 0.0::DOUBLE AS pre_velocity, 400.0::DOUBLE AS pre_p00, 0.0::DOUBLE AS pre_p01, 0.0::DOUBLE AS pre_p10, 25.0::DOUBLE AS pre_p11
FROM (SELECT DISTINCT clip_id, m FROM {given})
UNION ALL
SELECT clip_id, m, hop_idx, proposed, executed, CASE WHEN prev >= 0 THEN prev END, hold0, CASE WHEN executed = prev THEN hold0 + 1 ELSE 1 END,
  free OR proposed = prev, z, c, mean0, x + g0 * y, velocity0 + g1 * y, q00 - g0 * q00, q01 - g0 * q01, q10 - g1 * q00, q11 - g1 * q01,
  CASE WHEN ok AND c >= 0.2::DOUBLE THEN 0 ELSE since0 + 1 END, since0, velocity0, p00, p01, p10, p11
FROM (SELECT *, CASE WHEN ok THEN q00 / (q00 + 200.0::DOUBLE / greatest(c, 1e-6::DOUBLE)) ELSE 0.0::DOUBLE END AS g0,
        CASE WHEN ok THEN q10 / (q00 + 200.0::DOUBLE / greatest(c, 1e-6::DOUBLE)) ELSE 0.0::DOUBLE END AS g1,
        CASE WHEN ok THEN z - x ELSE 0.0::DOUBLE END AS y
  FROM (SELECT *, mean0 + velocity0 AS x, p00 + p01 + p10 + p11 + 0.1::DOUBLE / 3 AS q00, p01 + p11 + 0.1::DOUBLE / 2 AS q01, p10 + p11 + 0.1::DOUBLE / 2 AS q10, p11 + 0.1::DOUBLE AS q11,
          hrs[executed + 1] AS z, confs[executed + 1] AS c, coalesce(hrs[executed + 1] IS NOT NULL AND confs[executed + 1] > 0, FALSE) AS ok
    FROM (SELECT *, CASE WHEN free THEN proposed ELSE prev END AS executed
      FROM (SELECT *, CASE family WHEN 'simple_selector' THEN
                CASE WHEN top IS NULL THEN greatest(prev, 0)
                     WHEN prev >= 0 AND hrs[prev + 1] IS NOT NULL AND pprs[prev + 1] = top THEN prev
                     ELSE list_position(pprs, top) - 1 END
              WHEN 'random_null' THEN CASE WHEN free THEN given ELSE prev END ELSE given END AS proposed
        FROM (SELECT i.clip_id, i.m, i.hop_idx, i.family, i.given, i.top, i.hr AS hrs, i.conf AS confs, i.ppr AS pprs,
                s.executed AS prev, s.hold AS hold0, (s.executed < 0 OR s.hold >= 2) AS free, s.mean AS mean0, s.velocity AS velocity0,
                s.p00, s.p01, s.p10, s.p11, s.since AS since0
          FROM {steps} s JOIN {given} i ON i.clip_id = s.clip_id AND i.m = s.m AND i.hop_idx = s.hop_idx + 1)))))"""
view("v_steps", STEPS.format(given="v_replay_in", steps="v_steps"))
view("v_replay", """
SELECT t.method_id, t.family, t.seed, s.clip_id, s.hop_idx, s.proposed AS proposed_action, s.executed AS executed_action, s.previous AS previous_action,
  s.pre_hold AS pre_hold_count, s.hold AS post_hold_count, s.legal, CASE WHEN NOT s.legal THEN 'minimum_hold' END AS override_reason,
  s.hr AS selected_hr_bpm, s.conf AS selected_confidence, s.hr IS NOT NULL AS selected_valid, s.pre_mean AS pre_belief_hr_bpm, s.mean AS post_belief_hr_bpm,
  s.velocity AS post_velocity, sqrt(greatest(s.p00, 0)) AS post_std_bpm,
  s.pre_since AS pre_since_confident, s.pre_velocity, s.pre_p00, s.pre_p01, s.pre_p10, s.pre_p11
FROM v_steps s JOIN v_methods t ON t.m = s.m WHERE s.hop_idx >= 0""")
view("v_scored", """
SELECT r.*, c.subject_id, c.view, c.condition, l.gt_hr_bpm, abs(r.post_belief_hr_bpm - l.gt_hr_bpm) AS abs_error_bpm
FROM v_replay r JOIN v_labels l ON l.clip_id = r.clip_id AND l.hop_idx = r.hop_idx AND l.valid JOIN v_clips c ON c.clip_id = r.clip_id""")

view("v_hist_in", """
SELECT w.clip_id, w.hop_idx, m.m, m.method_id, w.hr, w.conf, w.ppr, w.cov, m.m AS given, m.family, CAST(NULL AS DOUBLE) AS top
FROM (SELECT clip_id, hop_idx, list(hr_bpm ORDER BY roi_index) AS hr, list(confidence ORDER BY roi_index) AS conf,
        list(ppr ORDER BY roi_index) AS ppr, list(coverage ORDER BY roi_index) AS cov FROM v_hist_meas GROUP BY 1, 2) w
CROSS JOIN v_methods m WHERE m.family = 'fixed'""")
view("v_hist_steps", STEPS.format(given="v_hist_in", steps="v_hist_steps"))
view("v_hist_scored", """
SELECT t.method_id, s.clip_id, s.hop_idx, s.proposed AS proposed_action, s.executed AS executed_action, s.hold AS post_hold_count, s.legal,
  s.hr AS selected_hr_bpm, s.conf AS selected_confidence, s.hr IS NOT NULL AS selected_valid, s.mean AS post_belief_hr_bpm,
  l.gt_hr_bpm, abs(s.mean - l.gt_hr_bpm) AS abs_error_bpm
FROM v_hist_steps s JOIN v_methods t ON t.m = s.m JOIN v_labels l ON l.clip_id = s.clip_id AND l.hop_idx = s.hop_idx AND l.valid WHERE s.hop_idx >= 0""")
