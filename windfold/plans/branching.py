"""What-if queries: counterfactuals, interventions, repeated corrections (K7, K10-K13, A15-A18, T, W7, W8, V19).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from windfold.functions import columns as col
from windfold.functions.columns import r6
from windfold.operators import constraints as co
from windfold.operators import replay as rp
from windfold.operators import search as se
from windfold.operators.windows import ahead
from windfold.plans import common
from windfold.plans.registry import query, view
from windfold.plans.replays import STEP_SQL
from windfold.plans.sqlviews import STEPS
from windfold.sources import roles

CH = len(roles.CHANNELS)
WINDOW = 15
HORIZONS = (1, 5, 15)


def trace(spark, sf, seed=0):
    return common.replayed(spark, sf, [f"tabled_seed{seed}"])


def what_if(spark, sf, seed=0):
    """What-if arrays joined to labels afterwards."""
    w = se.what_if(trace(spark, sf, seed), roles.hops(spark, sf), CH)
    l = roles.labels(spark, sf).where("valid").select("clip_id", "hop_idx", "gt_hr_bpm")
    return w.join(l, ["clip_id", "hop_idx"]).withColumn("if_error", F.expr("transform(if_belief, b -> abs(b - gt_hr_bpm))"))


SNAP = """r.pre_belief_hr_bpm AS mean, r.pre_velocity AS velocity, r.pre_p00 AS p00, r.pre_p01 AS p01, r.pre_p10 AS p10, r.pre_p11 AS p11, coalesce(r.previous_action, -1) AS prev, r.pre_hold_count AS hold"""
view("v_whatif", f"""SELECT clip_id, hop_idx, requested, a AS executed, z IS NOT NULL AS valid, n_mean AS belief, err, free, factual_executed, factual_belief, gt FROM ({STEP_SQL.format(source=f'''
  SELECT r.clip_id, r.hop_idx, act.q AS requested, {SNAP}, r.executed_action AS factual_executed, r.post_belief_hr_bpm AS factual_belief, (r.previous_action IS NULL OR r.pre_hold_count >= 2) AS free,
    CASE WHEN r.previous_action IS NULL OR r.pre_hold_count >= 2 THEN act.q ELSE r.previous_action END AS a, i.hr, i.conf, i.gt
  FROM v_replay r JOIN v_greedy_in i ON i.clip_id = r.clip_id AND i.hop_idx = r.hop_idx CROSS JOIN (SELECT range AS q FROM range(5)) act WHERE r.method_id = 'tabled_seed0' ''')})""")


@query("k07_counterfactuals", "SELECT clip_id, hop_idx, requested, valid, round(belief, 6) AS post_belief_hr_bpm, round(err, 6) AS abs_error_bpm FROM v_whatif")
def counterfactuals(spark, sf):
    w = what_if(spark, sf)
    return w.select("clip_id", "hop_idx", F.posexplode(F.arrays_zip("if_valid", "if_belief", "if_error")).alias("requested", "i")).select(
        "clip_id", "hop_idx", F.col("requested").cast("bigint").alias("requested"), F.col("i.if_valid").alias("valid"), r6("i.if_belief").alias("post_belief_hr_bpm"), r6("i.if_error").alias("abs_error_bpm"))


@query("a16_failure_audit", """SELECT clip_id, hop_idx, CASE WHEN best IS NULL THEN 'no_valid_immediate_action' WHEN factual_valid THEN 'ok' ELSE 'selected_measurement_invalid' END AS category,
  CASE WHEN best IS NULL THEN '' ELSE ties END AS best_actions, round(best, 6) AS best_error, round(factual_error - best, 6) + 0 AS regret FROM (
  SELECT w.clip_id, w.hop_idx, min(best) AS best, string_agg(CASE WHEN valid AND err = best THEN CAST(requested AS VARCHAR) END, ',' ORDER BY requested) AS ties, max(abs(factual_belief - gt)) AS factual_error, bool_or(requested = factual_executed AND valid) AS factual_valid
  FROM (SELECT *, min(err) FILTER (valid) OVER (PARTITION BY clip_id, hop_idx) AS best FROM v_whatif) w GROUP BY 1, 2)""")
def failure_audit(spark, sf):
    w = what_if(spark, sf)
    best = F.expr("array_min(filter(transform(if_error, (e, i) -> if(if_valid[i], e, NULL)), e -> e IS NOT NULL))")
    w = w.withColumn("best", best)
    ties = F.expr("array_join(filter(transform(if_error, (e, i) -> if(if_valid[i] AND e = best, cast(i AS string), NULL)), x -> x IS NOT NULL), ',')")
    category = F.when(F.col("best").isNull(), "no_valid_immediate_action").when(F.col("selected_valid"), "ok").otherwise("selected_measurement_invalid")
    return w.select("clip_id", "hop_idx", category.alias("category"), ties.alias("best_actions"), r6("best").alias("best_error"),
                    (r6(F.abs(F.col("post_belief_hr_bpm") - F.col("gt_hr_bpm")) - F.col("best")) + 0).alias("regret"))


@query("t01_max_ratio_channel", """SELECT clip_id, hop_idx, coalesce(min(roi_index) FILTER (ppr = top), 0) AS action FROM (SELECT *, max(ppr) OVER (PARTITION BY clip_id, hop_idx) AS top FROM v_meas) GROUP BY 1, 2""")
def max_ratio(spark, sf):
    return roles.hops(spark, sf).select("clip_id", "hop_idx", F.expr("if(array_max(ppr) IS NULL, 0, array_position(ppr, array_max(ppr)) - 1)").cast("bigint").alias("action"))


view("v_order", "SELECT *, row_number() OVER (PARTITION BY clip_id, hop_idx ORDER BY CASE WHEN valid THEN err END NULLS LAST, requested) AS pos FROM v_whatif")


def ordered(w):
    """Action order by (error, index) with invalid channels last, as an array."""
    return w.withColumn("order", F.expr("transform(array_sort(transform(if_error, (e, i) -> named_struct('bad', NOT if_valid[i], 'e', if(if_valid[i], e, 0D), 'i', i))), s -> s.i)"))


@query("t02_action_order", "SELECT clip_id, hop_idx, string_agg(CAST(requested AS VARCHAR), ',' ORDER BY pos) AS action_order FROM v_order WHERE free GROUP BY 1, 2")
def action_order(spark, sf):
    return ordered(what_if(spark, sf).where("free")).select("clip_id", "hop_idx", F.expr("array_join(order, ',')").alias("action_order"))


@query("t03_top3_membership", """SELECT clip_id, hop_idx, pos = 1 AS top1, pos <= 3 AND valid AS top3 FROM v_order WHERE free AND requested = factual_executed""")
def top3(spark, sf):
    w = ordered(what_if(spark, sf).where("free"))
    pos = F.expr("array_position(order, cast(executed_action AS int))")
    return w.select("clip_id", "hop_idx", (pos == 1).alias("top1"), ((pos <= 3) & F.expr("if_valid[cast(executed_action AS int)]")).alias("top3"))


# --- interventions ------------------------------------------------------------------------

view("v_anchor", f"""SELECT CAST(right(r.method_id, 1) AS BIGINT) AS seed, r.clip_id, r.hop_idx AS anchor, r.executed_action AS factual_action, {SNAP} FROM v_replay r JOIN v_span s ON s.clip_id = r.clip_id
  WHERE r.method_id LIKE 'tabled_seed%' AND s.n_hops - r.hop_idx >= {WINDOW} AND (r.previous_action IS NULL OR r.pre_hold_count >= 2)""")
view("v_given", "SELECT CAST(right(i.method_id, 1) AS BIGINT) AS seed, i.clip_id, i.hop_idx, i.given, g.hr, g.conf, g.gt FROM v_replay_in i JOIN v_greedy_in g ON g.clip_id = i.clip_id AND g.hop_idx = i.hop_idx WHERE i.method_id LIKE 'tabled_seed%'")
view("v_branch", f"""SELECT seed, clip_id, anchor, act.q AS branch_action, CAST(-1 AS BIGINT) AS off, mean, velocity, p00, p01, p10, p11, CAST(prev AS BIGINT) AS prev, hold, 0.0::DOUBLE AS err, CAST(0 AS BIGINT) AS proposed FROM v_anchor CROSS JOIN (SELECT range AS q FROM range(5)) act
UNION ALL
SELECT seed, clip_id, anchor, branch_action, off, n_mean, n_velocity, n00, n01, n10, n11, a, n_hold, err, proposed FROM ({STEP_SQL.format(source=f'''
  SELECT *, CASE WHEN prev < 0 OR hold >= 2 THEN proposed ELSE prev END AS a FROM (
  SELECT b.seed, b.clip_id, b.anchor, b.branch_action, b.off + 1 AS off, b.mean, b.velocity, b.p00, b.p01, b.p10, b.p11, b.prev, b.hold, g.hr, g.conf, g.gt,
    CASE WHEN b.off = -1 THEN b.branch_action ELSE g.given END AS proposed FROM v_branch b JOIN v_given g ON g.seed = b.seed AND g.clip_id = b.clip_id AND g.hop_idx = b.anchor + b.off + 1 WHERE b.off < {WINDOW - 1})''')})""")


KEYS = ("seed", "clip_id", "anchor")
#: Proposal of the anchor's policy at a hop, which has those of all seeds side by side.
SEEDED = [f"policy_{s}" for s in roles.RANDOM_SEEDS]
PROPOSED = {"proposal": f"element_at(array({', '.join(f'h.{c}' for c in SEEDED)}), cast(seed + 1 AS int))"}
POLICY = rp.proposal_selector("proposal", "tabled")


def traces(spark, sf):
    """Replays of the tabled policies of all seeds, made in one pass."""
    return common.replayed(spark, sf, [f"tabled_seed{s}" for s in roles.RANDOM_SEEDS]).withColumn("seed", F.col("seed").cast("bigint"))


def starts(spark, sf):
    counts = roles.hops(spark, sf).groupBy("clip_id").agg(F.count(F.lit(1)).alias("hop_count"))
    return se.anchors(traces(spark, sf), counts, WINDOW, ["seed", "executed_action"])


def branch_windows(spark, sf):
    """One row per anchor: its factual action and its branches by (offset, action)."""
    hops = roles.policy_inputs(roles.hops(spark, sf))
    return se.branch_windows(starts(spark, sf), hops, POLICY, CH, WINDOW, (*KEYS, "executed_action"), PROPOSED, SEEDED)


def truth(spark, sf):
    """Label of every hop, null where it is not usable, so that a list of them has one entry a hop."""
    return roles.labels(spark, sf).where("clip_id IS NOT NULL").selectExpr("clip_id", "hop_idx", "if(valid, gt_hr_bpm, NULL) AS gt")


@query("k11_interventions", """SELECT seed, clip_id, anchor, branch_action, off AS "offset", proposed AS proposed_action, prev AS executed_action, round(mean, 6) AS post_belief_hr_bpm FROM v_branch WHERE off >= 0""")
def interventions(spark, sf):
    b = labelled_branches(spark, sf, "proposed", "executed").select(*KEYS, F.posexplode(F.expr("slice(arrays_zip(proposed, executed, belief), 1, reach)")).alias("offset", "o"))
    b = b.select(*KEYS, F.col("offset").cast("bigint").alias("offset"), F.posexplode(F.arrays_zip("o.proposed", "o.executed", "o.belief")).alias("branch_action", "b"))
    return b.select("seed", "clip_id", "anchor", "branch_action", "offset", F.col("b.proposed").alias("proposed_action"), F.col("b.executed").alias("executed_action"), r6("b.belief").alias("post_belief_hr_bpm"))


@query("k13_eligible_anchors", "SELECT seed, clip_id, count(*) AS anchors, min(anchor) AS first_anchor, max(anchor) AS last_anchor FROM v_anchor GROUP BY 1, 2")
def eligible(spark, sf):
    return starts(spark, sf).groupBy("seed", "clip_id").agg(F.count(F.lit(1)).alias("anchors"), F.min("anchor").alias("first_anchor"), F.max("anchor").alias("last_anchor"))


@query("j05_branch_label_join", """SELECT seed, clip_id, anchor, branch_action, round(avg(err), 6) AS mean_abs_error FROM v_branch WHERE off >= 0 GROUP BY 1, 2, 3, 4""")
def branch_labels(spark, sf):
    b = branch_errors(spark, sf).select(*KEYS, F.posexplode("berrors").alias("branch_action", "e"))
    return b.select(*KEYS, "branch_action", r6(F.expr(f"{ADD.format('e')} / size(e)")).alias("mean_abs_error"))


view("v_branch_errs", "SELECT seed, clip_id, anchor, branch_action, list(err ORDER BY off) AS berrs FROM v_branch WHERE off >= 0 GROUP BY 1, 2, 3, 4")
view("v_branch_score", "SELECT seed, clip_id, anchor, h.horizon, branch_action, list_reduce(berrs[1:h.horizon], lambda x, y: x + y) / h.horizon AS mean_error FROM v_branch_errs CROSS JOIN (VALUES (1), (5), (15)) h(horizon)")
view("v_regret", """SELECT s.seed, s.clip_id, s.anchor, s.horizon, a.factual_action, s.branch_action AS best_action, f.mean_error AS factual_error, s.mean_error AS best_error
  FROM (SELECT * FROM v_branch_score QUALIFY row_number() OVER (PARTITION BY seed, clip_id, anchor, horizon ORDER BY mean_error, branch_action) = 1) s JOIN v_anchor a ON a.seed = s.seed AND a.clip_id = s.clip_id AND a.anchor = s.anchor
  JOIN v_branch_score f ON f.seed = s.seed AND f.clip_id = s.clip_id AND f.anchor = s.anchor AND f.horizon = s.horizon AND f.branch_action = a.factual_action""")


ADD = "aggregate({}, 0D, (s, x) -> s + x)"


#: Number of labels of the list ``{0}`` before its first null from place ``{1}`` on.
REACH = "coalesce(nullif(array_position(transform(slice({0}, cast({1} AS int) + 1, {2}), g -> g IS NULL), true), 0) - 1, size({0}) - {1})"


def labelled_branches(spark, sf, *columns):
    """One row per anchor with a label: its branches, the labels of its window and how many
    hops these ``reach``.  Branches meet the labels after the replay and end at the first hop
    without one."""
    b = branch_windows(spark, sf).withColumnRenamed("hop_idx", "hops").select("clip_id", F.col("anchor").alias("hop_idx"), "seed", F.col("executed_action").alias("factual_action"), "belief", *columns)
    rows = ahead({"b": b, "l": truth(spark, sf)}, ["clip_id"], "hop_idx", {"ls": ("collect_list(l)", WINDOW - 1)}).where("b IS NOT NULL")
    rows = rows.select("b.seed", "clip_id", F.col("hop_idx").alias("anchor"), "b.factual_action", "b.belief", *[f"b.{c}" for c in columns], F.col("ls.gt").alias("gts"))
    return rows.withColumn("reach", F.expr(f"cast({REACH.format('gts', 0, WINDOW)} AS int)")).where("reach > 0")


def branch_errors(spark, sf):
    """One row per anchor: the errors of each branch over its labelled hops, summed in offset
    order, so that equal branches tie exactly."""
    b = labelled_branches(spark, sf)
    return b.select(*KEYS, "factual_action", F.expr(f"transform(sequence(0, {CH - 1}), a -> transform(slice(belief, 1, reach), (v, o) -> abs(v[a] - gts[o])))").alias("berrors"))


def regrets(spark, sf):
    """Horizon means per branch, then factual minus best; an anchor is one row throughout."""
    means = F.array(*[F.struct(F.lit(h).alias("horizon"), F.expr(f"transform(berrors, e -> {ADD.format(f'slice(e, 1, {h})')} / {h})").alias("means")) for h in HORIZONS])
    m = branch_errors(spark, sf).select(*KEYS, "factual_action", F.explode(means).alias("m")).select(*KEYS, "factual_action", "m.*")
    m = m.withColumn("best", F.expr("array_min(transform(means, (m, a) -> named_struct('mean_error', m, 'branch_action', cast(a AS bigint))))"))
    return m.select(*KEYS, "horizon", "factual_action", F.col("best.branch_action").alias("best_action"), F.expr("means[cast(factual_action AS int)]").alias("factual_error"), F.col("best.mean_error").alias("best_error"))


@query("a15_anchor_regret", """SELECT seed, clip_id, anchor, horizon, factual_action, best_action, round(factual_error, 6) AS factual_error, round(best_error, 6) AS best_error, round(factual_error - best_error, 6) + 0 AS regret FROM v_regret""")
def anchor_regret(spark, sf):
    return regrets(spark, sf).select("seed", "clip_id", "anchor", "horizon", "factual_action", "best_action", r6("factual_error").alias("factual_error"), r6("best_error").alias("best_error"),
                                     (r6(F.col("factual_error") - F.col("best_error")) + 0).alias("regret"))


@query("v19_branch_inventory", f"""SELECT count(*) AS anchors, count(*) FILTER (n <> {5 * WINDOW} OR acts <> 5 OR lo <> 0 OR hi <> {WINDOW - 1}) AS broken FROM (
  SELECT seed, clip_id, anchor, count(*) AS n, count(DISTINCT branch_action) AS acts, min(off) AS lo, max(off) AS hi FROM v_branch WHERE off >= 0 GROUP BY 1, 2, 3)""")
def branch_inventory(spark, sf):
    """An anchor's branches are counted in its row; the proposals of the first hop are its actions."""
    g = labelled_branches(spark, sf, "proposed", "hops").selectExpr("aggregate(slice(belief, 1, reach), 0, (n, o) -> n + size(o)) AS n", "size(array_distinct(proposed[0])) AS acts", "hops[0] - anchor AS lo", "hops[reach - 1] - anchor AS hi")
    return g.agg(F.count(F.lit(1)).alias("anchors"), co.count_if((F.col("n") != CH * WINDOW) | (F.col("acts") != CH) | (F.col("lo") != 0) | (F.col("hi") != WINDOW - 1)).alias("broken"))


# --- repeated corrections -------------------------------------------------------------------


def corrections_sql(name: str, width: int) -> str:
    return f"""SELECT seed, clip_id, anchor, CAST(-1 AS BIGINT) AS off, mean, velocity, p00, p01, p10, p11, CAST(prev AS BIGINT) AS prev, hold, 0.0::DOUBLE AS total, 0.0::DOUBLE AS err, CAST([] AS BIGINT[]) AS seq, CAST([] AS DOUBLE[]) AS errs, CAST([] AS BOOLEAN[]) AS corrected, CAST([] AS BIGINT[]) AS pol, CAST(1 AS BIGINT) AS rn FROM v_anchor
UNION ALL
SELECT seed, clip_id, anchor, off, n_mean, n_velocity, n00, n01, n10, n11, a, n_hold, n_total, err, n_seq, list_append(errs, err), list_append(corrected, is_first AND pol_legal AND a <> given), list_append(pol, given), rn2 FROM (
 SELECT *, row_number() OVER (PARTITION BY seed, clip_id, anchor ORDER BY n_total, err, n_seq) AS rn2 FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, clip_id, anchor, n_mean, n_velocity, n00, n01, n10, n11, a, n_hold ORDER BY n_total, err, n_seq) AS dup FROM (
   SELECT *, total + err AS n_total, list_append(seq, a) AS n_seq, row_number() OVER (PARTITION BY seed, clip_id, anchor, rn ORDER BY err, a) = 1 AS is_first, (prev < 0 OR hold >= 2 OR given = prev) AS pol_legal FROM (
    {STEP_SQL.format(source=f'''SELECT b.seed, b.clip_id, b.anchor, b.off + 1 AS off, b.mean, b.velocity, b.p00, b.p01, b.p10, b.p11, b.prev, b.hold, b.total, b.seq, b.errs, b.corrected, b.pol, b.rn, g.hr, g.conf, g.gt, g.given, act.q AS a
    FROM {name} b JOIN v_given g ON g.seed = b.seed AND g.clip_id = b.clip_id AND g.hop_idx = b.anchor + b.off + 1 CROSS JOIN (SELECT range AS q FROM range(5)) act WHERE b.off < {WINDOW - 1} AND (b.prev < 0 OR b.hold >= 2 OR b.prev = act.q)''')}))
   WHERE is_first OR (a = given AND pol_legal)) WHERE dup = 1) WHERE rn2 <= {width}"""


for _w in (1, 2, 4, 8, 16, 32):
    view(f"v_corr{_w}", corrections_sql(f"v_corr{_w}", _w))


WIDTHS = (1, 2, 4, 8, 16, 32)


def correction_inputs(spark, sf):
    """Anchors and all hops, those without a label with a null one: there an anchor's search ends."""
    hops = roles.policy_inputs(roles.hops(spark, sf))
    return starts(spark, sf), hops.join(truth(spark, sf).withColumnRenamed("gt", "gt_hr_bpm"), ["clip_id", "hop_idx"], "left"), POLICY, CH


BEAM = {"window": WINDOW, "keys": KEYS, "extra": PROPOSED, "also": SEEDED}


def accounting(spark, sf, widths=(8,)):
    """Accounting of the beam by depth, without its paths."""
    return se.repeated_corrections(*correction_inputs(spark, sf), widths, **BEAM, with_paths=False)


def survivors(spark, sf):
    """The surviving paths of each anchor in rank order, as an array."""
    return se.correction_windows(*correction_inputs(spark, sf), **BEAM).select(*KEYS, "paths")


def surviving(spark, sf):
    return survivors(spark, sf).select(*KEYS, F.posexplode("paths").alias("path_rank", "p")).select(*KEYS, "path_rank", "p.*")


@query("k12_repeated_corrections", f"""SELECT seed, clip_id, anchor, rn - 1 AS path_rank, round(total, 6) AS total_error, array_to_string(seq, ',') AS actions, CAST(len(list_filter(corrected, lambda c: c)) AS BIGINT) AS corrections FROM v_corr8 WHERE off = {WINDOW - 1}""")
def repeated(spark, sf):
    p = surviving(spark, sf)
    return p.select("seed", "clip_id", "anchor", F.col("path_rank").cast("bigint").alias("path_rank"), r6("total").alias("total_error"), F.array_join(F.col("seq").cast("array<string>"), ",").alias("actions"),
                    F.size(F.filter("corrected", lambda c: c)).cast("bigint").alias("corrections"))


@query("k12_width_sensitivity", " UNION ALL ".join(f"SELECT seed, CAST({w} AS BIGINT) AS width, count(DISTINCT (clip_id, anchor)) AS anchors, count(*) AS retained_paths, round(avg(total) FILTER (rn = 1), 6) AS best_total FROM v_corr{w} WHERE off = {WINDOW - 1} GROUP BY 1" for w in (1, 2, 4, 8, 16, 32)))
def width_sensitivity(spark, sf):
    b = accounting(spark, sf, WIDTHS).where(F.col("offset") == WINDOW - 1)
    return b.groupBy("seed", "width").agg(F.count(F.lit(1)).alias("anchors"), F.sum("retained").alias("retained_paths"), r6(F.avg("best_total")).alias("best_total"))


@query("v19_beam_accounting", """SELECT seed, off AS "offset", count(DISTINCT (clip_id, anchor)) AS anchors, count(*) AS retained, CAST(0 AS BIGINT) AS broken FROM v_corr8 WHERE off >= 0 GROUP BY 1, 2""")
def beam_accounting(spark, sf):
    """Paths retained at every depth; generated = deduped + retained + pruned is broken nowhere."""
    broken = F.col("generated") != F.col("deduped") + F.col("retained") + F.col("pruned")
    return accounting(spark, sf).groupBy("seed", "offset").agg(F.count(F.lit(1)).alias("anchors"), F.sum("retained").alias("retained"), co.count_if(broken).alias("broken"))


@query("t05_path_order", f"""SELECT seed, clip_id, anchor, rn - 1 AS path_rank, row_number() OVER (PARTITION BY seed, clip_id, anchor ORDER BY total, err, seq) - 1 AS by_key FROM v_corr8 WHERE off = {WINDOW - 1}""")
def path_order(spark, sf):
    """Order of the surviving paths by (total, endpoint, sequence), sorted within their anchor's row."""
    key = "transform(paths, (p, i) -> named_struct('total', p.total, 'endpoint', element_at(p.errors, -1), 'seq', p.seq, 'path_rank', i))"
    p = survivors(spark, sf).select(*KEYS, F.posexplode(F.expr(f"transform(array_sort({key}), k -> k.path_rank)")).alias("by_key", "path_rank"))
    return p.select(*KEYS, F.col("path_rank").cast("bigint").alias("path_rank"), F.col("by_key").cast("bigint").alias("by_key"))


@query("w07_running_error", f"""SELECT seed, clip_id, anchor, rn - 1 AS path_rank, i AS "offset", round(list_sum(errs[1:i + 1]), 6) AS cumulative_error FROM v_corr8 CROSS JOIN (SELECT range AS i FROM range({WINDOW})) WHERE off = {WINDOW - 1}""")
def running_error(spark, sf):
    """Sums along each path, made in the path's row."""
    sums = F.expr("aggregate(errors, cast(array() AS array<double>), (s, e) -> array_append(s, coalesce(try_element_at(s, -1), 0D) + e))")
    p = surviving(spark, sf).select(*KEYS, F.col("path_rank").cast("bigint").alias("path_rank"), F.posexplode(sums).alias("offset", "e"))
    return p.select(*KEYS, "path_rank", F.col("offset").cast("bigint").alias("offset"), r6("e").alias("cumulative_error"))


view("v_factual", f"SELECT a.seed, a.clip_id, a.anchor, list(abs(r.post_belief_hr_bpm - g.gt) ORDER BY r.hop_idx) AS errs, list(r.executed_action ORDER BY r.hop_idx) AS acts FROM v_anchor a JOIN v_replay r ON r.method_id = 'tabled_seed' || a.seed AND r.clip_id = a.clip_id AND r.hop_idx BETWEEN a.anchor AND a.anchor + {WINDOW - 1} JOIN v_given g ON g.seed = a.seed AND g.clip_id = r.clip_id AND g.hop_idx = r.hop_idx GROUP BY 1, 2, 3")
view("v_repeated", f"""SELECT c.seed, c.clip_id, c.anchor, c.total, c.errs, c.pol, c.corrected, f.errs AS ferrs, list_transform(list_zip(f.errs, c.errs), lambda z: z[1] - z[2]) AS gains FROM v_corr8 c JOIN v_factual f ON f.seed = c.seed AND f.clip_id = c.clip_id AND f.anchor = c.anchor WHERE off = {WINDOW - 1} AND len(list_filter(corrected, lambda x: x)) >= 2
  QUALIFY row_number() OVER (PARTITION BY c.seed, c.clip_id, c.anchor ORDER BY total, err, seq) = 1""")


def factual_windows(spark, sf, branches=False):
    """Factual errors and actions over the labelled hops of each anchor's window, and over all its hops which are free and what is proposed.

    With ``branches`` also ``bs``: those of the anchors in the window, as (hop, beliefs by
    (offset, action)).  Replays, labels and branches are laid side by side by (seed, clip).
    ``last`` is the clip's last hop, or one so far ahead that every hop of the window
    has a whole window of its own.
    """
    t = traces(spark, sf).where("clip_id IS NOT NULL").selectExpr("seed", "clip_id", "hop_idx", "post_belief_hr_bpm AS belief", "executed_action", "proposed_action", "previous_action IS NULL OR pre_hold_count >= 2 AS is_free")
    tables = {"t": t, "l": truth(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in roles.RANDOM_SEEDS])))}
    columns = {"ts": ("collect_list(t)", WINDOW - 1), "ls": ("collect_list(l)", WINDOW - 1), "last": ("max(if(t IS NOT NULL, hop_idx, NULL))", 2 * WINDOW - 2)}
    if branches:
        tables["b"] = branch_windows(spark, sf).select("seed", "clip_id", F.col("anchor").alias("hop_idx"), "belief")
        columns["bs"] = ("collect_list(b)", WINDOW - 1)
    rows = ahead(tables, ["seed", "clip_id"], "hop_idx", columns).where(f"t.is_free AND last + 1 - hop_idx >= {WINDOW}")
    w = "filter(transform(ts, (x, o) -> named_struct('abs_error_bpm', abs(x.belief - get(ls.gt, o)), 'executed_action', x.executed_action)), x -> x.abs_error_bpm IS NOT NULL)"
    more = ["bs", F.col("ls.gt").alias("gts")] if branches else []
    rows = rows.select("seed", "clip_id", F.col("hop_idx").alias("anchor"), F.expr(w).alias("w"), "ts", "last", *more).where("size(w) > 0")
    return rows.select(*KEYS, F.col("w.abs_error_bpm").alias("ferrors"), F.col("w.executed_action").alias("factions"), F.col("ts.is_free").alias("ffree"), F.col("ts.proposed_action").alias("fproposed"), "last", *(["bs", "gts"] if branches else []))


#: Paths with two corrections or more, and the best of them.
REPEATED = "filter(paths, p -> size(filter(p.corrected, c -> c)) >= 2)"
BEST_REPEATED = "array_min(transform(many, p -> named_struct('total', p.total, 'endpoint', element_at(p.errors, -1), 'seq', p.seq, 'errors', p.errors, 'corrected', p.corrected, 'policy', p.policy)))"


def repeated_best(spark, sf):
    """Number of paths with two corrections or more and the best of them, of the anchors that have any."""
    many = survivors(spark, sf).select(*KEYS, F.expr(REPEATED).alias("many")).where("size(many) > 0")
    return many.select(*KEYS, F.expr("cast(size(many) AS bigint)").alias("n"), F.expr(BEST_REPEATED).alias("r"))


def repeated_paths(spark, sf):
    best = repeated_best(spark, sf).select(*KEYS, "r.*")
    return best.join(factual_windows(spark, sf), list(KEYS)).withColumn("gains", F.zip_with("ferrors", "errors", lambda a, b: a - b))


@query("w08_recovery_class", """SELECT seed, clip_id, anchor, CASE WHEN NOT list_contains(ahead, FALSE) THEN 'better_throughout' WHEN NOT list_contains(ahead, TRUE) THEN 'never_better'
  WHEN ahead[1] AND NOT list_contains(ahead[list_position(ahead, FALSE):], TRUE) AND gains[-1] < -1e-6 THEN 'briefly_better_then_ends_worse'
  WHEN NOT ahead[1] AND NOT list_contains(ahead[list_position(ahead, TRUE):], FALSE) THEN 'only_ends_better_late' ELSE 'mixed_intermittent' END AS recovery
  FROM (SELECT *, list_transform(gains, lambda g: g > 1e-6) AS ahead FROM v_repeated)""")
def recovery(spark, sf):
    return repeated_paths(spark, sf).select("seed", "clip_id", "anchor", se.recovery_class(F.col("gains")).alias("recovery"))


view("v_singles", f"""SELECT a.seed, a.clip_id, a.anchor, o.i AS off, b.branch_action, b.berrs[{WINDOW} - o.i] AS endpoint,
  (CASE WHEN o.i = 0 THEN 0.0::DOUBLE ELSE list_reduce(f.errs[1:o.i], lambda x, y: x + y) END) + list_reduce(b.berrs[1:{WINDOW} - o.i], lambda x, y: x + y) AS total
  FROM v_anchor a CROSS JOIN (SELECT range AS i FROM range({WINDOW})) o JOIN v_factual f ON f.seed = a.seed AND f.clip_id = a.clip_id AND f.anchor = a.anchor JOIN v_branch_errs b ON b.seed = a.seed AND b.clip_id = a.clip_id AND b.anchor = a.anchor + o.i
  WHERE b.branch_action <> f.acts[o.i + 1]""")


@query("j11_best_single_correction", """SELECT s.seed, s.clip_id, s.anchor, s.off AS best_offset, s.branch_action AS best_action, round(s.total, 6) AS best_total, round(s.endpoint, 6) AS endpoint, round(list_sum(f.errs) - s.total, 6) + 0 AS gain
  FROM (SELECT * FROM v_singles QUALIFY row_number() OVER (PARTITION BY seed, clip_id, anchor ORDER BY total, endpoint, off, branch_action) = 1) s JOIN v_factual f ON f.seed = s.seed AND f.clip_id = s.clip_id AND f.anchor = s.anchor""")
def best_single(spark, sf):
    return singles(spark, sf).where("best IS NOT NULL").select("seed", "clip_id", "anchor", F.col("best.off").cast("bigint").alias("best_offset"), F.col("best.branch_action").alias("best_action"), r6("best.total").alias("best_total"),
                                     r6("best.endpoint").alias("endpoint"), (r6(F.col("factual_total") - F.col("best.total")) + 0).alias("gain"))


def singles(spark, sf):
    """Factual window of each anchor with its best immediate action and its best one-time correction:
    factual errors before it, errors of the branches of the corrected hop from it on, as far as
    labels reach.  Without a label on its own hop a branch is none; one that ends early has no
    endpoint and comes behind those with one."""
    f = factual_windows(spark, sf, branches=True)
    at = f"transform(filter(bs, b -> get(gts, cast(b.hop_idx - anchor AS int)) IS NOT NULL), b -> named_struct('belief', b.belief, 'off', cast(b.hop_idx - anchor AS int), 'before', {ADD.format('slice(ferrors, 1, cast(b.hop_idx - anchor AS int))')}))"
    errors = f"transform(slice(c.belief, 1, cast({REACH.format('gts', 'c.off', WINDOW)} AS int)), (v, k) -> abs(v[a] - get(gts, c.off + k)))"
    of_action = f"transform(array({errors}), e -> named_struct('total', c.before + {ADD.format('e')}, 'endpoint', if(size(e) = {WINDOW} - c.off, element_at(e, -1), double('Infinity')), 'off', c.off, 'branch_action', cast(a AS bigint), 'immediate', e[0]))[0]"
    options = f"flatten(transform({at}, c -> transform(filter(sequence(0, {CH - 1}), a -> a <> get(factions, c.off)), a -> {of_action})))"
    immediate = "if(gts[0] IS NULL, NULL, array_min(transform(filter(bs, b -> b.hop_idx = anchor)[0].belief[0], (v, a) -> named_struct('error', abs(v - gts[0]), 'branch_action', cast(a AS bigint)))))"
    # only a struct's own order needs a number there
    none = lambda c: F.when(c.isNotNull(), c.withField("endpoint", F.nullif(c["endpoint"], F.lit(float("inf")))))
    s = f.withColumn("options", F.expr(options)).withColumns({
        "best": none(F.expr("array_min(options)")), "same": none(F.expr("array_min(filter(options, o -> o.off = 0))")), "immediate": F.expr(immediate),
        "factual_total": F.expr(ADD.format("ferrors")), "factual_first": F.expr("ferrors[0]")})
    return s.drop("options", "bs", "gts")


@query("a17_anchor_analysis", f"""SELECT b.seed, b.clip_id, b.anchor, b.off AS best_single_offset, round((list_sum(f.errs) - b.total) / {WINDOW}, 6) + 0 AS best_single_gain, s.branch_action AS same_anchor_action,
  CAST(s.imm - f.errs[1] > 1e-6 AND (list_sum(f.errs) - s.total) / {WINDOW} > 1e-6 AS INTEGER) AS same_step_reversal, r.clip_id IS NOT NULL AS repeated_available,
  round((b.total - r.total) / {WINDOW}, 6) + 0 AS repeated_gain_vs_best_single
  FROM (SELECT * FROM v_singles QUALIFY row_number() OVER (PARTITION BY seed, clip_id, anchor ORDER BY total, endpoint, off, branch_action) = 1) b JOIN v_factual f ON f.seed = b.seed AND f.clip_id = b.clip_id AND f.anchor = b.anchor
  JOIN (SELECT s.*, x.err AS imm FROM v_singles s JOIN v_branch x ON x.seed = s.seed AND x.clip_id = s.clip_id AND x.anchor = s.anchor AND x.branch_action = s.branch_action AND x.off = 0 WHERE s.off = 0 QUALIFY row_number() OVER (PARTITION BY s.seed, s.clip_id, s.anchor ORDER BY total, endpoint, s.branch_action) = 1) s ON s.seed = b.seed AND s.clip_id = b.clip_id AND s.anchor = b.anchor
  LEFT JOIN v_repeated r ON r.seed = b.seed AND r.clip_id = b.clip_id AND r.anchor = b.anchor""")
def anchor_analysis(spark, sf):
    s = singles(spark, sf).where("same IS NOT NULL")
    r = repeated_best(spark, sf).select(*KEYS, F.col("r.total").alias("rtotal"))
    ft = F.col("factual_total")
    return s.join(r, ["seed", "clip_id", "anchor"], "left").select(
        "seed", "clip_id", "anchor", F.col("best.off").cast("bigint").alias("best_single_offset"), (r6((ft - F.col("best.total")) / WINDOW) + 0).alias("best_single_gain"), F.col("same.branch_action").alias("same_anchor_action"),
        ((F.col("same.immediate") - F.col("factual_first") > 1e-6) & ((ft - F.col("same.total")) / WINDOW > 1e-6)).cast("int").alias("same_step_reversal"),
        F.col("rtotal").isNotNull().alias("repeated_available"), (r6((F.col("best.total") - F.col("rtotal")) / WINDOW) + 0).alias("repeated_gain_vs_best_single"))


@query("a18_regret_rates", """SELECT seed, horizon, sum(hit) AS numerator, count(*) AS denominator, round(any_value(e), 6) AS subject_weighted FROM (SELECT seed, horizon, clip_id, CAST(factual_error - best_error > 1e-6 AS INTEGER) AS hit FROM v_regret)
  JOIN (SELECT seed, horizon, avg(s) AS e FROM (SELECT seed, horizon, subject_id, avg(m) AS s FROM (SELECT seed, horizon, clip_id, avg(CAST(factual_error - best_error > 1e-6 AS INTEGER)) AS m FROM v_regret GROUP BY 1, 2, 3) JOIN v_clips USING (clip_id) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (seed, horizon) GROUP BY 1, 2""")
def regret_rates(spark, sf):
    hit = (F.col("factual_error") - F.col("best_error") > 1e-6).cast("int")
    clip = regrets(spark, sf).groupBy("seed", "horizon", "clip_id").agg(F.sum(hit).alias("num"), F.count(F.lit(1)).alias("den"))
    s = clip.join(roles.clips(spark, sf).select("clip_id", "subject_id"), "clip_id").groupBy("seed", "horizon", "subject_id").agg(
        F.avg(F.col("num") / F.col("den")).alias("m"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    return s.groupBy("seed", "horizon").agg(F.sum("num").alias("numerator"), F.sum("den").alias("denominator"), r6(F.avg("m")).alias("subject_weighted"))


view("v_stored_in", "SELECT w.clip_id, w.hop_idx, 0 AS m, w.hr, w.conf, w.ppr, w.cov, b.action AS given, 'tabled' AS family, CAST(NULL AS DOUBLE) AS top FROM v_beam_best b JOIN v_wide w ON w.clip_id = b.clip_id AND w.hop_idx = b.hop_idx")
view("v_stored_steps", STEPS.format(given="v_stored_in", steps="v_stored_steps"))


@query("k10_sequence_replay", """SELECT count(*) AS compared, count(*) FILTER (s.clip_id IS NULL OR b.clip_id IS NULL OR s.executed <> b.action OR abs(s.mean - b.post_belief_hr_bpm) > 1e-12) AS mismatched
  FROM v_beam_best b FULL JOIN (SELECT * FROM v_stored_steps WHERE hop_idx >= 0) s ON s.clip_id = b.clip_id AND s.hop_idx = b.hop_idx""")
def sequence_replay(spark, sf):
    """Replay the beam's stored actions from a fresh state and compare every hop at 1e-12."""
    hops = common.labelled_hops(spark, sf)
    stored = rp.beam(hops, 8)
    again = rp.replay(hops.join(stored.select("clip_id", "hop_idx", F.col("executed_action").alias("stored_action")), ["clip_id", "hop_idx"]), [rp.proposal_selector("stored_action", "stored")])
    from windfold.operators.score import compare
    cols = ["clip_id", "hop_idx", "executed_action", "post_belief_hr_bpm", "post_hold_count"]
    c = compare(stored.select(*cols), again.select(*cols), ["clip_id", "hop_idx"])
    off = (F.col("presence") != "joined") | (F.abs(F.col("l.post_belief_hr_bpm") - F.col("r.post_belief_hr_bpm")) > 1e-12) | (F.col("l.executed_action") != F.col("r.executed_action")) | (F.col("l.post_hold_count") != F.col("r.post_hold_count"))
    return c.agg(F.count(F.lit(1)).alias("compared"), co.count_if(off).alias("mismatched"))


@query("t04_best_single_tuple", "SELECT seed, clip_id, anchor, round(total, 6) AS total, off AS \"offset\", branch_action FROM v_singles QUALIFY row_number() OVER (PARTITION BY seed, clip_id, anchor ORDER BY total, endpoint, off, branch_action) = 1")
def best_tuple(spark, sf):
    return singles(spark, sf).where("best IS NOT NULL").select("seed", "clip_id", "anchor", r6("best.total").alias("total"), F.col("best.off").cast("bigint").alias("offset"), F.col("best.branch_action").alias("branch_action"))
