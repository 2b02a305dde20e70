"""Ranking screens, reshapes, sharding and diagnostics (R, W4-W9, T6-T8, B4, B9-B14, A19-A22)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windfold.functions import columns as col
from windfold.functions.columns import r6
from windfold.operators import boosting as bo
from windfold.operators import constraints as co
from windfold.operators import resample as rs
from windfold.operators import screen as sn
from windfold.operators import selection as se
from windfold.operators.windows import hop_count, numbered
from windfold.plans import common
from windfold.plans.branching import CH, ordered, trace, what_if
from windfold.plans.registry import query, view
from windfold.plans.scores import clip_table
from windfold.session import cut_lineage
from windfold.sources import roles

t = roles.table

# --- reshapes ---------------------------------------------------------------------------


@query("r03_content_ids", """SELECT count(*) AS rows_total, count(DISTINCT (user_id, event_type)) AS distinct_ids FROM events""")
def content_ids(spark, sf):
    """Ids from content: equal content, equal id; different content, different id."""
    e = t(spark, sf, "events").select("user_id", "event_type").withColumn("id", col.content_id("key-", ["user_id", "event_type"]))
    per = e.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows_total"), F.count(F.lit(1)).alias("distinct_ids"))


@query("r04_state_digest", """SELECT clip_id, hop_idx, sha256(executed_action || '|' || post_hold_count || '|' || clip_id || '|' || (hop_idx + 1)) AS state_digest FROM v_replay WHERE method_id = 'tabled_seed0'""")
def state_digest(spark, sf):
    r = trace(spark, sf)
    return r.select("clip_id", "hop_idx", col.digest(F.col("executed_action"), F.col("post_hold_count"), F.col("clip_id"), F.col("hop_idx") + 1).alias("state_digest"))


view("v_agree", """SELECT a.clip_id, a.hop_idx, a.roi_index, CASE WHEN a.valid AND count(b.roi_index) > 0 THEN count(*) FILTER (abs(a.hr_bpm - b.hr_bpm) <= 5) / count(b.roi_index) ELSE 0 END AS agreement
  FROM v_meas a LEFT JOIN v_meas b ON b.clip_id = a.clip_id AND b.hop_idx = a.hop_idx AND b.roi_index <> a.roi_index AND b.valid GROUP BY a.clip_id, a.hop_idx, a.roi_index, a.valid""")
view("v_obs", """SELECT r.clip_id, r.hop_idx, m.roi_index, m.valid, m.coverage, m.confidence, m.ppr, m.hr_bpm, g.agreement, r.pre_belief_hr_bpm AS mean, r.pre_p00, r.pre_velocity, r.pre_since_confident AS since, r.previous_action AS prev, r.pre_hold_count AS hold
  FROM v_replay r JOIN v_meas m ON m.clip_id = r.clip_id AND m.hop_idx = r.hop_idx JOIN v_agree g ON g.clip_id = m.clip_id AND g.hop_idx = m.hop_idx AND g.roi_index = m.roi_index WHERE r.method_id = 'tabled_seed0'""")
view("v_obs_long", """SELECT clip_id, hop_idx, 7 * roi_index + k.range AS pos, CASE k.range WHEN 0 THEN (coalesce(hr_bpm, mean) - 90) / 40 WHEN 1 THEN (coalesce(hr_bpm, mean) - mean) / 40
    WHEN 2 THEN CASE WHEN valid THEN least(greatest(confidence, 0), 1) ELSE 0 END WHEN 3 THEN CASE WHEN valid THEN least(greatest(ppr, 0), 1) ELSE 0 END WHEN 4 THEN least(greatest(coverage, 0), 1) WHEN 5 THEN agreement ELSE CASE WHEN valid THEN 1 ELSE 0 END END AS v
  FROM v_obs CROSS JOIN range(7) k
  UNION ALL SELECT clip_id, hop_idx, 35 + k.range, CASE k.range WHEN 0 THEN (mean - 90) / 40 WHEN 1 THEN sqrt(greatest(pre_p00, 0)) / 40 WHEN 2 THEN pre_velocity / 10 WHEN 3 THEN least(since, 20) / 20.0::DOUBLE
    WHEN 9 THEN least(hold, 10) / 10.0::DOUBLE ELSE CASE WHEN coalesce(prev, -1) = k.range - 4 THEN 1 ELSE 0 END END FROM v_obs CROSS JOIN range(10) k WHERE roi_index = 0""")


def observations(spark, sf):
    r = trace(spark, sf).join(roles.hops(spark, sf), ["clip_id", "hop_idx"]).withColumn("agree", col.agreement(F.col("hr")))
    obs = col.observation(CH, F.col("hr"), F.col("confidence"), F.col("ppr"), F.col("coverage"), F.col("agree"), F.col("pre_belief_hr_bpm"), F.col("pre_p00"), F.col("pre_velocity"),
                          F.col("pre_since_confident"), F.col("previous_action"), F.col("pre_hold_count"))
    return r.select("clip_id", "hop_idx", obs.alias("obs"), "hr", "executed_action")


@query("r05_observations", "SELECT clip_id, hop_idx, pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) + 0 AS v FROM v_obs_long")
def observation_rows(spark, sf):
    o = observations(spark, sf).select("clip_id", "hop_idx", F.posexplode("obs").alias("pos", "v"))
    return o.select("clip_id", "hop_idx", F.col("pos").cast("bigint").alias("pos"), (F.round(F.col("v").cast("double"), 6) + 0).alias("v"))


def features(spark, sf):
    """Candidate rows: the channel's own 7 values, the shared tail and a one-hot of the channel."""
    o = observations(spark, sf)
    own = f"concat(slice(obs, 7 * roi_index + 1, 7), slice(obs, {7 * CH + 1}, {CH + 5}), transform(sequence(0, {CH - 1}), i -> cast(if(i = roi_index, 1, 0) AS float))) AS features"
    return o.selectExpr("*", f"explode(sequence(0, {CH - 1})) AS roi_index").where("hr[roi_index] IS NOT NULL").selectExpr("clip_id", "hop_idx", "roi_index", own)


@query("r06_candidate_features", f"""SELECT m.clip_id, m.hop_idx, m.roi_index, CAST({7 + CH + 5 + CH} AS BIGINT) AS width, round(s.total, 4) + 0 AS feature_sum FROM v_meas m JOIN (
  SELECT m.clip_id, m.hop_idx, m.roi_index, sum(CAST(CAST(o.v AS FLOAT) AS DOUBLE)) + 1 AS total FROM v_meas m JOIN v_obs_long o ON o.clip_id = m.clip_id AND o.hop_idx = m.hop_idx AND (o.pos BETWEEN 7 * m.roi_index AND 7 * m.roi_index + 6 OR o.pos >= 35) GROUP BY 1, 2, 3) s
  ON s.clip_id = m.clip_id AND s.hop_idx = m.hop_idx AND s.roi_index = m.roi_index WHERE m.valid""")
def candidate_features(spark, sf):
    f = features(spark, sf)
    return f.select("clip_id", "hop_idx", "roi_index", F.size("features").cast("bigint").alias("width"), (F.round(F.expr("aggregate(features, 0D, (s, x) -> s + x)"), 4) + 0).alias("feature_sum"))


view("v_rel", """SELECT clip_id, hop_idx, roi_index, CASE WHEN n > 1 THEN (pr - 1) / (n - 1) ELSE 0 END AS ppr_rank, CASE WHEN sp < 1e-9 THEN 0 ELSE (ppr - mp) / sp END AS ppr_z, CASE WHEN sh < 1e-9 THEN 0 ELSE (hr_bpm - mh) / sh END AS hr_z,
  abs(hr_bpm - med) AS hr_to_median, CASE WHEN n > 1 THEN (cr - 1) / (n - 1) ELSE 0 END AS coverage_rank, n / 5 AS valid_share, sh AS hr_std FROM (
  SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY clip_id, hop_idx ORDER BY ppr DESC, roi_index) AS pr, row_number() OVER (PARTITION BY clip_id, hop_idx ORDER BY coverage DESC, roi_index) AS cr,
    avg(ppr) OVER w AS mp, stddev_pop(ppr) OVER w AS sp, avg(hr_bpm) OVER w AS mh, stddev_pop(hr_bpm) OVER w AS sh, median(hr_bpm) OVER w AS med FROM v_meas WHERE valid WINDOW w AS (PARTITION BY clip_id, hop_idx))""")
REL = ("ppr_rank", "ppr_z", "hr_z", "hr_to_median", "coverage_rank", "valid_share", "hr_std")


@query("w04_relative_features", "SELECT clip_id, hop_idx, roi_index, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in REL) + " FROM v_rel")
def relative(spark, sf):
    return sn.relative_features(roles.hops(spark, sf), CH).select("clip_id", "hop_idx", "roi_index", *[(r6(c) + 0).alias(c) for c in REL])


@query("r07_relative_design", f"SELECT count(*) AS candidates, CAST({7 + CH + 5 + CH + 7} AS BIGINT) AS width, round(sum(ppr_rank), 4) AS ppr_rank_total FROM v_rel")
def relative_design(spark, sf):
    """Candidate features with the relative ones appended."""
    d = features(spark, sf).join(sn.relative_features(roles.hops(spark, sf), CH), ["clip_id", "hop_idx", "roi_index"])
    d = d.select(F.concat("features", F.array(*[F.col(c).cast("float") for c in REL])).alias("x"), "ppr_rank")
    return d.agg(F.count(F.lit(1)).alias("candidates"), F.max(F.size("x")).cast("bigint").alias("width"), F.round(F.sum("ppr_rank"), 4).alias("ppr_rank_total"))


# Region boxes as (x from, x to, y from, y to) shares of the face box.
BOXES = ((0.0, 1.0, 0.0, 1.0), (0.12, 0.46, 0.05, 0.36), (0.54, 0.88, 0.05, 0.36), (0.02, 0.23, 0.25, 0.5), (0.77, 0.98, 0.25, 0.5), (0.38, 0.62, 0.28, 0.7),
         (0.1, 0.44, 0.38, 0.62), (0.56, 0.9, 0.38, 0.62), (0.12, 0.42, 0.58, 0.84), (0.58, 0.88, 0.58, 0.84), (0.34, 0.66, 0.66, 0.78), (0.32, 0.68, 0.78, 0.97))
FACE = "SELECT CAST(p_partkey AS BIGINT) AS box_id, p_size * 3.7 AS x0, p_size * 2.3 AS y0, p_size * 3.7 + p_retailprice / 7 AS x1, p_size * 2.3 + p_retailprice / 5 AS y1 FROM part"


@query("r08_region_boxes", f"""SELECT box_id, roi_index, CAST(greatest(0, least(640, floor(x0 + ax * (x1 - x0)))) AS BIGINT) AS xa, CAST(greatest(0, least(480, floor(y0 + ay * (y1 - y0)))) AS BIGINT) AS ya,
  CAST(greatest(0, least(640, ceil(x0 + bx * (x1 - x0)))) AS BIGINT) AS xb, CAST(greatest(0, least(480, ceil(y0 + by_ * (y1 - y0)))) AS BIGINT) AS yb FROM ({FACE.replace('3.7', '3.7::DOUBLE').replace('2.3', '2.3::DOUBLE')})
  CROSS JOIN (VALUES {', '.join(f'({i}, {b[0]}::DOUBLE, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE)' for i, b in enumerate(BOXES))}) r(roi_index, ax, bx, ay, by_)""")
def region_boxes(spark, sf):
    box = t(spark, sf, "part").selectExpr("p_partkey AS box_id", "p_size * 3.7D AS x0", "p_size * 2.3D AS y0", "p_size * 3.7D + p_retailprice / 7 AS x1", "p_size * 2.3D + p_retailprice / 5 AS y1")
    regions = ", ".join(f"named_struct('ax', {b[0]}D, 'bx', {b[1]}D, 'ay', {b[2]}D, 'by', {b[3]}D)" for b in BOXES)
    r = box.selectExpr("*", f"posexplode(array({regions})) AS (roi_index, s)")
    edge = lambda f, o, s, e, m: f"cast(greatest(0, least({m}, {f}({o}0 + s.{s} * ({o}1 - {o}0)))) AS bigint) AS {e}"
    return r.selectExpr("box_id", "roi_index", edge("floor", "x", "ax", "xa", 640), edge("floor", "y", "ay", "ya", 480), edge("ceil", "x", "bx", "xb", 640), edge("ceil", "y", "by", "yb", 480))


@query("r10_error_deltas", "SELECT method_id, count(*) AS rows_scored, round(avg(abs_error), 4) AS mean_abs_error, round(avg(predicted - label), 4) AS mean_delta FROM v_line GROUP BY 1")
def error_deltas(spark, sf):
    return roles.line_scores(spark, sf).groupBy("method_id").agg(F.count(F.lit(1)).alias("rows_scored"), F.round(F.avg("abs_error"), 4).alias("mean_abs_error"), F.round(F.avg(F.col("predicted") - F.col("label")), 4).alias("mean_delta"))


@query("r11_prefix_subject", "SELECT split_part(p_brand, '#', 1) || split_part(p_name, ' ', 1) AS subject, count(*) AS clips FROM part GROUP BY 1")
def prefix_subject(spark, sf):
    return t(spark, sf, "part").groupBy(F.concat(F.split("p_brand", "#")[0], F.split("p_name", " ")[0]).alias("subject")).agg(F.count(F.lit(1)).alias("clips"))


# --- persistence --------------------------------------------------------------------------

view("v_vec", "SELECT clip_id, hop_idx, list(CASE WHEN valid THEN err END ORDER BY requested) AS errs, min(requested) FILTER (pos = 1) AS best FROM v_order WHERE free GROUP BY 1, 2 HAVING bool_or(valid)")
view("v_pairs", "SELECT a.clip_id, a.hop_idx, a.best, b.best AS prev_best, a.errs, b.errs AS prev_errs FROM v_vec a JOIN v_vec b ON b.clip_id = a.clip_id AND b.hop_idx = a.hop_idx - 1")


def vectors(spark, sf):
    """Free hops with a valid channel: error vector (null = invalid) and best action."""
    w = ordered(what_if(spark, sf).where("free AND exists(if_valid, v -> v)"))
    return w.selectExpr("clip_id", "hop_idx", "transform(if_error, (e, i) -> if(if_valid[i], e, NULL)) AS errs", "cast(order[0] AS bigint) AS best")


@query("w05_adjacent_pairs", "SELECT clip_id, hop_idx, best, prev_best FROM v_pairs")
def adjacent(spark, sf):
    return sn.adjacent_pairs(vectors(spark, sf), ["best"]).select("clip_id", "hop_idx", "best", "prev_best")


view("v_ranked", """SELECT clip_id, hop_idx, corr(ra, rb) AS rho FROM (
  SELECT clip_id, hop_idx, rank() OVER (PARTITION BY clip_id, hop_idx ORDER BY a) + (count(*) OVER (PARTITION BY clip_id, hop_idx, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY clip_id, hop_idx ORDER BY b) + (count(*) OVER (PARTITION BY clip_id, hop_idx, b) - 1) / 2 AS rb,
    count(*) OVER (PARTITION BY clip_id, hop_idx) AS n FROM (SELECT clip_id, hop_idx, unnest(errs) AS a, unnest(prev_errs) AS b FROM v_pairs) WHERE a IS NOT NULL AND b IS NOT NULL) WHERE n >= 3 GROUP BY 1, 2""")


@query("w06_persistence", """SELECT (SELECT round(avg(CASE WHEN best = prev_best THEN 1 ELSE 0 END), 6) FROM v_pairs) AS agreement, (SELECT round(avg(rho), 6) FROM v_ranked WHERE isfinite(rho)) AS mean_spearman,
  (SELECT count(*) FROM v_pairs) - (SELECT count(*) FROM v_ranked WHERE isfinite(rho)) AS skipped""")
def persistence(spark, sf):
    p = sn.adjacent_pairs(vectors(spark, sf), ["best", "errs"]).withColumn("rho", sn.spearman("errs", "prev_errs"))
    return p.agg(r6(F.avg((F.col("best") == F.col("prev_best")).cast("double"))).alias("agreement"), r6(F.avg("rho")).alias("mean_spearman"), (F.count(F.lit(1)) - F.count("rho")).alias("skipped"))


@query("b09_chance_agreement", "SELECT round(sum(p * p), 6) AS chance FROM (SELECT count(*) / (SELECT count(*) FROM v_vec) AS p FROM v_vec GROUP BY best)")
def chance(spark, sf):
    n = vectors(spark, sf).groupBy("best").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(r6(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))


REPEATS = 20


@query("b10_shuffle_control", f"""SELECT repeat, round(avg(CASE WHEN best = pb THEN 1 ELSE 0 END), 6) AS agreement, round(avg(CASE WHEN best = pb AND abs(hop_idx - ph) = 1 THEN 1.0::DOUBLE WHEN abs(hop_idx - ph) = 1 THEN 0 END), 6) AS matched_agreement, count(*) AS pairs FROM (
  SELECT repeat, clip_id, hop_idx, best, lag(best) OVER w AS pb, lag(hop_idx) OVER w AS ph FROM (SELECT r.range AS repeat, v.*, CAST('0x' || substr(md5('8101|' || r.range || '|' || clip_id || '|' || hop_idx), 1, 8) AS BIGINT) AS d FROM v_vec v CROSS JOIN range({REPEATS}) r)
  WINDOW w AS (PARTITION BY repeat, clip_id ORDER BY d, hop_idx)) WHERE pb IS NOT NULL GROUP BY 1""")
def shuffle_control(spark, sf):
    """Shuffled neighbours, all of them (faithful) and only those one hop apart (matched)."""
    p = sn.shuffled_pairs(vectors(spark, sf).select("clip_id", "hop_idx", "best"), REPEATS, rs.SEED, ["best", "hop_idx"]).where("prev_best IS NOT NULL")
    same = (F.col("best") == F.col("prev_best")).cast("double")
    return p.groupBy(F.col("repeat").cast("bigint").alias("repeat")).agg(r6(F.avg(same)).alias("agreement"), r6(F.avg(F.when(F.abs(F.col("hop_idx") - F.col("prev_hop_idx")) == 1, same))).alias("matched_agreement"), F.count(F.lit(1)).alias("pairs"))


# --- folds, shuffled targets, arms ---------------------------------------------------------

view("v_sub_n", "SELECT subject_id, count(*) AS n FROM v_vec JOIN v_clips USING (clip_id) GROUP BY 1")
view("v_sub_o", "SELECT *, row_number() OVER (ORDER BY n DESC, subject_id) AS no FROM v_sub_n")
view("v_fold", """SELECT CAST(0 AS BIGINT) AS no, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS VARCHAR) AS subject_id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS fold
  UNION ALL SELECT o.no, list_transform(f.load, lambda x, i: CASE WHEN i = list_position(f.load, list_min(f.load)) THEN x + o.n ELSE x END), o.subject_id, o.n, list_position(f.load, list_min(f.load)) - 1 FROM v_fold f JOIN v_sub_o o ON o.no = f.no + 1""")


def subject_sizes(spark, sf):
    v = vectors(spark, sf).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    return v.join(roles.clips(spark, sf), "clip_id").groupBy("subject_id").agg(F.sum("n").alias("n"))


@query("b12_subject_folds", "SELECT subject_id, n, fold FROM v_fold WHERE no > 0")
def folds(spark, sf):
    return sn.subject_folds(subject_sizes(spark, sf), 5).select("subject_id", "n", F.col("fold").cast("bigint").alias("fold"))


@query("b11_shuffled_targets", """WITH d AS (SELECT v.clip_id, v.hop_idx, v.best, c.view, CAST('0x' || substr(md5('taker|8101|' || v.clip_id || '|' || v.hop_idx), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5('donor|8101|' || v.clip_id || '|' || v.hop_idx), 1, 8) AS BIGINT) AS b FROM v_vec v JOIN v_clips c USING (clip_id)),
  x AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY a, clip_id, hop_idx) AS na, row_number() OVER (PARTITION BY view ORDER BY b, clip_id, hop_idx) AS nb FROM d)
  SELECT p.clip_id, p.hop_idx, p.best, q.best AS shuffled_best FROM x p JOIN x q ON q.view = p.view AND q.nb = p.na""")
def shuffled_targets(spark, sf):
    """Rows are numbered as takers and as donors, and counted for both; they are made once, in the shared folder."""
    v = cut_lineage(vectors(spark, sf).select("clip_id", "hop_idx", "best").join(roles.clips(spark, sf).select("clip_id", "view"), "clip_id"))
    return sn.permute_within(v, "view", ["clip_id", "hop_idx"], ["best"], rs.SEED).select("clip_id", "hop_idx", "best", "shuffled_best")


view("v_arms", """SELECT a.arm, w.clip_id, w.hop_idx, w.requested AS chosen, w.err - o.err AS regret, w.pos = 1 AS top1, w.pos <= 3 AND w.valid AS top3 FROM v_order w JOIN v_order o ON o.clip_id = w.clip_id AND o.hop_idx = w.hop_idx AND o.pos = 1
  JOIN (SELECT clip_id, hop_idx, min(requested) FILTER (valid) AS first_valid FROM v_order GROUP BY 1, 2) f ON f.clip_id = w.clip_id AND f.hop_idx = w.hop_idx
  CROSS JOIN (VALUES ('majority'), ('factual'), ('oracle')) a(arm) WHERE w.free AND o.valid AND w.requested = CASE a.arm WHEN 'majority' THEN f.first_valid WHEN 'factual' THEN w.factual_executed ELSE o.requested END""")


def arms(spark, sf):
    """Choices of each arm looked up in the error array; regret against the best valid action."""
    w = ordered(what_if(spark, sf).where("free AND exists(if_valid, v -> v)"))
    first = "array_position(if_valid, true) - 1"
    a = w.selectExpr("*", f"explode(array(named_struct('arm', 'majority', 'chosen', cast({first} AS int)), named_struct('arm', 'factual', 'chosen', cast(executed_action AS int)), named_struct('arm', 'oracle', 'chosen', cast(order[0] AS int)))) AS c")
    return a.selectExpr("c.arm", "clip_id", "hop_idx", "c.chosen", "if_error[c.chosen] - if_error[order[0]] AS regret", "array_position(order, c.chosen) = 1 AS top1", "array_position(order, c.chosen) <= 3 AND if_valid[c.chosen] AS top3")


@query("b14_arm_scores", "SELECT arm, clip_id, hop_idx, chosen, round(regret, 6) + 0 AS regret, top1, top3 FROM v_arms")
def arm_scores(spark, sf):
    return arms(spark, sf).select("arm", "clip_id", "hop_idx", F.col("chosen").cast("bigint").alias("chosen"), (r6("regret") + 0).alias("regret"), "top1", "top3")


@query("a19_arm_report", """SELECT arm, round(any_value(m), 6) + 0 AS mean_regret, round(avg(CASE WHEN top1 THEN 1 ELSE 0 END), 6) AS top1_rate, round(avg(CASE WHEN top3 THEN 1 ELSE 0 END), 6) AS top3_rate, count(*) AS hops, count(DISTINCT clip_id) AS clips,
  count(*) FILTER (chosen = 0) AS chosen_0, count(*) FILTER (chosen = 4) AS chosen_4 FROM v_arms JOIN (SELECT arm, avg(r) AS m FROM (SELECT arm, clip_id, avg(regret) AS r FROM v_arms GROUP BY 1, 2) GROUP BY 1) USING (arm) GROUP BY 1""")
def arm_report(spark, sf):
    clip = arms(spark, sf).groupBy("arm", "clip_id").agg(F.avg("regret").alias("r"), F.sum(F.col("top1").cast("int")).alias("t1"), F.sum(F.col("top3").cast("int")).alias("t3"), F.count(F.lit(1)).alias("n"),
                                                         co.count_if(F.col("chosen") == 0).alias("c0"), co.count_if(F.col("chosen") == 4).alias("c4"))
    return clip.groupBy("arm").agg((r6(F.avg("r")) + 0).alias("mean_regret"), r6(F.sum("t1") / F.sum("n")).alias("top1_rate"), r6(F.sum("t3") / F.sum("n")).alias("top3_rate"), F.sum("n").alias("hops"), F.count(F.lit(1)).alias("clips"),
                                   F.sum("c0").alias("chosen_0"), F.sum("c4").alias("chosen_4"))


BR = rs.REPLICATES


@query("b04_regret_bootstrap", f"""WITH s AS (SELECT arm, subject_id, sum(r) AS total, count(*) AS clips FROM (SELECT arm, clip_id, avg(regret) AS r FROM v_arms GROUP BY 1, 2) JOIN v_clips USING (clip_id) GROUP BY 1, 2),
  n AS (SELECT subject_id, row_number() OVER (ORDER BY md5(subject_id), subject_id) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM s)),
  d AS (SELECT r.range AS replicate, CAST('0x' || substr(md5('8101|' || r.range || '|' || n.ix), 1, 8) AS BIGINT) % n.n AS ix FROM range({BR}) r CROSS JOIN n),
  e AS (SELECT s.arm, d.replicate, sum(s.total) / sum(s.clips) AS est FROM d JOIN n ON n.ix = d.ix JOIN s ON s.subject_id = n.subject_id GROUP BY 1, 2)
  SELECT arm, round(quantile_cont(est, 0.025), 6) + 0 AS lower, round(quantile_cont(est, 0.975), 6) + 0 AS upper FROM e GROUP BY 1""")
def regret_bootstrap(spark, sf):
    clip = arms(spark, sf).groupBy("arm", "clip_id").agg(F.avg("regret").alias("r")).join(roles.clips(spark, sf).select("clip_id", "subject_id"), "clip_id")
    b = rs.bootstrap(rs.subject_sums(clip, "r", ["arm"]), BR, rs.SEED, methods=["arm"])
    return b.groupBy("arm").agg(rs.linear_interval(F.col("estimate")).alias("ci")).select("arm", (r6(F.col("ci")[0]) + 0).alias("lower"), (r6(F.col("ci")[1]) + 0).alias("upper"))


FOLDS = 5
WIDTH = 7 + CH + 5 + CH


def probe_hops(spark, sf, folds=FOLDS):
    """Free hops with a valid channel: errors by channel, the fold of their subject, and for each fold that trains on them another hop's errors."""
    # replayed once: its rows are read for the folds' sizes, for their ranges and for the hops
    w = cut_lineage(what_if(spark, sf).where("free AND exists(if_valid, v -> v)").select("clip_id", "hop_idx", "if_error", "if_valid"))
    sizes = w.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).join(roles.clips(spark, sf), "clip_id")
    fold = sn.subject_folds(sizes.groupBy("subject_id").agg(F.sum("n").alias("n")), folds).select("subject_id", "fold")
    fold = fold.join(roles.clips(spark, sf).select("clip_id", "subject_id"), "subject_id").select("clip_id", "fold")
    hops = cut_lineage(w.join(fold, "clip_id"))
    train = hops.select("clip_id", "hop_idx", "if_error", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))).alias("train"))
    other = sn.permute_within(train, "train", ["clip_id", "hop_idx"], ["if_error"], rs.SEED)
    other = other.groupBy("clip_id", "hop_idx").agg(F.map_from_entries(F.collect_list(F.struct("train", "shuffled_if_error"))).alias("other"))
    return hops.join(other, ["clip_id", "hop_idx"])


def probe_choices(spark, sf, folds=FOLDS, settings=bo.Boosting()):
    """Choice of each arm at each hop: the channel whose error the model of its fold predicts to be the least.

    The folds' models for the true errors and for the shuffled ones are grown together.
    """
    hops = cut_lineage(probe_hops(spark, sf, folds))
    real = [F.when(F.col("fold") != k, F.col("if_error")[F.col("roi_index")]) for k in range(folds)]
    shuffled = [F.try_element_at("other", F.lit(k))[F.col("roi_index")] for k in range(folds)]
    rows = features(spark, sf).join(hops, ["clip_id", "hop_idx"]).withColumn("targets", F.array(*real, *shuffled))
    p = bo.boosted(rows, ["clip_id", "hop_idx", "roi_index"], "features", "targets", WIDTH, 2 * folds, settings).join(hops.select("clip_id", "hop_idx", "fold", "if_error", "if_valid"), ["clip_id", "hop_idx"])
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col("predictions")[F.col("fold") + at].alias("predicted")) for a, at in (("probe", 0), ("shuffled", folds))])).alias("a")
    p = p.select("clip_id", "hop_idx", "fold", "roi_index", "if_error", "if_valid", arm)
    best = F.expr("array_min(transform(if_error, (e, i) -> if(if_valid[i], e, NULL)))")
    picks = p.groupBy("a.arm", "fold", "clip_id", "hop_idx").agg(F.min(F.struct("a.predicted", "roi_index", F.col("if_error")[F.col("roi_index")].alias("error"))).alias("c"), F.first(best).alias("best"))
    return picks.select("arm", "fold", "clip_id", "hop_idx", F.col("c.roi_index").alias("chosen"), (F.col("c.error") - F.col("best")).alias("regret"))


@query("b13_boosted_trees")
def boosted_trees(spark, sf):
    """Subject-grouped cross-validation of boosted trees for the channel error: regret of their choices by arm and fold."""
    p = probe_choices(spark, sf)
    return p.groupBy("arm", F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("hops"), r6(F.avg("regret")).alias("mean_regret"), r6(F.avg((F.col("regret") == 0).cast("double"))).alias("top1_rate"))


# --- sharding, order, top-k, diagnostics ----------------------------------------------------


@query("w09_subject_shards", "SELECT subject_id, (row_number() OVER (ORDER BY subject_id) - 1) % 4 AS shard FROM (SELECT DISTINCT subject_id FROM v_clips)")
def shards(spark, sf):
    """Sorted subjects in strides."""
    ranked = numbered(roles.clips(spark, sf).select("subject_id").distinct(), [F.col("subject_id")], "ix")
    return ranked.select("subject_id", (F.col("ix") % 4).alias("shard"))


@query("t06_sorted_output", "SELECT method_id, subject_id, round(mae, 6) AS mae FROM v_line_subject")
def sorted_output(spark, sf):
    from windfold.plans.scores import line_clip
    return line_clip(spark, sf).groupBy("method_id", "subject_id").agg(r6(F.avg("mae")).alias("mae")).orderBy("method_id", "subject_id")


@query("t07_first_subjects", "SELECT subject_id, count(*) AS clips FROM v_clips GROUP BY 1 ORDER BY subject_id LIMIT 5 OFFSET 2")
def first_subjects(spark, sf):
    return roles.clips(spark, sf).groupBy("subject_id").agg(F.count(F.lit(1)).alias("clips")).orderBy("subject_id").offset(2).limit(5)


@query("t08_worst_clips", """SELECT clip_id, round(mae, 6) AS mae_bpm FROM (SELECT *, row_number() OVER (ORDER BY mae DESC, clip_id) AS rn, count(*) OVER () AS n FROM (SELECT clip_id, avg(abs_error_bpm) AS mae FROM v_scored WHERE method_id = 'max_ppr' GROUP BY 1)) WHERE rn <= (n + 9) // 10""")
def worst_clips(spark, sf):
    """Worst tenth of all clips, rounded up."""
    clips = common.scored(spark, sf, ["max_ppr"]).groupBy("clip_id").agg(F.avg("abs_error_bpm").alias("mae"))
    return clips.orderBy(F.desc("mae"), "clip_id").limit((clips.count() + 9) // 10).select("clip_id", r6("mae").alias("mae_bpm"))


@query("a20_extraction_audit", """SELECT h.*, t.trimmed_rows, CASE WHEN h.invalid_values > 0 THEN 'still_failed' WHEN t.trimmed_rows > 0 THEN 'repaired' ELSE 'clean' END AS classification FROM (
  SELECT clip_id, count(*) AS hops, sum(bad) AS invalid_values, min(hop_idx) FILTER (bad > 0) AS first_failure FROM (SELECT clip_id, hop_idx, count(*) FILTER (NOT valid) AS bad FROM v_meas GROUP BY 1, 2) GROUP BY 1) h
  JOIN (SELECT clip_id, count(*) - coalesce(max(CASE WHEN k >= 5 THEN frame_idx END) + 1, 0) AS trimmed_rows FROM v_frames GROUP BY 1) t USING (clip_id)""")
def extraction_audit(spark, sf):
    """A clip with any invalid value has failed; one that needed its tail trimmed is repaired."""
    from windfold.plans.checks import terminal_trim
    h = roles.hops(spark, sf).select("clip_id", "hop_idx", F.size(F.filter("hr", lambda v: v.isNull())).cast("bigint").alias("bad"))
    h = h.groupBy("clip_id").agg(F.count(F.lit(1)).alias("hops"), F.sum("bad").alias("invalid_values"), F.min(F.when(F.col("bad") > 0, F.col("hop_idx"))).alias("first_failure"))
    trim = terminal_trim(spark, sf).select("clip_id", F.coalesce("trimmed_rows", "original_rows").alias("trimmed_rows"))
    return h.join(trim, "clip_id").withColumn("classification", F.when(F.col("invalid_values") > 0, "still_failed").when(F.col("trimmed_rows") > 0, "repaired").otherwise("clean"))


view("v_range", """SELECT m.clip_id, m.hop_idx, l.gt_hr_bpm AS gt, min(hr_bpm) AS lo, max(hr_bpm) AS hi FROM v_meas m JOIN v_labels l ON l.clip_id = m.clip_id AND l.hop_idx = m.hop_idx AND l.valid WHERE m.valid GROUP BY 1, 2, 3""")


@query("a21_extreme_range", """SELECT count(*) FILTER (gt < lo) AS below, count(*) FILTER (gt BETWEEN lo AND hi) AS inside, count(*) FILTER (gt > hi) AS above, round(avg(miss), 6) AS mean_miss, round(quantile_cont(miss, 0.5), 6) AS median_miss, round(quantile_cont(miss, 0.9), 6) AS p90_miss, round(max(miss), 6) AS max_miss
  FROM (SELECT *, CASE WHEN gt < lo THEN lo - gt WHEN gt > hi THEN gt - hi END AS miss FROM v_range)""")
def extreme_range(spark, sf):
    """Quantiles are exact and come from counting digits, not from a sort."""
    h = common.labelled_hops(spark, sf).selectExpr("gt_hr_bpm AS gt", "array_min(hr) AS lo", "array_max(hr) AS hi").where("lo IS NOT NULL")
    m = h.withColumn("miss", F.expr("CASE WHEN gt < lo THEN lo - gt WHEN gt > hi THEN gt - hi END"))
    counts = cut_lineage(m.agg(co.count_if(F.col("gt") < F.col("lo")).alias("below"), co.count_if(F.col("gt").between(F.col("lo"), F.col("hi"))).alias("inside"), co.count_if(F.col("gt") > F.col("hi")).alias("above"),
                               r6(F.avg("miss")).alias("mean_miss"), r6(F.max("miss")).alias("max_miss"), F.count("miss").alias("n")))
    median, p90 = se.quantiles(m.select("miss"), (0.5, 0.9), counts.first().n)
    return counts.select("below", "inside", "above", "mean_miss", r6(F.lit(median).cast("double")).alias("median_miss"), r6(F.lit(p90).cast("double")).alias("p90_miss"), "max_miss")


FILLS = (0, 1, 2, 4)


@query("a22_bounded_fill_availability", f"""SELECT c.view, c.condition, m.roi_index, f.fill, count(*) AS hops, count(*) FILTER (m.hop_idx - last_valid <= f.fill) AS available
  FROM (SELECT *, max(CASE WHEN valid THEN hop_idx END) OVER (PARTITION BY clip_id, roi_index ORDER BY hop_idx) AS last_valid FROM v_meas) m JOIN v_clips c USING (clip_id) CROSS JOIN (VALUES (0), (1), (2), (4)) f(fill) GROUP BY 1, 2, 3, 4""")
def bounded_fill(spark, sf):
    """Availability when a channel may be filled from at most ``fill`` hops back."""
    m = roles.measurements(spark, sf)
    w = Window.partitionBy("clip_id", "roi_index").orderBy("hop_idx").rowsBetween(-max(FILLS), 0)
    age = F.col("hop_idx") - F.last(F.when(F.col("valid"), F.col("hop_idx")), ignorenulls=True).over(w)
    f = m.withColumn("age", age).join(roles.clips(spark, sf), "clip_id").withColumn("fill", F.explode(F.array(*[F.lit(x) for x in FILLS])))
    return f.groupBy("view", "condition", "roi_index", "fill").agg(F.count(F.lit(1)).alias("hops"), co.count_if(F.col("age") <= F.col("fill")).alias("available"))
