"""Bootstrap queries (B1-B8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from windfold.functions.columns import r6
from windfold.operators import resample as rs
from windfold.plans import common, scores
from windfold.plans.branching import WINDOW as HORIZON
from windfold.plans.branching import regrets
from windfold.plans.registry import query, view
from windfold.session import cut_lineage
from windfold.sources import roles

R = rs.REPLICATES
ARM_R = 2_000

view("v_boot_draws", f"""SELECT replicate, CAST('0x' || substr(md5('8101|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS ix, count(*) AS times
  FROM (SELECT range AS replicate FROM range({R})), (SELECT unnest(range(n)) AS slot, n FROM (SELECT count(DISTINCT p_brand) AS n FROM part)) GROUP BY 1, 2""")
view("v_boot_subject", """SELECT method_id, subject_id, dense_rank() OVER (ORDER BY md5(subject_id), subject_id) - 1 AS ix, sum(mae) AS total, count(*) AS clips FROM v_line_clip GROUP BY 1, 2""")
view("v_boot_clip", "SELECT method_id, replicate, sum(total * times) / sum(clips * times) AS est FROM v_boot_subject JOIN v_boot_draws USING (ix) GROUP BY 1, 2")
view("v_boot_subj", "SELECT method_id, replicate, sum(total / clips * times) / sum(times) AS est FROM v_boot_subject JOIN v_boot_draws USING (ix) GROUP BY 1, 2")


def sums(spark, sf):
    return rs.subject_sums(scores.line_clip(spark, sf), "mae")


@query("b01_equal_clip_bootstrap", "SELECT method_id, round(avg(est), 6) AS mean_estimate, round(quantile_cont(est, 0.025), 6) AS lower, round(quantile_cont(est, 0.975), 6) AS upper FROM v_boot_clip GROUP BY 1")
def equal_clip(spark, sf):
    b = rs.bootstrap(sums(spark, sf), R, rs.SEED)
    return b.groupBy("method_id").agg(r6(F.avg("estimate")).alias("mean_estimate"), rs.linear_interval(F.col("estimate")).alias("ci")).select(
        "method_id", "mean_estimate", r6(F.col("ci")[0]).alias("lower"), r6(F.col("ci")[1]).alias("upper"))


def paired(b, left, right):
    at = lambda m: F.max(F.when(F.col("method_id") == m, F.col("estimate")))
    return b.groupBy("replicate").agg((at(left) - at(right)).alias("d"))


@query("b02_paired_bootstrap", " UNION ALL ".join(f"""SELECT '{e}' AS estimand, round(list_extract(list(d ORDER BY d), {int(0.025 * (R - 1)) + 1}), 6) AS lower, round(list_extract(list(d ORDER BY d), {int(0.975 * (R - 1)) + 1}), 6) AS upper
  FROM (SELECT replicate, max(est) FILTER (method_id = 'list') - max(est) FILTER (method_id = 'full') AS d FROM {v} GROUP BY 1)""" for e, v in (("equal_clip", "v_boot_clip"), ("equal_subject", "v_boot_subj"))))
def paired_bootstrap(spark, sf):
    out = None
    for e in ("equal_clip", "equal_subject"):
        d = paired(rs.bootstrap(sums(spark, sf), R, rs.SEED, e), "list", "full").withColumn("estimand", F.lit(e))
        out = d if out is None else out.unionByName(d)
    i = rs.sorted_interval(out, ["estimand"], "d", R)
    return i.select("estimand", r6("lower").alias("lower"), r6("upper").alias("upper"))


view("v_reg_subject", f"""SELECT seed, subject_id, avg(m) AS m FROM (SELECT seed, clip_id, avg(factual_error - best_error) AS m FROM v_regret WHERE horizon = {HORIZON} GROUP BY 1, 2) JOIN v_clips USING (clip_id) GROUP BY seed, subject_id""")
view("v_reg_no", "SELECT subject_id, row_number() OVER (ORDER BY md5(subject_id), subject_id) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM v_reg_subject)")


@query("b03_subject_mean_bootstrap", f"""SELECT seed, round(any_value(point), 6) AS point_estimate, round(list_extract(list(est ORDER BY est), {int(0.025 * (R - 1)) + 1}), 6) AS lower, round(list_extract(list(est ORDER BY est), {int(0.975 * (R - 1)) + 1}), 6) AS upper
  FROM (SELECT seed, replicate, avg(m) AS est FROM (SELECT r.range AS replicate, CAST('0x' || substr(md5('8101|' || r.range || '|' || s.ix), 1, 8) AS BIGINT) % s.n AS ix FROM range({R}) r CROSS JOIN v_reg_no s) d JOIN v_reg_no o ON o.ix = d.ix JOIN v_reg_subject t ON t.subject_id = o.subject_id GROUP BY 1, 2)
  JOIN (SELECT seed, avg(m) AS point FROM v_reg_subject GROUP BY 1) USING (seed) GROUP BY 1""")
def subject_means(spark, sf):
    g = regrets(spark, sf).where(f"horizon = {HORIZON}").groupBy("seed", "clip_id").agg(F.avg(F.col("factual_error") - F.col("best_error")).alias("m"))
    s = cut_lineage(g.join(roles.clips(spark, sf).select("clip_id", "subject_id"), "clip_id").groupBy("seed", "subject_id").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("clips")))
    i = rs.sorted_interval(rs.bootstrap(s, R, rs.SEED, "equal_subject", methods=["seed"]), ["seed"], "estimate", R)
    point = s.groupBy("seed").agg(r6(F.avg(F.col("total") / F.col("clips"))).alias("point_estimate"))
    return point.join(i, "seed").select("seed", "point_estimate", r6("lower").alias("lower"), r6("upper").alias("upper"))


view("v_cross_subject", """SELECT arm_id, subject_id, dense_rank() OVER (ORDER BY md5(subject_id), subject_id) - 1 AS ix, avg(current_mae) - avg(historical_mae) AS delta FROM v_crossover GROUP BY 1, 2""")


@query("b05_arm_delta_bootstrap", f"""SELECT arm_id, round(avg(est), 6) AS mean_delta, round(quantile_cont(est, 0.025), 6) AS lower, round(quantile_cont(est, 0.975), 6) AS upper FROM (
  SELECT c.arm_id, d.replicate, avg(c.delta) AS est FROM (SELECT a.arm_id, r.range AS replicate, CAST('0x' || substr(md5((6101 + CAST(substr(a.arm_id, 5) AS BIGINT)) || '|' || r.range || '|' || s.slot), 1, 8) AS BIGINT) % s.n AS ix
    FROM range({ARM_R}) r CROSS JOIN (SELECT unnest(range(n)) AS slot, n FROM (SELECT count(DISTINCT subject_id) AS n FROM v_cross_subject)) s CROSS JOIN (SELECT DISTINCT arm_id FROM v_cross_subject) a) d
  JOIN v_cross_subject c ON c.arm_id = d.arm_id AND c.ix = d.ix GROUP BY 1, 2) GROUP BY 1""")
def arm_delta(spark, sf):
    """One seed per arm: base seed plus the arm's number."""
    from windfold.functions.columns import hash_draw
    s = scores.crossover(spark, sf).groupBy("arm_id", "subject_id").agg((F.avg("current_mae") - F.avg("historical_mae")).alias("delta"))
    s = cut_lineage(s)
    ix = rs.number_subjects(s)
    s = s.join(ix, "subject_id")
    seed = F.substring("arm_id", 5, 9).cast("bigint") + 6101
    d = s.select("arm_id", F.col("subject_ix").alias("slot"), "n_subjects", F.explode(F.sequence(F.lit(0), F.lit(ARM_R - 1))).alias("replicate"))
    d = d.select("arm_id", "replicate", (hash_draw(seed, F.col("replicate"), F.col("slot")) % F.col("n_subjects")).alias("subject_ix")).groupBy("arm_id", "replicate", "subject_ix").agg(F.count(F.lit(1)).alias("times"))
    e = s.join(d, ["arm_id", "subject_ix"]).groupBy("arm_id", "replicate").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("est"))
    return e.groupBy("arm_id").agg(r6(F.avg("est")).alias("mean_delta"), rs.linear_interval(F.col("est")).alias("ci")).select("arm_id", "mean_delta", r6(F.col("ci")[0]).alias("lower"), r6(F.col("ci")[1]).alias("upper"))


@query("b06_arm_minus_full", f"""SELECT method_id, round(list_extract(list(d ORDER BY d), {int(0.025 * (R - 1)) + 1}), 6) AS lower, round(list_extract(list(d ORDER BY d), {int(0.975 * (R - 1)) + 1}), 6) AS upper
  FROM (SELECT a.method_id, a.est - b.est AS d FROM v_boot_subj a JOIN v_boot_subj b ON b.replicate = a.replicate AND b.method_id = 'full' WHERE a.method_id <> 'full') GROUP BY 1""")
def arm_minus_full(spark, sf):
    b = rs.bootstrap(sums(spark, sf), R, rs.SEED, "equal_subject")
    full = b.where("method_id = 'full'").select("replicate", F.col("estimate").alias("base"))
    d = b.where("method_id <> 'full'").join(full, "replicate").withColumn("d", F.col("estimate") - F.col("base"))
    return rs.sorted_interval(d, ["method_id"], "d", R).select("method_id", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("b07_interval_rules", f"""SELECT method_id, round(quantile_cont(est, 0.025), 6) AS linear_lower, round(quantile_cont(est, 0.975), 6) AS linear_upper,
  round(list_extract(list(est ORDER BY est), {int(0.025 * (R - 1)) + 1}), 6) AS sorted_lower, round(list_extract(list(est ORDER BY est), {int(0.975 * (R - 1)) + 1}), 6) AS sorted_upper FROM v_boot_clip GROUP BY 1""")
def interval_rules(spark, sf):
    b = rs.bootstrap(sums(spark, sf), R, rs.SEED)
    s = rs.sorted_interval(b, ["method_id"], "estimate", R)
    l = b.groupBy("method_id").agg(rs.linear_interval(F.col("estimate")).alias("ci"))
    return l.join(s, "method_id").select("method_id", r6(F.col("ci")[0]).alias("linear_lower"), r6(F.col("ci")[1]).alias("linear_upper"), r6("lower").alias("sorted_lower"), r6("upper").alias("sorted_upper"))


@query("b08_draw_difference", """SELECT round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper FROM (SELECT replicate, max(est) FILTER (method_id = 'half') - max(est) FILTER (method_id = 'full') AS d FROM v_boot_clip GROUP BY 1)""")
def draw_difference(spark, sf):
    d = paired(rs.bootstrap(sums(spark, sf), R, rs.SEED), "half", "full")
    return d.agg(r6(F.avg("d")).alias("mean_difference"), rs.linear_interval(F.col("d")).alias("ci")).select("mean_difference", r6(F.col("ci")[0]).alias("lower"), r6(F.col("ci")[1]).alias("upper"))
