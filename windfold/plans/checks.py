"""Constraints, joins and set operations (V, J, U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windfold.functions import columns as col
from windfold.functions.columns import r6
from windfold.operators import constraints as co
from windfold.operators import score as sc
from windfold.operators.windows import index_rows, neighbour
from windfold.plans import common
from windfold.plans.registry import query, view
from windfold.sources import roles

t = roles.table


@query("v01_index_gaps", """SELECT a.l_orderkey, a.l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a
  LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1
  WHERE a.l_linenumber > 1 AND b.l_orderkey IS NULL""")
def index_gaps(spark, sf):
    return co.contiguous(t(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@query("v01_canonical_index_text", """SELECT event_type, count(*) AS rows_checked, count(*) FILTER (NOT regexp_full_match(regexp_extract(props, '"k": *([^}]*)', 1), '0|[1-9][0-9]*')) AS not_canonical FROM events GROUP BY 1""")
def canonical_text(spark, sf):
    e = t(spark, sf, "events").withColumn("k", F.regexp_extract("props", '"k": *([^}]*)', 1))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_checked"), co.count_if(~F.col("k").rlike("^(0|[1-9][0-9]*)$")).alias("not_canonical"))


@query("v02_structured_missing", """SELECT count(*) AS rows_checked, count(*) FILTER (coverage = 0 AND (hr_bpm IS NOT NULL OR confidence IS NOT NULL)) AS value_without_coverage,
  count(*) FILTER (coverage > 0 AND (hr_bpm IS NULL OR confidence IS NULL)) AS coverage_without_value, count(*) FILTER (coverage < 0 OR coverage > 1) AS coverage_out_of_range FROM v_meas""")
def structured_missing(spark, sf):
    hr, c, v = F.col("hr_bpm").isNotNull(), F.col("confidence").isNotNull(), F.col("coverage")
    return co.violations(roles.measurements(spark, sf), {
        "value_without_coverage": (v == 0) & (hr | c), "coverage_without_value": (v > 0) & ~(hr & c), "coverage_out_of_range": (v < 0) | (v > 1)})


@query("v03_all_or_none", """SELECT count(*) AS rows_checked, count(*) FILTER ((o_orderkey IS NULL)::INT + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT NOT IN (0, 3)) AS partly_null,
  count(*) FILTER (o_orderkey IS NULL) AS all_null FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def all_or_none(spark, sf):
    cols = ["o_orderkey", "o_totalprice", "o_orderdate"]
    j = t(spark, sf, "customer").select("c_custkey").join(t(spark, sf, "orders").select("o_custkey", *cols), F.col("c_custkey") == F.col("o_custkey"), "left")
    return co.violations(j, {"partly_null": co.all_or_none(cols), "all_null": F.col("o_orderkey").isNull()})


@query("v04_finite_numbers", """SELECT p_brand, count(*) AS rows_checked, count(*) FILTER (NOT coalesce(isfinite(TRY_CAST(split_part(p_name, ' ', 2) AS DOUBLE)), FALSE)) AS name_not_numeric,
  count(*) FILTER (NOT coalesce(isfinite(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE)), FALSE)) AS brand_not_numeric FROM part GROUP BY 1""")
def finite_numbers(spark, sf):
    bad = lambda text: ~col.finite(F.expr(f"try_cast({text} AS double)"))
    return t(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("rows_checked"), F.sum(F.coalesce(bad("split_part(p_name, ' ', 2)"), F.lit(True)).cast("bigint")).alias("name_not_numeric"),
        F.sum(F.coalesce(bad("split_part(p_brand, '#', 2)"), F.lit(True)).cast("bigint")).alias("brand_not_numeric"))


@query("v05_one_sided_keys", """SELECT coalesce(o.k, l.k) AS order_key, CASE WHEN o.k IS NULL THEN 'right_only' ELSE 'left_only' END AS side
  FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL""")
def one_sided(spark, sf):
    return co.one_sided(t(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key")), t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key")), ["order_key"])


SPLIT = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'eval' ELSE 'train' END"


@query("v06_split_disjoint", f"""SELECT c.c_custkey AS subject, count(DISTINCT {SPLIT.replace('o_orderpriority', 'o.o_orderpriority')}) FILTER (o.o_orderkey IS NOT NULL) AS splits
  FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1 HAVING count(DISTINCT {SPLIT.replace('o_orderpriority', 'o.o_orderpriority')}) FILTER (o.o_orderkey IS NOT NULL) <> 1""")
def split_disjoint(spark, sf):
    """Subjects assigned to no split or to more than one."""
    given = t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.expr(SPLIT).alias("split")).distinct()
    per = given.groupBy("subject").agg(F.count(F.lit(1)).alias("splits"))
    every = t(spark, sf, "customer").select(F.col("c_custkey").alias("subject"))
    return every.join(per, "subject", "left").select("subject", F.coalesce("splits", F.lit(0)).alias("splits")).where("splits <> 1")


@query("v07_missing_combinations", """SELECT s.subject, v.view, c.condition FROM (SELECT DISTINCT c_nationkey AS subject FROM customer) s CROSS JOIN (SELECT DISTINCT c_mktsegment AS view FROM customer) v
  CROSS JOIN (VALUES ('before'), ('after')) c(condition) WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = s.subject AND x.c_mktsegment = v.view
  AND CASE WHEN x.c_acctbal < 2000 THEN 'after' ELSE 'before' END = c.condition)""")
def missing_combinations(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("view"),
                                        F.expr("CASE WHEN c_acctbal < 2000 THEN 'after' ELSE 'before' END").alias("condition"))
    return co.missing_grid(c, ["subject"], {"view": c.agg(F.collect_set("view")).scalar(), "condition": ("before", "after")})


@query("v08_acceptance_counts", """SELECT * FROM (SELECT 'channels' AS item, CAST(5 AS BIGINT) AS expected, count(DISTINCT event_type) AS observed FROM events
  UNION ALL SELECT 'subjects', (SELECT count(*) FROM nation), count(DISTINCT c_nationkey) FROM customer
  UNION ALL SELECT 'clips', (SELECT count(*) FROM customer), count(DISTINCT user_id) FROM events)""")
def acceptance(spark, sf):
    n = F.count(F.lit(1))
    observed = (t(spark, sf, "events").agg(F.lit("channels").alias("item"), F.countDistinct("event_type").alias("observed"))
                .unionByName(t(spark, sf, "customer").agg(F.lit("subjects").alias("item"), F.countDistinct("c_nationkey").alias("observed")))
                .unionByName(t(spark, sf, "events").agg(F.lit("clips").alias("item"), F.countDistinct("user_id").alias("observed"))))
    expected = (spark.createDataFrame([("channels", len(roles.CHANNELS))], "item string, expected bigint")
                .unionByName(t(spark, sf, "nation").agg(F.lit("subjects").alias("item"), n.alias("expected")))
                .unionByName(t(spark, sf, "customer").agg(F.lit("clips").alias("item"), n.alias("expected"))))
    return expected.join(observed, "item")


@query("v09_manifest_consistency", """SELECT count(*) AS orders_checked, count(*) FILTER (c.c_custkey IS NULL) AS unknown_customer, count(*) FILTER (l.n IS NULL) AS no_lines,
  count(*) FILTER (l.first_ship < o.o_orderdate) AS shipped_before_order, count(*) FILTER (abs(l.total - o.o_totalprice) > 1) AS total_disagrees
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_ship, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def manifest(spark, sf):
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"), F.sum("l_extendedprice").alias("total"))
    o = t(spark, sf, "orders").join(t(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return co.violations(o, {"unknown_customer": F.col("c_custkey").isNull(), "no_lines": F.col("n").isNull(), "shipped_before_order": F.col("first_ship") < F.col("o_orderdate"),
                             "total_disagrees": F.abs(F.col("total") - F.col("o_totalprice")) > 1}).withColumnRenamed("rows_checked", "orders_checked")


@query("v10_hop_lattice", """SELECT l_orderkey, count(*) AS row_count, count(DISTINCT l_linenumber) AS distinct_count, min(l_linenumber) AS min_index, max(l_linenumber) AS max_index FROM lineitem GROUP BY 1
  HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)""")
def hop_lattice(spark, sf):
    return co.lattice(t(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@query("v11_state_chain", """SELECT method_id, count(*) AS rows_checked, count(*) FILTER (previous_action IS DISTINCT FROM pe) AS broken_previous,
  count(*) FILTER (pre_hold_count <> coalesce(ph, 0)) AS broken_hold, count(*) FILTER (abs(pre_belief_hr_bpm - coalesce(pb, 70)) > 1e-12) AS broken_belief,
  count(*) FILTER (NOT CASE WHEN previous_action IS NULL THEN pre_hold_count = 0 AND proposed_action = executed_action AND post_hold_count = 1 AND legal
    WHEN proposed_action = previous_action THEN executed_action = previous_action AND post_hold_count = pre_hold_count + 1 AND legal
    WHEN pre_hold_count < 2 THEN executed_action = previous_action AND post_hold_count = pre_hold_count + 1 AND NOT legal AND override_reason = 'minimum_hold'
    ELSE executed_action = proposed_action AND post_hold_count = 1 AND legal END) AS impossible_decision
  FROM (SELECT *, lag(executed_action) OVER w AS pe, lag(post_hold_count) OVER w AS ph, lag(post_belief_hr_bpm) OVER w AS pb FROM v_replay WINDOW w AS (PARTITION BY method_id, clip_id ORDER BY hop_idx)) GROUP BY 1""")
def state_chain(spark, sf):
    r = neighbour(common.replayed(spark, sf), ["method_id", "clip_id"], "hop_idx", ["executed_action", "post_hold_count", "post_belief_hr_bpm"])
    fine = """CASE WHEN previous_action IS NULL THEN pre_hold_count = 0 AND proposed_action = executed_action AND post_hold_count = 1 AND legal
      WHEN proposed_action = previous_action THEN executed_action = previous_action AND post_hold_count = pre_hold_count + 1 AND legal
      WHEN pre_hold_count < 2 THEN executed_action = previous_action AND post_hold_count = pre_hold_count + 1 AND NOT legal AND override_reason = 'minimum_hold'
      ELSE executed_action = proposed_action AND post_hold_count = 1 AND legal END"""
    return r.groupBy("method_id").agg(
        F.count(F.lit(1)).alias("rows_checked"), co.count_if(~F.col("previous_action").eqNullSafe(F.col("prev_executed_action"))).alias("broken_previous"),
        co.count_if(F.expr("pre_hold_count <> coalesce(prev_post_hold_count, 0)")).alias("broken_hold"),
        co.count_if(F.expr("abs(pre_belief_hr_bpm - coalesce(prev_post_belief_hr_bpm, 70D)) > 1e-12D")).alias("broken_belief"), co.count_if(~F.expr(fine)).alias("impossible_decision"))


@query("v12_value_reconstruction", """SELECT count(*) AS compared, count(*) FILTER (abs(o_totalprice - total) > 1e-12) AS beyond_tolerance, count(*) FILTER (o_orderkey IS NULL OR l_orderkey IS NULL) AS one_sided
  FROM orders FULL JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def reconstruction(spark, sf):
    """Rebuild the stored order total from its lines and diff it."""
    stored = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    again = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("total"))
    c = sc.compare(stored, again, ["k"])
    return c.agg(F.count(F.lit(1)).alias("compared"), co.count_if(F.abs(F.col("l.total") - F.col("r.total")) > 1e-12).alias("beyond_tolerance"),
                 co.count_if(F.col("presence") != "joined").alias("one_sided"))


@query("v13_fixed_arm_rules", """SELECT (SELECT count(*) FROM (SELECT clip_id FROM v_crossover GROUP BY 1 HAVING count(DISTINCT arm_id) <> 5)) AS clips_without_all_arms,
  count(*) AS rows_checked, count(*) FILTER (historical_mae < 0 OR current_mae < 0) AS negative_error, count(*) FILTER (abs(delta - (current_mae - historical_mae)) > 1e-12) AS delta_broken FROM v_crossover""")
def fixed_arm_rules(spark, sf):
    from windfold.plans.scores import crossover
    per = crossover(spark, sf).groupBy("clip_id").agg(
        F.countDistinct("arm_id").alias("arms"), F.count(F.lit(1)).alias("n"), co.count_if((F.col("historical_mae") < 0) | (F.col("current_mae") < 0)).alias("neg"),
        co.count_if(F.abs(F.col("delta") - (F.col("current_mae") - F.col("historical_mae"))) > 1e-12).alias("bad"))
    return per.agg(co.count_if(F.col("arms") != 5).alias("clips_without_all_arms"), F.sum("n").alias("rows_checked"), F.sum("neg").alias("negative_error"), F.sum("bad").alias("delta_broken"))


@query("v14_shard_coverage", """SELECT l_suppkey AS subject, count(DISTINCT l_returnflag) AS shards, count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS duplicate_keys FROM lineitem GROUP BY 1
  HAVING count(DISTINCT l_returnflag) > 1 OR count(*) <> count(DISTINCT (l_orderkey, l_linenumber, l_partkey))""")
def shard_coverage(spark, sf):
    li = t(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "subject")
    shards = li.where("l_returnflag IS NOT NULL").select("subject", "l_returnflag").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("shards"))
    keys = li.groupBy("subject", "l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    repeated = keys.groupBy("subject").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicate_keys"))
    return repeated.join(shards, "subject", "left").select("subject", F.coalesce("shards", F.lit(0)).alias("shards"), "duplicate_keys").where("shards > 1 OR duplicate_keys > 0")


@query("v15_one_identity", """SELECT p_brand, count(*) AS identities FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) GROUP BY 1 HAVING count(*) > 1""")
def one_identity(spark, sf):
    return co.many_identities(t(spark, sf, "part"), ["p_brand"], ["p_type", "p_size"])


@query("v16_record_invariants", """SELECT count(*) AS rows_checked, count(*) FILTER (selected_valid <> (selected_hr_bpm IS NOT NULL)) AS validity_broken,
  count(*) FILTER (abs(pre_p01 - pre_p10) > 1e-10 OR pre_p00 < 0 OR pre_p11 < 0 OR pre_p00 * pre_p11 - ((pre_p01 + pre_p10) / 2) * ((pre_p01 + pre_p10) / 2) < -1e-6) AS covariance_broken,
  count(*) FILTER (legal = (override_reason IS NOT NULL)) AS reason_broken FROM v_replay""")
def record_invariants(spark, sf):
    return co.violations(common.replayed(spark, sf), {
        "validity_broken": F.col("selected_valid") != F.col("selected_hr_bpm").isNotNull(),
        "covariance_broken": co.covariance_broken(*[F.col(f"pre_{p}") for p in ("p00", "p01", "p10", "p11")]),
        "reason_broken": F.col("legal") == F.col("override_reason").isNotNull()})


@query("v18_declared_exclusions", """SELECT clip_id, count(*) AS excluded_hops, bool_and(all_invalid) AS proven_invalid FROM (
  SELECT clip_id, hop_idx, bool_and(NOT valid) AS all_invalid FROM v_meas GROUP BY 1, 2) WHERE all_invalid GROUP BY 1""")
def exclusions(spark, sf):
    """Hops excluded because no channel is valid, with the proof next to the count."""
    h = roles.hops(spark, sf).withColumn("all_invalid", ~F.exists("hr", lambda v: v.isNotNull()))
    return h.where("all_invalid").groupBy("clip_id").agg(F.count(F.lit(1)).alias("excluded_hops"), F.bool_and("all_invalid").alias("proven_invalid"))


@query("v20_replay_parity", """SELECT count(*) AS compared, count(*) FILTER (h.clip_id IS NULL OR c.clip_id IS NULL OR abs(h.post_belief_hr_bpm - c.post_belief_hr_bpm) > 1e-6) AS mismatched
  FROM (SELECT * FROM v_hist_scored WHERE method_id = 'arm_0') h FULL JOIN (SELECT * FROM v_scored WHERE method_id = 'arm_0') c ON c.clip_id = h.clip_id AND c.hop_idx = h.hop_idx""")
def replay_parity(spark, sf):
    cols = ["clip_id", "hop_idx", "post_belief_hr_bpm"]
    c = sc.compare(common.historical(spark, sf, [0]).select(*cols), common.score_rows(spark, sf, ["arm_0"]).select(*cols), sc.HOP)
    off = (F.col("presence") != "joined") | (F.abs(F.col("l.post_belief_hr_bpm") - F.col("r.post_belief_hr_bpm")) > 1e-6)
    return c.agg(F.count(F.lit(1)).alias("compared"), co.count_if(off).alias("mismatched"))


@query("v21_inventory_equality", """SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer)) AS clips_unknown,
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) AS clips_absent""")
def inventory_equality(spark, sf):
    sides = co.one_sided(t(spark, sf, "events").select(F.col("user_id").alias("clip_id")), t(spark, sf, "customer").select(F.col("c_custkey").alias("clip_id")), ["clip_id"])
    return sides.agg(co.count_if(F.col("side") == "left_only").alias("clips_unknown"), co.count_if(F.col("side") == "right_only").alias("clips_absent"))


@query("v22_first_failure", """SELECT clip_id, hop_idx AS first_failing_hop, roi_index, invalid_reason FROM v_meas WHERE NOT valid QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY hop_idx, roi_index) = 1""")
def first_failure(spark, sf):
    bad = roles.measurements(spark, sf).where("NOT valid")
    return bad.groupBy("clip_id").agg(F.min(F.struct("hop_idx", "roi_index", "invalid_reason")).alias("f")).select(
        "clip_id", F.col("f.hop_idx").alias("first_failing_hop"), "f.roi_index", "f.invalid_reason")


@query("v23_terminal_trim", """SELECT clip_id, count(*) AS original_rows, max(CASE WHEN k >= 5 THEN frame_idx END) + 1 AS kept_rows, count(*) - max(CASE WHEN k >= 5 THEN frame_idx END) - 1 AS trimmed_rows,
  count(*) FILTER (k < 5) - (count(*) - max(CASE WHEN k >= 5 THEN frame_idx END) - 1) AS interior_zero_rows FROM v_frames GROUP BY 1""")
def terminal_trim(spark, sf):
    """A sample below 5 points counts as empty; only an empty suffix may be trimmed."""
    f = roles.frames(spark, sf)
    g = f.groupBy("clip_id").agg(F.count(F.lit(1)).alias("original_rows"), (F.max(F.when(F.col("k") >= 5, F.col("frame_idx"))) + 1).alias("kept_rows"), co.count_if(F.col("k") < 5).alias("z"))
    trimmed = F.col("original_rows") - F.col("kept_rows")
    return g.select("clip_id", "original_rows", "kept_rows", trimmed.alias("trimmed_rows"), (F.col("z") - trimmed).alias("interior_zero_rows"))


@query("v24_choice_masks", """SELECT method_id, CASE WHEN previous_action IS NOT NULL AND pre_hold_count < 2 THEN 'locked' WHEN coalesce(n, 0) = 0 THEN 'no_valid' ELSE 'kept' END AS drop_reason, count(*) AS hops
  FROM v_replay LEFT JOIN (SELECT clip_id, hop_idx, count(*) FILTER (valid) AS n FROM v_meas GROUP BY 1, 2) USING (clip_id, hop_idx) WHERE family = 'tabled' GROUP BY 1, 2""")
def choice_masks(spark, sf):
    r = common.replayed(spark, sf, [f"tabled_seed{s}" for s in roles.RANDOM_SEEDS])
    usable = roles.hops(spark, sf).select("clip_id", "hop_idx", F.exists("hr", lambda v: v.isNotNull()).alias("any_valid"))
    reason = F.when(F.col("previous_action").isNotNull() & (F.col("pre_hold_count") < 2), "locked").when(~F.col("any_valid"), "no_valid").otherwise("kept")
    return r.join(usable, ["clip_id", "hop_idx"]).groupBy("method_id", reason.alias("drop_reason")).agg(F.count(F.lit(1)).alias("hops"))


@query("v25_status_transitions", """SELECT prev_status, status, count(*) AS n FROM (SELECT o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_status FROM orders)
  WHERE prev_status IS NOT NULL AND (prev_status, status) NOT IN (('O', 'O'), ('O', 'P'), ('P', 'P'), ('P', 'F'), ('F', 'F')) GROUP BY 1, 2""")
def status_transitions(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("status"))
    o = index_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"), "position")
    allowed = spark.createDataFrame([("O", "O"), ("O", "P"), ("P", "P"), ("P", "F"), ("F", "F")], "prev_status string, status string")
    steps = neighbour(o, ["o_custkey"], "position", ["status"]).where("prev_status IS NOT NULL").groupBy("prev_status", "status").agg(F.count(F.lit(1)).alias("n"))
    return steps.join(allowed, ["prev_status", "status"], "left_anti")


@query("v26_task_grid", """SELECT count(*) FILTER (r.n IS NULL) AS missing_tasks, count(*) FILTER (g.seed IS NULL) AS extra_results, count(*) FILTER (r.n > 1) AS duplicated_tasks, count(g.seed) AS expected_tasks, max(3 * g.o_orderkey + g.seed) AS last_task_index
  FROM (SELECT o_orderkey, s.seed FROM orders CROSS JOIN (SELECT range AS seed FROM range(3)) s) g
  FULL JOIN (SELECT l_orderkey, l_linenumber - 1 AS seed, count(*) AS n FROM lineitem GROUP BY 1, 2) r ON r.l_orderkey = g.o_orderkey AND r.seed = g.seed""")
def task_grid(spark, sf):
    """Tasks are (clip, seed) with index 3*clip + seed; each needs exactly one result, and no others may exist."""
    grid = t(spark, sf, "orders").select(F.col("o_orderkey").alias("clip"), F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("seed")).withColumn("task", 3 * F.col("clip") + F.col("seed"))
    have = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip"), (F.col("l_linenumber") - 1).alias("seed")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(have, ["clip", "seed"], "full_outer").agg(
        co.count_if(F.col("n").isNull()).alias("missing_tasks"), co.count_if(F.col("task").isNull()).alias("extra_results"), co.count_if(F.col("n") > 1).alias("duplicated_tasks"),
        F.count("task").alias("expected_tasks"), F.max("task").alias("last_task_index"))


@query("v27_plan_contract", """SELECT count(DISTINCT clip_id) AS clips, count(DISTINCT subject_id) AS subjects, count(*) AS hops, count(DISTINCT method_id) AS identities FROM v_scored""")
def plan_contract(spark, sf):
    per = common.scored(spark, sf).groupBy("method_id", "subject_id", "clip_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.countDistinct("clip_id").alias("clips"), F.countDistinct("subject_id").alias("subjects"), F.sum("n").alias("hops"), F.countDistinct("method_id").alias("identities"))


# --- joins -------------------------------------------------------------------------------

@query("j01_label_coverage", """SELECT r.method_id, count(*) AS hops, count(*) FILTER (l.clip_id IS NULL) AS unlabelled FROM v_replay r
  LEFT JOIN v_labels l ON l.clip_id = r.clip_id AND l.hop_idx = r.hop_idx AND l.valid GROUP BY 1""")
def label_coverage(spark, sf):
    """Hops that scoring leaves out, by method; the strict form of scoring refuses them."""
    return sc.label_coverage(common.replayed(spark, sf), roles.labels(spark, sf), ["clip_id", "hop_idx"], ["method_id"])


@query("j04_observation_subject", """SELECT c.subject_id, count(*) AS observations, count(DISTINCT r.clip_id) AS clips FROM v_replay r JOIN v_wide w ON w.clip_id = r.clip_id AND w.hop_idx = r.hop_idx
  JOIN v_clips c ON c.clip_id = r.clip_id WHERE r.method_id = 'max_ppr' GROUP BY 1""")
def observation_subject(spark, sf):
    rows = common.replayed(spark, sf, ["max_ppr"]).select("clip_id", "hop_idx")
    obs = roles.hops(spark, sf).select("clip_id", "hop_idx").join(rows, ["clip_id", "hop_idx"]).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    return obs.join(roles.clips(spark, sf), "clip_id").groupBy("subject_id").agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("clips"))


@query("j06_clip_dimension", """SELECT subject_id, view, condition, count(*) AS samples, round(sum(cents) / (100.0::DOUBLE * count(*)), 6) AS mean_value FROM v_samples JOIN v_clips USING (clip_id) GROUP BY 1, 2, 3""")
def clip_dimension(spark, sf):
    # Reduce the samples of a clip to one row before the dimension is joined.
    per = roles.samples(spark, sf).groupBy("clip_id").agg(F.sum("cents").alias("c"), F.count(F.lit(1)).alias("n"))
    return per.join(roles.clips(spark, sf), "clip_id").groupBy("subject_id", "view", "condition").agg(
        F.sum("n").alias("samples"), r6(F.sum("c") / (F.lit(100.0) * F.sum("n"))).alias("mean_value"))


@query("j08_cohort_semi_join", """SELECT c_nationkey AS subject, count(*) AS clips FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') GROUP BY 1""")
def cohort_semi(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return (t(spark, sf, "customer").join(o.where("o_orderstatus = 'F'").select("c_custkey"), "c_custkey", "left_semi")
            .join(o.where("o_orderpriority = '5-LOW'").select("c_custkey"), "c_custkey", "left_anti")
            .groupBy(F.col("c_nationkey").alias("subject")).agg(F.count(F.lit(1)).alias("clips")))


@query("j09_channel_agreement", """SELECT a.clip_id, a.hop_idx, a.roi_index, round(CASE WHEN a.valid AND count(b.roi_index) > 0 THEN count(*) FILTER (abs(a.hr_bpm - b.hr_bpm) <= 5) / count(b.roi_index) ELSE 0 END, 6) AS agreement
  FROM v_meas a LEFT JOIN v_meas b ON b.clip_id = a.clip_id AND b.hop_idx = a.hop_idx AND b.roi_index <> a.roi_index AND b.valid GROUP BY a.clip_id, a.hop_idx, a.roi_index, a.valid""")
def channel_agreement(spark, sf):
    h = roles.hops(spark, sf).select("clip_id", "hop_idx", F.posexplode(col.agreement(F.col("hr"))).alias("roi_index", "agreement"))
    return h.select("clip_id", "hop_idx", "roi_index", r6("agreement").alias("agreement"))


@query("j12_cohort", """SELECT s.clip_id, c.subject_id, s.n_hops AS expected_hops FROM v_span s JOIN v_clips c USING (clip_id)
  WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.clip_id) AND c.c_acctbal >= 0 AND s.n_hops > 0""")
def cohort(spark, sf):
    """Clips with samples, present in every source, minus declared exclusions."""
    span = roles.samples(spark, sf).groupBy("clip_id").agg((F.max("day") - F.min("day") + 1).alias("n_days"))
    from windfold.operators.windows import hop_count
    present = t(spark, sf, "orders").select(F.col("o_custkey").alias("clip_id"))
    excluded = roles.clips(spark, sf).where("c_acctbal < 0").select("clip_id")
    return (span.join(present, "clip_id", "left_semi").join(excluded, "clip_id", "left_anti").join(roles.clips(spark, sf), "clip_id")
            .select("clip_id", "subject_id", hop_count(F.col("n_days"), roles.SIZE, roles.STEP).alias("expected_hops")).where("expected_hops > 0"))


# --- set operations -----------------------------------------------------------------------

@query("u01_shard_union", """SELECT l_returnflag AS shard, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def shard_union(spark, sf):
    li = t(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    is_open = F.col("l_returnflag").eqNullSafe("N")
    u = li.where(is_open).unionByName(li.where(~is_open))
    return u.groupBy(F.col("l_returnflag").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("u02_key_set_equality", """SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem)) AS left_extra,
  (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS right_extra""")
def key_equality(spark, sf):
    a = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("left_extra"), F.lit(0).cast("bigint").alias("right_extra"))
    right = b.exceptAll(a).agg(F.lit(0).cast("bigint").alias("left_extra"), F.count(F.lit(1)).alias("right_extra"))
    return left.unionByName(right).agg(F.sum("left_extra").alias("left_extra"), F.sum("right_extra").alias("right_extra"))


@query("u03_key_union", """SELECT count(*) AS keys, count(*) FILTER (u IS NOT NULL AND c IS NOT NULL) AS in_both FROM (SELECT DISTINCT user_id AS u FROM events) FULL JOIN (SELECT c_custkey AS c FROM customer) ON u = c""")
def key_union(spark, sf):
    u = t(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("c"))
    return u.join(c, F.col("u") == F.col("c"), "full_outer").agg(F.count(F.lit(1)).alias("keys"), co.count_if(F.col("u").isNotNull() & F.col("c").isNotNull()).alias("in_both"))


@query("u04_split_overlap", f"""SELECT count(*) AS overlapping_subjects FROM (SELECT o_custkey FROM orders WHERE {SPLIT} = 'train' INTERSECT SELECT o_custkey FROM orders WHERE {SPLIT} = 'eval')""")
def split_overlap(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", F.expr(SPLIT).alias("split"))
    return o.where("split = 'train'").select("o_custkey").intersect(o.where("split = 'eval'").select("o_custkey")).agg(F.count(F.lit(1)).alias("overlapping_subjects"))


@query("u05_distinct_cohort", """SELECT DISTINCT subject_id, view, condition FROM v_clips""")
def distinct_cohort(spark, sf):
    return roles.clips(spark, sf).select("subject_id", "view", "condition").distinct()
