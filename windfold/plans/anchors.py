"""Anchor analysis with all its fields and its sixteen measures with intervals (A17, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from windfold.functions.columns import r6
from windfold.operators import resample as rs
from windfold.operators import search as se
from windfold.plans import branching as br
from windfold.plans.registry import query, view
from windfold.session import cut_lineage
from windfold.sources import roles

W = br.WINDOW
KEYS = list(br.KEYS)
R = rs.REPLICATES
NEAR = "1e-6"
RECOVERIES = ("better_throughout", "briefly_better_then_ends_worse", "only_ends_better_late", "mixed_intermittent", "never_better")
#: Name of each measure and its SQL, null where an anchor is outside the measure's subset; flags have counts.
FLAGS = {k: k for k in ("positive_immediate_regret", "best_beats_factual", "same_step_reversal", "repeated_beats_best", "repeated_available")} | {
    f"recovery_{r}": f"CASE WHEN repeated_available = 1 THEN CASE WHEN recovery = '{r}' THEN 1 ELSE 0 END END" for r in RECOVERIES}
NUMBERS = {"eligible_factual_mae": "CASE WHEN analysis_eligible = 1 THEN factual_mae END"} | {k: k for k in ("immediate_regret", "best_gain", "repeated_gain", "repeated_gain_vs_best", "proposal_change_rate")}
MEASURES = FLAGS | NUMBERS

on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in KEYS)
first = "row_number() OVER (PARTITION BY seed, clip_id, anchor ORDER BY {}) = 1".format
view("v_coverage", f"""SELECT a.seed, a.clip_id, a.anchor, bool_and(NOT (r.previous_action IS NULL OR r.pre_hold_count >= 2) OR s.n_hops - r.hop_idx >= {W}) AS eligible, list(r.proposed_action ORDER BY r.hop_idx) AS props
  FROM v_anchor a JOIN v_replay r ON r.method_id = 'tabled_seed' || a.seed AND r.clip_id = a.clip_id AND r.hop_idx BETWEEN a.anchor AND a.anchor + {W - 1} JOIN v_span s ON s.clip_id = a.clip_id GROUP BY 1, 2, 3""")
view("v_immediate", f"SELECT seed, clip_id, anchor, err AS error, branch_action AS action FROM v_branch WHERE off = 0 QUALIFY {first('err, branch_action')}")
view("v_best_single", f"SELECT * FROM v_singles QUALIFY {first('total, endpoint, off, branch_action')}")
view("v_same_single", f"""SELECT s.seed, s.clip_id, s.anchor, s.total, s.endpoint, s.branch_action, x.err AS imm FROM (SELECT * FROM v_singles WHERE off = 0 QUALIFY {first('total, endpoint, branch_action')}) s
  JOIN v_branch x ON {on('x', 's')} AND x.branch_action = s.branch_action AND x.off = 0""")
view("v_repeats", f"SELECT seed, clip_id, anchor, count(*) AS n FROM v_corr8 WHERE off = {W - 1} AND len(list_filter(corrected, lambda x: x)) >= 2 GROUP BY 1, 2, 3")
view("v_repeat", f"SELECT *, list_filter(range({W}), lambda o: corrected[o + 1]) AS offs, list_transform(gains, lambda g: g > {NEAR}) AS ahead FROM v_repeated")
view("v_anchor_rows", f"""SELECT e.seed, e.clip_id, e.anchor, CAST(e.eligible AS INTEGER) AS analysis_eligible, CASE WHEN e.eligible THEN '' ELSE 'incomplete_single_coverage' END AS exclusion_reason,
  list_sum(f.errs) / {W} AS factual_mae, f.errs[{W}] AS factual_endpoint, coalesce(n.n, 0) AS repeated_path_count,
  i.action AS immediate_action, i.error AS immediate_error, f.errs[1] - i.error AS immediate_regret, CAST(f.errs[1] - i.error > {NEAR} AS INTEGER) AS positive_immediate_regret,
  s.branch_action AS same_action, s.imm AS same_immediate_error, s.total / {W} AS same_mae, s.endpoint AS same_endpoint,
  CAST(s.imm - f.errs[1] > {NEAR} AND (list_sum(f.errs) - s.total) / {W} > {NEAR} AS INTEGER) AS same_step_reversal,
  b.off AS best_offset, b.branch_action AS best_action, b.total / {W} AS best_mae, b.endpoint AS best_endpoint, (list_sum(f.errs) - b.total) / {W} AS best_gain, CAST((list_sum(f.errs) - b.total) / {W} > {NEAR} AS INTEGER) AS best_beats_factual,
  CASE WHEN e.eligible THEN CAST(r.clip_id IS NOT NULL AS INTEGER) END AS repeated_available, CASE WHEN e.eligible THEN coalesce(len(r.offs), 0) END AS repeated_corrections,
  CASE WHEN e.eligible THEN coalesce(array_to_string(r.offs, ','), '') END AS repeated_offsets, r.total / {W} AS repeated_mae, r.errs[{W}] AS repeated_endpoint,
  (list_sum(f.errs) - r.total) / {W} AS repeated_gain, (b.total - r.total) / {W} AS repeated_gain_vs_best, CAST((b.total - r.total) / {W} > {NEAR} AS INTEGER) AS repeated_beats_best,
  len(list_filter(range(r.offs[1] + 1, {W}), lambda o: r.pol[o + 1] <> e.props[o + 1])) AS proposal_changes, {W - 1} - r.offs[1] AS proposal_decisions,
  len(list_filter(range(r.offs[1] + 1, {W}), lambda o: r.pol[o + 1] <> e.props[o + 1])) / ({W - 1} - r.offs[1])::DOUBLE AS proposal_change_rate,
  CASE WHEN r.clip_id IS NULL THEN NULL WHEN NOT list_contains(r.ahead, FALSE) THEN 'better_throughout' WHEN NOT list_contains(r.ahead, TRUE) THEN 'never_better'
    WHEN r.ahead[1] AND NOT list_contains(r.ahead[list_position(r.ahead, FALSE):], TRUE) AND r.gains[-1] < -{NEAR} THEN 'briefly_better_then_ends_worse'
    WHEN NOT r.ahead[1] AND NOT list_contains(r.ahead[list_position(r.ahead, TRUE):], FALSE) THEN 'only_ends_better_late' ELSE 'mixed_intermittent' END AS recovery
  FROM v_coverage e JOIN v_factual f ON {on('f', 'e')} LEFT JOIN v_repeats n ON {on('n', 'e')} LEFT JOIN v_immediate i ON {on('i', 'e')} AND e.eligible
  LEFT JOIN v_same_single s ON {on('s', 'e')} AND e.eligible LEFT JOIN v_best_single b ON {on('b', 'e')} AND e.eligible LEFT JOIN v_repeat r ON {on('r', 'e')} AND e.eligible""")


def anchor_rows(spark, sf):
    """One row per (seed, clip, anchor); an anchor is left out of the analysis when a free hop of its window has no branches."""
    single = br.singles(spark, sf).withColumnsRenamed({"best": "b", "same": "s", "immediate": "i"})
    j = single.join(br.repeated_best(spark, sf), KEYS, "left")
    j = j.withColumn("eligible", F.expr(f"NOT exists(transform(ffree, (v, o) -> v AND last + 1 - (anchor + o) < {W}), x -> x)"))
    j = j.withColumns({c: F.when(F.col("eligible"), F.col(c)) for c in "ibsr"}).withColumnRenamed("factual_total", "ft")
    j = j.withColumn("offs", F.expr(f"filter(sequence(0, {W - 1}), o -> element_at(r.corrected, o + 1))")).withColumn("gains", F.zip_with("ferrors", "r.errors", lambda a, b: a - b))
    j = j.withColumn("changes", F.expr(f"size(filter(sequence(0, {W - 1}), o -> o > get(offs, 0) AND element_at(r.policy, o + 1) <> element_at(fproposed, o + 1)))"))
    flag = lambda text: F.expr(f"CAST({text} AS INT)")
    whole = lambda text: F.expr(f"CAST({text} AS BIGINT)")
    shared = {
        "analysis_eligible": flag("eligible"), "exclusion_reason": F.expr("if(eligible, '', 'incomplete_single_coverage')"), "factual_mae": F.expr(f"ft / {W}"), "factual_endpoint": F.get("ferrors", F.lit(W - 1)),
        "repeated_path_count": whole("coalesce(n, 0)"), "immediate_action": whole("i.branch_action"), "immediate_error": F.col("i.error"), "immediate_regret": F.expr("ferrors[0] - i.error"),
        "positive_immediate_regret": flag(f"ferrors[0] - i.error > {NEAR}D"), "same_action": whole("s.branch_action"), "same_immediate_error": F.col("s.immediate"), "same_mae": F.expr(f"s.total / {W}"),
        "same_endpoint": F.col("s.endpoint"), "same_step_reversal": flag(f"s.immediate - ferrors[0] > {NEAR}D AND (ft - s.total) / {W} > {NEAR}D"), "best_offset": whole("b.off"), "best_action": whole("b.branch_action"),
        "best_mae": F.expr(f"b.total / {W}"), "best_endpoint": F.col("b.endpoint"), "best_gain": F.expr(f"(ft - b.total) / {W}"), "best_beats_factual": flag(f"(ft - b.total) / {W} > {NEAR}D"),
        "repeated_available": F.expr("if(eligible, CAST(r IS NOT NULL AS INT), NULL)"), "repeated_corrections": F.expr("if(eligible, CAST(coalesce(size(offs), 0) AS BIGINT), NULL)"),
        "repeated_offsets": F.expr("if(eligible, coalesce(array_join(offs, ','), ''), NULL)"), "repeated_mae": F.expr(f"r.total / {W}"), "repeated_endpoint": F.col("r.endpoint"),
        "repeated_gain": F.expr(f"(ft - r.total) / {W}"), "repeated_gain_vs_best": F.expr(f"(b.total - r.total) / {W}"), "repeated_beats_best": flag(f"(b.total - r.total) / {W} > {NEAR}D"),
        "proposal_changes": F.expr("if(r IS NULL, NULL, CAST(changes AS BIGINT))"), "proposal_decisions": whole(f"{W - 1} - get(offs, 0)"),
        "proposal_change_rate": F.expr(f"if(r IS NULL, NULL, changes / ({W - 1} - get(offs, 0)))"), "recovery": F.when(F.col("r").isNotNull(), se.recovery_class(F.col("gains")))}
    return j.select(*KEYS, *[c.alias(k) for k, c in shared.items()])


REALS = ("factual_mae", "factual_endpoint", "immediate_error", "immediate_regret", "same_immediate_error", "same_mae", "same_endpoint", "best_mae", "best_endpoint", "best_gain", "repeated_mae", "repeated_endpoint",
         "repeated_gain", "repeated_gain_vs_best", "proposal_change_rate")


@query("a17_anchor_rows", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0 AS {c}' for c in REALS)}) FROM v_anchor_rows")
def all_fields(spark, sf):
    rows = anchor_rows(spark, sf)
    return rows.select(*[(r6(c) + 0).alias(c) if c in REALS else F.col(c) for c in rows.columns])


view("v_measure_clip", f"""SELECT seed, clip_id, unnest([{', '.join(f"'{m}'" for m in MEASURES)}]) AS measure, unnest([{', '.join(f'sum(({e})::DOUBLE)' for e in MEASURES.values())}]) AS total,
  unnest([{', '.join(f'count({e})' for e in MEASURES.values())}]) AS n FROM v_anchor_rows GROUP BY seed, clip_id""")
view("v_measure_subject", "SELECT seed, measure, subject_id, avg(total / n) AS m, sum(total) AS total, sum(n) AS n FROM v_measure_clip JOIN v_clips USING (clip_id) WHERE n > 0 GROUP BY 1, 2, 3")
view("v_measure_no", "SELECT subject_id, row_number() OVER (ORDER BY md5(subject_id), subject_id) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM v_measure_subject)")


@query("a18_measures", f"""SELECT seed, measure, any_value(numerator) AS numerator, any_value(denominator) AS denominator, any_value(subjects) AS subjects, round(any_value(point), 6) + 0 AS point,
  round(list_extract(list(est ORDER BY est), {int(0.025 * (R - 1)) + 1}), 6) + 0 AS lower_95, round(list_extract(list(est ORDER BY est), {int(0.975 * (R - 1)) + 1}), 6) + 0 AS upper_95
  FROM (SELECT seed, measure, replicate, avg(m) AS est FROM (SELECT r.range AS replicate, CAST('0x' || substr(md5('{rs.SEED}|' || r.range || '|' || s.ix), 1, 8) AS BIGINT) % s.n AS ix FROM range({R}) r CROSS JOIN v_measure_no s) d
    JOIN v_measure_no o ON o.ix = d.ix JOIN v_measure_subject t ON t.subject_id = o.subject_id GROUP BY 1, 2, 3)
  JOIN (SELECT seed, measure, CASE WHEN measure NOT IN ({', '.join(f"'{m}'" for m in NUMBERS)}) THEN CAST(sum(total) AS BIGINT) END AS numerator, CAST(sum(n) AS BIGINT) AS denominator, count(*) AS subjects, avg(m) AS point FROM v_measure_subject GROUP BY 1, 2) USING (seed, measure) GROUP BY 1, 2""")
def measures(spark, sf):
    """Raw counts, subject-weighted mean and 95% interval of each measure and seed.

    Clips are aggregated before the measures become rows; all measures and seeds share the draws of a replicate.
    """
    e = {m: F.expr(x).cast("double") for m, x in MEASURES.items()}
    clip = anchor_rows(spark, sf).groupBy("seed", "clip_id").agg(F.array(*[F.struct(F.lit(m).alias("measure"), F.sum(x).alias("total"), F.count(x).alias("n")) for m, x in e.items()]).alias("all"))
    clip = clip.select("seed", "clip_id", F.explode("all").alias("a")).select("seed", "clip_id", "a.*").where("n > 0").join(roles.clips(spark, sf).select("clip_id", "subject_id"), "clip_id")
    subject = cut_lineage(clip.groupBy("seed", "measure", "subject_id").agg(F.sum(F.col("total") / F.col("n")).alias("total"), F.count(F.lit(1)).alias("clips"), F.sum("total").alias("hits"), F.sum("n").alias("n")))
    raw = subject.groupBy("seed", "measure").agg(F.when(~F.col("measure").isin(list(NUMBERS)), F.round(F.sum("hits")).cast("bigint")).alias("numerator"), F.sum("n").alias("denominator"), F.count(F.lit(1)).alias("subjects"),
                                                 (r6(F.avg(F.col("total") / F.col("clips"))) + 0).alias("point"))
    i = rs.sorted_interval(rs.bootstrap(subject, R, rs.SEED, "equal_subject", methods=["seed", "measure"]), ["seed", "measure"], "estimate", R)
    return raw.join(i, ["seed", "measure"]).select("seed", "measure", "numerator", "denominator", "subjects", "point", (r6("lower") + 0).alias("lower_95"), (r6("upper") + 0).alias("upper_95"))
