"""Strict JSON and timestamps over the event rows (S7), fixed-arm statistics by source (V13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from windfold.functions import strict as st
from windfold.operators import constraints as co
from windfold.operators import replay as rp
from windfold.plans import common
from windfold.plans.registry import query, view
from windfold.sources import roles

# Each event type gets its properties in another form, so that every fault occurs.
view("v_given_json", """SELECT event_type, CASE event_type WHEN 'click' THEN props WHEN 'error' THEN replace(props, '}', ', "k": 1}') WHEN 'purchase' THEN regexp_replace(props, '[0-9]+', 'NaN')
  WHEN 'signup' THEN '[' || props || ']' ELSE CASE WHEN event_id % 2 = 0 THEN replace(props, '}', '') ELSE replace(props, '}', ', "NaN": {"k": "}"}}') END END AS given FROM events""")


@query("s07_strict_json", r"""SELECT event_type, fault, count(*) AS n FROM (SELECT event_type, CASE WHEN given IS NULL THEN 'missing' WHEN regexp_matches(regexp_replace(given, '"(?:[^"\\]|\\.)*"', '""', 'g'), 'NaN|Infinity') THEN 'bad_constant'
  WHEN ltrim(given)[1] <> '{' THEN 'not_object' WHEN NOT json_valid(given) THEN 'malformed' WHEN len(json_keys(given)) <> len(list_distinct(json_keys(given))) THEN 'duplicate_key' ELSE 'none' END AS fault FROM v_given_json) GROUP BY 1, 2""")
def strict_json(spark, sf):
    """Faults of JSON texts by kind: repeated keys and NaN, which lenient readers let pass, among them."""
    e = roles.table(spark, sf, "events")
    kind = F.col("event_type")
    more = lambda s: F.replace("props", F.lit("}"), F.lit(s))
    given = (F.when(kind == "click", F.col("props")).when(kind == "error", more(', "k": 1}')).when(kind == "purchase", F.regexp_replace("props", "[0-9]+", "NaN")).when(kind == "signup", F.concat(F.lit("["), "props", F.lit("]")))
             .otherwise(F.when(F.col("event_id") % 2 == 0, more("")).otherwise(more(', "NaN": {"k": "}"}}'))))
    return e.groupBy("event_type", F.coalesce(st.json_fault(given), F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("s07_utc_stamps", """SELECT event_type, count(*) AS rows_checked, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS accepted, CAST(max(epoch(date_trunc('second', ts))) FILTER (event_type NOT IN ('error', 'signup')) AS BIGINT) AS latest FROM events GROUP BY 1""")
def utc_stamps(spark, sf):
    """Timestamps as text with and without the closing Z, and in a month that does not exist."""
    e = roles.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(text, F.lit("+00:00"))).when(kind == "signup", F.concat(F.overlay(text, F.lit("13"), 6), F.lit("Z"))).otherwise(F.concat(text, F.lit("Z")))
    stamp = st.utc_stamp(text)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_checked"), F.count(stamp).alias("accepted"), F.max(F.unix_seconds(stamp)).alias("latest"))


view("v_fixed_rows", """SELECT 'current' AS source, method_id, clip_id, executed_action AS e, previous_action AS p, proposed_action AS q, post_hold_count AS h, legal, selected_valid AS ok FROM v_replay WHERE family = 'fixed'
  UNION ALL SELECT 'historical', t.method_id, s.clip_id, s.executed, s.previous, s.proposed, s.hold, s.legal, s.hr IS NOT NULL FROM v_hist_steps s JOIN v_methods t ON t.m = s.m WHERE s.hop_idx >= 0""")


@query("v13_fixed_arm_stats", """SELECT source, count(*) AS rows_checked, count(*) FILTER (overrides > 0) AS override_impossible, count(*) FILTER (switches > 0) AS switch_impossible, count(*) FILTER (jump > 0) AS jump_impossible,
  count(*) FILTER (proposed_other > 0) AS proposal_mismatch, count(*) FILTER (executed_other > 0) AS distribution_foreign, count(*) FILTER (hold_max <> hops) AS hold_max_broken,
  count(*) FILTER (abs(hold_mean - (hops + 1) / 2.0) > 1e-12) AS hold_mean_broken, count(*) FILTER (invalid > hops) AS invalid_exceeds_hops, sum(hops) AS hops, sum(invalid) AS invalid_hops FROM (
  SELECT source, method_id, clip_id, count(*) AS hops, count(*) FILTER (NOT legal) AS overrides, count(*) FILTER (e <> p) AS switches, coalesce(avg(abs(e - p)), 0) AS jump, count(*) FILTER (q <> CAST(substr(method_id, 5) AS BIGINT)) AS proposed_other,
    count(*) FILTER (e <> CAST(substr(method_id, 5) AS BIGINT)) AS executed_other, max(h) AS hold_max, avg(h) AS hold_mean, count(*) FILTER (NOT ok) AS invalid FROM v_fixed_rows GROUP BY 1, 2, 3) GROUP BY 1""")
def fixed_arm_stats(spark, sf):
    """Action statistics of the fixed arms by clip, old and new hops, and the rules that a fixed action must obey."""
    arms = [m[0] for m in common.METHODS if m[1] == "fixed"]
    old = rp.replay(roles.historical_hops(spark, sf), [rp.fixed_selector(a) for a in range(len(arms))])
    cols = ["method_id", "clip_id", "executed_action", "previous_action", "proposed_action", "post_hold_count", "legal", "selected_valid"]
    rows = common.replayed(spark, sf, arms).select(F.lit("current").alias("source"), *cols).unionByName(old.select(F.lit("historical").alias("source"), *cols))
    stats = co.action_stats(rows, ["source", "method_id", "clip_id"], F.substring("method_id", 5, 9).cast("bigint"))
    return stats.groupBy("source").agg(F.count(F.lit(1)).alias("rows_checked"), *[co.count_if(c).alias(n) for n, c in co.fixed_action_rules().items()], F.sum("hops").alias("hops"), F.sum("invalid").alias("invalid_hops"))
