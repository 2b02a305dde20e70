"""Strict JSON and timestamps against Python's json and datetime; rules of fixed actions on seeded faults."""

import datetime
import json

from windfold.functions import strict as st
from windfold.operators import constraints as co
from pyspark.sql import functions as F

TEXTS = ['{}', '{"a": 1}', '{"a": 1, "a": 2}', '{"a": {"b": 1}, "b": {"b": 2}}', '{"a": {"b": 1, "b": 2}}', '{"a": [{"b": 1}, {"b": 2}]}', '{"a": [{"b": 1, "c": {"b": 3}, "b": 2}]}', '{"a\\u0062": 1, "ab": 2}',
         '{"a": "NaN"}', '{"a": NaN}', '{"a": -Infinity}', '{"NaN": 1}', '[1]', '3', '', ' {"a" : 1 , "b":"a\\":{" , "c":{"a":1}} ', '{"a": 1', '{"a": 1}}', "{'a': 1}", '{"a": 01}', '{"a": "}", "b": "{", "a": 0}', '{"k": "x\\\\", "y": 1}',
         '{"long": "' + "\\n\u00e9" * 20000 + '"}', '{"": 1, "": 2}']


def strict(text):
    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated")
        return dict(items)

    def constant(_):
        raise ValueError("constant")

    try:
        return isinstance(json.loads(text, object_pairs_hook=pairs, parse_constant=constant), dict)
    except ValueError:
        return False


def test_json_faults(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string").select("i", st.json_fault(F.col("t")).alias("fault"), st.repeated_key(F.col("t")).alias("again")).collect()
    found = {r.i: r.fault for r in rows}
    assert {i: found[i] is None for i in range(len(TEXTS))} == {i: strict(t) for i, t in enumerate(TEXTS)}
    assert found[99] == "missing" and found[2] == found[4] == found[6] == found[7] == found[20] == "duplicate_key" and found[9] == "bad_constant" and found[12] == "not_object" and found[16] == "malformed"


def test_utc_stamps(spark):
    texts = ["2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00Z", "2024-01-01T24:00:00Z", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.unix_micros(st.utc_stamp(F.col("t"))).alias("us")).collect()

    def plain(t):
        at = datetime.datetime.fromisoformat(t[:-1] + "+00:00")
        return round(at.timestamp() * 1e6)

    got = {r.i: r.us for r in rows}
    assert got == {0: plain(texts[0]), 1: None, 2: plain(texts[2])} | {i: None for i in range(3, 8)}


def test_fixed_action_rules(spark):
    schema = "clip string, executed_action bigint, previous_action bigint, proposed_action bigint, post_hold_count bigint, legal boolean, selected_valid boolean"
    good = [("a", 2, None if h == 1 else 2, 2, h, True, h > 1) for h in range(1, 5)]
    faults = [("switch", 2, None, 2, 1, True, True), ("switch", 3, 2, 2, 1, True, True), ("override", 2, None, 2, 1, False, True), ("hold", 2, None, 2, 1, True, True), ("hold", 2, 2, 2, 1, True, True), ("other", 2, None, 4, 1, True, True)]
    rows = co.action_stats(spark.createDataFrame(good + faults, schema), ["clip"], F.lit(2)).select("clip", *[c.alias(n) for n, c in co.fixed_action_rules().items()]).collect()
    broken = {r.clip: {n for n, v in r.asDict().items() if v is True} for r in rows}
    assert broken == {"a": set(), "switch": {"switch_impossible", "jump_impossible", "distribution_foreign", "hold_max_broken", "hold_mean_broken"}, "override": {"override_impossible"},
                      "hold": {"hold_max_broken", "hold_mean_broken"}, "other": {"proposal_mismatch"}}
