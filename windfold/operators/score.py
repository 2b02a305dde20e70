"""Label joins, two-sided comparison and equal-weighted aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windfold.operators.constraints import require_none
from windfold.operators.windows import neighbour

HOP = ["clip_id", "hop_idx"]
#: Columns of the preceding hop that the clip level needs.
STEP = ["executed_action", "proposed_action", "selected_hr_bpm", "post_belief_hr_bpm"]


def score(predictions: DataFrame, labels: DataFrame, keys: Sequence[str], predicted: str = "post_belief_hr_bpm",
          label: str = "gt_hr_bpm", strict: bool = True) -> DataFrame:
    """Equi-join on the hop key; the label adds only itself and the error.

    A hop without a usable label, or a label without a hop, is refused.  With
    ``strict=False`` such hops are left out; ``label_coverage`` counts them.
    """
    if strict:
        require_none(label_gaps(predictions, labels, keys), "hops and usable labels differ")
    usable = labels.where("valid").select(*keys, label)
    return predictions.join(usable, list(keys)).withColumn("abs_error_bpm", F.abs(F.col(predicted) - F.col(label)))


def label_gaps(predictions: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hop keys that lack a usable label, and labels no hop asks for."""
    left = predictions.select(*keys).distinct().withColumn("in_hops", F.lit(True))
    right = labels.where("valid").select(*keys).withColumn("in_labels", F.lit(True))
    return (left.join(right, list(keys), "full_outer")
            .where(F.col("in_hops").isNull() | F.col("in_labels").isNull())
            .select(*keys, F.coalesce("in_hops", F.lit(False)).alias("in_hops"), F.coalesce("in_labels", F.lit(False)).alias("in_labels")))


def label_coverage(predictions: DataFrame, labels: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Hops per group, and how many of them have no usable label."""
    usable = labels.where("valid").select(*keys, F.lit(True).alias("__usable"))
    return predictions.select(*dict.fromkeys([*by, *keys])).join(usable, list(keys), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("hops"), (F.count(F.lit(1)) - F.count("__usable")).alias("unlabelled"))


def clip_rows(rows: DataFrame, by: Sequence[str], channels: int) -> DataFrame:
    """Clip level: error, counts, switches and the action histogram.

    ``by`` must contain the clip key.  The switch needs only the preceding row,
    fetched with a blocked lag, so a long clip is not pulled into one task.
    """
    return clip_sums(neighbour(rows, list(by), "hop_idx", STEP), by, channels)


def clip_sums(with_prev: DataFrame, by: Sequence[str], channels: int) -> DataFrame:
    """``clip_rows`` of rows that have the columns ``STEP`` of their neighbour already."""
    keys = list(by)
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    jump = lambda c: F.abs(F.col(c) - F.col("prev_" + c))
    has_prev = F.col("prev_executed_action").isNotNull()
    return with_prev.groupBy(*keys).agg(
        F.avg("abs_error_bpm").alias("mae_bpm"),
        F.count(F.lit(1)).alias("hop_count"),
        count(~F.col("selected_valid")).alias("invalid_selected_count"),
        count(F.col("executed_action") != F.col("prev_executed_action")).alias("switch_count"),
        count(F.col("proposed_action") != F.col("prev_proposed_action")).alias("proposed_switch_count"),
        count(~F.col("legal")).alias("override_count"),
        F.avg("post_hold_count").alias("hold_mean"),
        F.max("post_hold_count").alias("hold_max"),
        F.coalesce(F.avg(jump("executed_action")), F.lit(0.0)).alias("roi_index_jump_mean_abs"),
        F.coalesce(F.avg(jump("selected_hr_bpm")), F.lit(0.0)).alias("selected_hr_jump_mean_abs_bpm"),
        F.coalesce(F.avg(jump("post_belief_hr_bpm")), F.lit(0.0)).alias("belief_jump_mean_abs_bpm"),
        F.sum(F.coalesce(jump("selected_hr_bpm"), F.lit(0.0))).alias("hr_jump_sum_zero_filled"),
        F.sum(F.coalesce(jump("post_belief_hr_bpm"), F.lit(0.0))).alias("belief_jump_sum_zero_filled"),
        F.sum(F.when(has_prev & (F.col("executed_action") != F.col("prev_executed_action")), jump("executed_action"))).alias("switch_distance_sum"),
        *action_counts("executed_action", channels),
    )


def action_counts(action: str, channels: int) -> list[Column]:
    return [F.sum((F.col(action) == i).cast("bigint")).alias(f"action_count_{i:02d}") for i in range(channels)]


def equal_weight(df: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Mean of means: average ``value`` within the first level, then average those
    within the next, and so on.  Each level combines before it shuffles."""
    out = df
    column = value
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(column).alias("__mean"))
        column = "__mean"
    return out.withColumnRenamed("__mean", value)


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two key-aligned tables as ``l`` and ``r`` structs.

    ``presence`` is ``joined``, ``left_only`` or ``right_only``.
    """
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    both = pack(left, "l").join(pack(right, "r"), list(keys), "full_outer")
    return both.withColumn("presence", F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("joined"))


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], numbers: Sequence[str], exact: Sequence[str] = (),
                tolerance: float = 1e-12) -> DataFrame:
    """Rows where two tables disagree beyond ``tolerance`` or on which side they exist."""
    c = compare(left, right, keys)
    wrong = F.col("presence") != "joined"
    for n in numbers:
        a, b = F.col(f"l.{n}"), F.col(f"r.{n}")
        wrong = wrong | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
    for n in exact:
        wrong = wrong | ~F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return c.where(wrong)


def headroom(value: Column, low: Column, high: Column) -> Column:
    """Share of the way from ``high`` (plain) to ``low`` (best possible), in percent."""
    return (high - value) / F.nullif(high - low, F.lit(0.0)) * 100
