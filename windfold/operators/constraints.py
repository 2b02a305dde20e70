"""Constraints as data: each operator returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windfold.operators.windows import neighbour

# Columns an observation may never contain.
LABEL_COLUMNS = frozenset({"gt_ppg", "gt_hr", "gt_hr_bpm", "c_seq", "b_seq", "subject", "label", "abs_error_bpm", "subject_id", "clip_id", "dataset_id", "split", "split_id", "condition", "view"})


class ConstraintError(ValueError):
    """Raised by :func:`require_none` when a rule is broken."""


def count_if(rule: Column) -> Column:
    return F.sum(F.coalesce(rule, F.lit(False)).cast("bigint"))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: rows checked and rows breaking each rule (true = broken)."""
    return df.agg(F.count(F.lit(1)).alias("rows_checked"), *[F.coalesce(count_if(c), F.lit(0)).cast("bigint").alias(n) for n, c in rules.items()])


def require_none(broken: DataFrame, what: str) -> None:
    """Fail closed: raise when ``broken`` has a row, naming the first few."""
    some = broken.limit(5).collect()
    if some:
        raise ConstraintError(f"{what}: {[r.asDict() for r in some]}")


def contiguous(df: DataFrame, keys: Sequence[str], index: str, start: int = 0) -> DataFrame:
    """Distinct (key, index) rows above ``start`` whose predecessor is missing."""
    once = df.select(*keys, index).distinct()
    return neighbour(once, keys, index, [index], prefix="__p_").where(
        (F.col(index) > start) & F.col(f"__p_{index}").isNull()).drop(f"__p_{index}")


def lattice(df: DataFrame, keys: Sequence[str], index: str, start: int = 0) -> DataFrame:
    """Groups whose index is not exactly start..start+n-1, once each."""
    # Counting per (key, index) first keeps the distinct count inside a partial aggregate.
    per = df.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("__n"))
    g = per.groupBy(*keys).agg(F.sum("__n").alias("row_count"), F.count(F.lit(1)).alias("distinct_count"),
                               F.min(index).alias("min_index"), F.max(index).alias("max_index"))
    return g.where((F.col("row_count") != F.col("distinct_count")) | (F.col("min_index") != start) | (F.col("max_index") != start + F.col("distinct_count") - 1))


def one_sided(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, after reducing both sides to distinct keys."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    return (a.join(b, list(keys), "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull())
            .select(*keys, F.when(F.col("__l").isNull(), "right_only").otherwise("left_only").alias("side")))


def all_or_none(columns: Sequence[str]) -> Column:
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return ~nulls.isin(0, len(columns))


def missing_grid(df: DataFrame, keys: Sequence[str], values: Mapping[str, Iterable | Column]) -> DataFrame:
    """(key, value..) combinations that never occur; ``values`` gives each column's options, listed or as an array column."""
    grid = df.select(*keys).distinct()
    for name, options in values.items():
        grid = grid.withColumn(name, F.explode(options if isinstance(options, Column) else F.array(*[F.lit(o) for o in options])))
    return grid.join(df.select(*keys, *values).distinct(), [*keys, *values], "left_anti")


def many_identities(df: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Groups that carry more than one distinct identity."""
    once = df.select(*keys, *identity).distinct()
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("identities")).where("identities > 1")


def check_observation_names(names: Iterable[str]) -> None:
    """Refuse observation columns that could leak a label or an identity, and an empty or repeated list."""
    names = list(names)
    if not names or len(set(names)) != len(names):
        raise ConstraintError("observation columns must be a list of distinct names")
    bad = sorted(n for n in names if n in LABEL_COLUMNS or n.startswith("gt_"))
    if bad:
        raise ConstraintError(f"observation columns may not contain {bad}")


def covariance_broken(p00: Column, p01: Column, p10: Column, p11: Column) -> Column:
    """2x2 matrix that is not symmetric or not positive semidefinite."""
    scale = F.greatest(F.lit(1.0), F.abs(p00), F.abs(p01), F.abs(p11))
    mid = (p01 + p10) / 2
    return (F.abs(p01 - p10) > 1e-10) | (p00 < 0) | (p11 < 0) | (p00 * p11 - mid * mid < -1e-12 * scale * scale)


def action_stats(rows: DataFrame, keys: Sequence[str], action: Column) -> DataFrame:
    """Statistics of replay rows by key; ``action`` is the one that a fixed arm must take."""
    jump = F.abs(F.col("executed_action") - F.col("previous_action"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hops"), count_if(~F.col("legal")).alias("overrides"), count_if(jump > 0).alias("switches"), F.coalesce(F.avg(jump), F.lit(0.0)).alias("jump"),
        count_if(F.col("proposed_action") != action).alias("proposed_other"), count_if(F.col("executed_action") != action).alias("executed_other"),
        F.max("post_hold_count").alias("hold_max"), F.avg("post_hold_count").alias("hold_mean"), count_if(~F.col("selected_valid")).alias("invalid"))


def fixed_action_rules() -> dict[str, Column]:
    """Rules over :func:`action_stats` of a fixed action (true = broken): it never changes, so its hold grows from 1 to the number of hops."""
    c = F.col
    return {"override_impossible": c("overrides") > 0, "switch_impossible": c("switches") > 0, "jump_impossible": c("jump") > 0, "proposal_mismatch": c("proposed_other") > 0,
            "distribution_foreign": c("executed_other") > 0, "hold_max_broken": c("hold_max") != c("hops"), "hold_mean_broken": F.abs(c("hold_mean") - (c("hops") + 1) / 2) > 1e-12, "invalid_exceeds_hops": c("invalid") > c("hops")}
