"""Derived tables several queries start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windfold.operators import replay as rp
from windfold.operators.windows import neighbour
from windfold.sources import roles

METHODS = (
    *[(f"arm_{a}", "fixed", None) for a in range(len(roles.CHANNELS))],
    ("max_ppr", "simple_selector", None),
    *[(f"random_seed{s}", "random_null", s) for s in roles.RANDOM_SEEDS],
    *[(f"tabled_seed{s}", "tabled", s) for s in roles.RANDOM_SEEDS],
)


def selectors(names: Sequence[str] | None = None) -> list[rp.Selector]:
    out = [rp.fixed_selector(a) for a in range(len(roles.CHANNELS))]
    out.append(rp.max_ratio_selector())
    out += [rp.random_selector(f"draw_{s}", f"random_seed{s}") for s in roles.RANDOM_SEEDS]
    out += [rp.proposal_selector(f"policy_{s}", f"tabled_seed{s}") for s in roles.RANDOM_SEEDS]
    return [s for s in out if names is None or s.method in names]


def kinds(names: Sequence[str] | None = None) -> list[str]:
    """SQL of a method's family and seed."""
    chosen = [m for m in METHODS if names is None or m[0] in names]
    case = lambda i: " ".join(f"WHEN '{m[0]}' THEN {m[i]!r}" for m in chosen if m[i] is not None)
    seed = f"CASE method_id {case(2)} END" if case(2) else "CAST(NULL AS int)"
    return [f"CASE method_id {case(1)} END AS family", f"{seed} AS seed"]


def methods(names: Sequence[str] | None = None) -> list[str]:
    return [s.method for s in selectors(names)]


@roles.reuse_plan
def replayed(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Hop rows of the named methods (all by default); no label column."""
    hops = roles.policy_inputs(roles.hops(spark, sf_dir))
    return rp.replay(hops, selectors(names)).selectExpr("*", *kinds(names))


@roles.reuse_plan
def scored_hops(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Replayed hops beside their labels, the methods still packed: a hop is joined once, not once for each method."""
    hops = rp.packed_replay(roles.policy_inputs(roles.hops(spark, sf_dir)), selectors(names))
    return hops.join(roles.labels(spark, sf_dir).where("valid").select("clip_id", "hop_idx", "gt_hr_bpm"), ["clip_id", "hop_idx"])


def _scored(hops: DataFrame, names: Sequence[str] | None, beside: Sequence[str]) -> DataFrame:
    rows = rp.unpacked(hops, methods(names), ["clip_id", "hop_idx", "gt_hr_bpm", *beside]).selectExpr("*", *kinds(names))
    rest = [c for c in rows.columns if c not in ("clip_id", "hop_idx", "gt_hr_bpm", *beside)]
    return rows.select("clip_id", "hop_idx", *rest, "gt_hr_bpm", F.abs(F.col("post_belief_hr_bpm") - F.col("gt_hr_bpm")).alias("abs_error_bpm"), *beside)


@roles.reuse_plan
def scored(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Replayed hops joined to labels, then to the clip dimension."""
    dims = roles.clips(spark, sf_dir).drop("c_acctbal")
    return _scored(scored_hops(spark, sf_dir, names).join(dims, "clip_id"), names, [c for c in dims.columns if c != "clip_id"])


@roles.reuse_plan
def scored_steps(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Replayed hops joined to labels, with the ``prev_`` columns of ``score.STEP``."""
    from windfold.operators.score import STEP

    return _scored(neighbour(scored_hops(spark, sf_dir, names), ["clip_id"], "hop_idx", STEP), names, [])


@roles.reuse_plan
def labelled_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.hops(spark, sf_dir).join(
        roles.labels(spark, sf_dir).where("valid").select("clip_id", "hop_idx", "gt_hr_bpm"), ["clip_id", "hop_idx"])


@roles.reuse_plan
def historical(spark: SparkSession, sf_dir: str, arms: Sequence[int] | None = None) -> DataFrame:
    """Fixed arms replayed on the historical hops, scored against today's labels."""
    from windfold.operators.score import score

    chosen = [rp.fixed_selector(a) for a in (range(len(roles.CHANNELS)) if arms is None else arms)]
    return score(rp.replay(roles.historical_hops(spark, sf_dir), chosen), roles.labels(spark, sf_dir), ["clip_id", "hop_idx"], strict=False)


@roles.reuse_plan
def score_rows(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Replayed hops joined to labels, without the clip dimension."""
    return _scored(scored_hops(spark, sf_dir, names), names, [])
