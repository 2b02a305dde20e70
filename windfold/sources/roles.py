"""Role views: the engine's tables derived from the driver's star schema.

events   -> frames, daily channel sums, hop measurements, labels
customer -> clip dimension (subject, view, condition)
lineitem -> predictions by arm; part -> their labels
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windfold.functions.columns import hash_draw
from windfold.operators.windows import centred_windows, hop_count, hop_windows, index_rows

def reuse_plan(fn):
    """Build the plan of a derived table once per application and folder.

    Only the logical plan is kept, never data: every query still reads its tables.
    """
    plans: dict = {}

    def cached(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, *[tuple(a) if isinstance(a, list) else a for a in args])
        if key not in plans:
            plans[key] = fn(spark, sf_dir, *args)
        return plans[key]

    cached.__doc__ = fn.__doc__
    return cached


# Channel order of the event role, window geometry in days.
CHANNELS = ("click", "error", "purchase", "signup", "view")
SIZE, STEP, HALF = 3, 1, 4
RANDOM_SEEDS = (0, 1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def channel_index(event_type: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), event_type) - 1).cast("int")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor sample per event; values in cents so that sums are exact."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("clip_id"),
        channel_index(F.col("event_type")).alias("roi_index"),
        "value", F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"),
    )


@reuse_plan
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a dense frame index per clip (time order, id breaks ties)."""
    s = samples(spark, sf_dir)
    return index_rows(s, ["clip_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"))


@reuse_plan
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clip and day: sample count, value sum and k sum by channel, plus the
    clip's day index and day count.  Bounded by the calendar, whatever the number
    of samples a clip has; the sums combine before the shuffle."""
    sums = []
    for i in range(len(CHANNELS)):
        sums += [F.expr(f"sum(if(roi_index = {i}, 1L, 0L))").alias(f"n{i}"),
                 F.expr(f"sum(if(roi_index = {i}, cents, 0L))").alias(f"c{i}"),
                 F.expr(f"sum(if(roi_index = {i}, k, 0L))").alias(f"k{i}")]
    per_day = samples(spark, sf_dir).groupBy("clip_id", "day").agg(*sums)
    return per_day.selectExpr(
        "clip_id", "day - min(day) OVER (PARTITION BY clip_id) AS day_idx",
        "max(day) OVER (PARTITION BY clip_id) - min(day) OVER (PARTITION BY clip_id) + 1 AS n_days", *_SUMS)


_SUMS = [f"{p}{i}" for i in range(len(CHANNELS)) for p in "nck"]


def _sums_by_hop(windowed: DataFrame, lattice: DataFrame) -> DataFrame:
    rows = windowed.select("clip_id", "hop_idx", *_SUMS).union(
        lattice.selectExpr("clip_id", "hop_idx", *[f"0L AS {c}" for c in _SUMS]))
    return rows.groupBy("clip_id", "hop_idx").agg(*[F.expr(f"sum({c}) AS {c}") for c in _SUMS])


def _lattice(days: DataFrame) -> DataFrame:
    """Every hop a clip must have; each clip has exactly one row with day_idx 0."""
    n = hop_count(F.col("n_days"), SIZE, STEP)
    return days.where("day_idx = 0").where(n > 0).select("clip_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("hop_idx"))


@reuse_plan
def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (clip, hop) with channel arrays; null rate = no sample in the window."""
    d = daily(spark, sf_dir)
    w = _sums_by_hop(hop_windows(d, "day_idx", F.col("n_days"), SIZE, STEP), _lattice(d))
    return w.selectExpr(
        "clip_id", "hop_idx",
        _array("if(n{i} > 0, c{i} / (100.0D * n{i}), NULL)", "hr"),
        _array("if(n{i} > 0, (k{i} / (100.0D * n{i})) * (n{i} / (n{i} + 1.0D)), NULL)", "confidence"),
        _array("if(n{i} > 0, k{i} / (100.0D * n{i}), NULL)", "ppr"),
        _array("n{i} / (n{i} + 1.0D)", "coverage"))


def _array(text: str, name: str) -> str:
    """One SQL array with an entry per channel; ``{i}`` is the channel index."""
    return f"array({', '.join(text.format(i=i) for i in range(len(CHANNELS)))}) AS {name}"


@reuse_plan
def historical_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hops under an older rule: a channel needs two samples, means are
    cut to whole cents and points, and the last hop of a clip is missing."""
    d = daily(spark, sf_dir)
    shorter = d.withColumn("n_days", F.col("n_days") - 1)
    w = _sums_by_hop(hop_windows(d, "day_idx", F.col("n_days"), SIZE, STEP), _lattice(d)).join(_lattice(shorter), ["clip_id", "hop_idx"], "left_semi")
    whole = "if(n{{i}} >= 2, floor({c} / n{{i}}) / 100.0D, NULL)"
    return w.selectExpr(
        "clip_id", "hop_idx", _array(whole.format(c="c{i}"), "hr"),
        _array(whole.format(c="k{i}") + " * (n{i} / (n{i} + 1.0D))", "confidence"),
        _array(whole.format(c="k{i}"), "ppr"), _array("n{i} / (n{i} + 1.0D)", "coverage"))


@reuse_plan
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per (clip, hop, channel), invalid rows with a reason."""
    h = hops(spark, sf_dir)
    return h.select(
        "clip_id", "hop_idx",
        F.posexplode(F.arrays_zip(F.col("hr").alias("hr_bpm"), "confidence", "ppr", "coverage")).alias("roi_index", "m"),
    ).select(
        "clip_id", "hop_idx", "roi_index", "m.hr_bpm", "m.confidence", "m.ppr", "m.coverage",
        F.col("m.hr_bpm").isNotNull().alias("valid"),
        F.when(F.col("m.hr_bpm").isNull(), F.lit("missing_required_samples")).alias("invalid_reason"),
    )


@reuse_plan
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth per hop: mean value over a window centred on the hop end."""
    d = daily(spark, sf_dir)
    w = _sums_by_hop(centred_windows(d, "day_idx", F.col("n_days"), SIZE, STEP, HALF), _lattice(d))
    n = " + ".join(f"n{i}" for i in range(len(CHANNELS)))
    c = " + ".join(f"c{i}" for i in range(len(CHANNELS)))
    return w.selectExpr(
        "clip_id", "hop_idx", f"if({n} > 0, ({c}) / (100.0D * ({n})), NULL) AS gt_hr_bpm", f"{n} > 0 AS valid",
        f"if({n} = 0, 'missing_required_samples', NULL) AS invalid_reason")


@reuse_plan
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip dimension."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("clip_id"),
        F.concat(F.lit("S"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("subject_id"),
        F.col("c_mktsegment").alias("view"),
        F.when(F.col("c_acctbal") < 2000, F.lit("after")).otherwise(F.lit("before")).alias("condition"),
        "c_acctbal",
    )


def policy_inputs(hop_rows: DataFrame) -> DataFrame:
    """Adds the random draws and three tabled policies to hop rows.

    Tabled policy of seed s: the channel with the highest confidence (lowest
    index on ties, 0 when none is valid), replaced by a hashed channel on every
    fourth hop of that seed's draw.
    """
    best = ("coalesce(-array_max(transform(confidence, (c, i) -> if(c IS NULL, NULL, named_struct('c', c, 'i', -i)))).i, 0)")
    draws = [hash_draw(s, F.col("clip_id"), F.col("hop_idx")).alias(f"draw_{s}") for s in RANDOM_SEEDS]
    policies = [hash_draw("p", s, F.col("clip_id"), F.col("hop_idx")).alias(f"__p{s}") for s in RANDOM_SEEDS]
    kept = hop_rows.columns
    return hop_rows.select("*", F.expr(best).alias("__best"), *draws, *policies).selectExpr(
        *kept, *[f"draw_{s}" for s in RANDOM_SEEDS],
        *[f"CAST(if(__p{s} % 4 = 0, (__p{s} DIV 4) % {len(CHANNELS)}, __best) AS bigint) AS policy_{s}" for s in RANDOM_SEEDS])


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored hops of three arms: clip = order, subject = part brand.

    The prediction is the unit price under no, half and full discount, the label
    is the part's retail price.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    arms = F.array(*[F.struct(F.lit(m).alias("method_id"), (unit * (1 - F.col("l_discount") * share)).alias("predicted"))
                     for m, share in (("list", 0.0), ("half", 0.5), ("full", 1.0))])
    return li.join(pa, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("clip_id"), F.col("p_brand").alias("subject_id"), F.col("l_linenumber").alias("hop_idx"),
        F.col("l_returnflag").alias("view"), F.col("l_linestatus").alias("condition"),
        F.col("p_retailprice").alias("label"), F.explode(arms).alias("a"),
    ).select("*", "a.method_id", "a.predicted", F.abs(F.col("a.predicted") - F.col("label")).alias("abs_error")).drop("a")
