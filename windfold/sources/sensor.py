"""Strict readers and writers for the sensor tables (S1-S18).

Schemas are fixed and closed: declared, never inferred, header checked against
the declaration, malformed rows fail the read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windfold.operators.constraints import ConstraintError, one_sided, require_none
from windfold.operators.windows import hop_count
from windfold.session import ship

# Region order, camera dimension, file suffixes.
ROIS = ("full_face", "forehead_left", "forehead_right", "temple_left", "temple_right", "nose", "cheek_upper_left", "cheek_upper_right",
        "cheek_lower_left", "cheek_lower_right", "lips", "chin")
ROI_FIELDS = ("r_mean", "g_mean", "b_mean", "std", "coverage")
POSE = ("head_yaw", "head_pitch", "head_roll")
CAMERAS = (("FullHDwebcam", "Frontal", 30.0), ("USBVideo", "SideA", 30.0), ("IriunWebcam", "SideB", 24.0))
STATE_SUFFIX, TRUTH_SUFFIX = "_semantic_state_vectors.csv", "_ground_truth.csv"
NAME = r"^(.+)_(FullHDwebcam|USBVideo|IriunWebcam)_(before|after)"

_D = T.DoubleType()
STATE = T.StructType([T.StructField("frame_idx", T.LongType())] + [T.StructField(c, _D) for c in POSE]
                     + [T.StructField(f"{r}_{f}", _D) for r in ROIS for f in ROI_FIELDS])
TRUTH = T.StructType([T.StructField("frame_idx", T.LongType()), T.StructField("gt_ppg", _D)])
SPLIT = T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("split", T.StringType())])
OBSERVATION = T.StructType(
    [T.StructField("clip_id", T.StringType()), T.StructField("hop_idx", T.LongType())] + [T.StructField(f"obs_{i:03d}", T.FloatType()) for i in range(101)]
    + [T.StructField(f"alt_err_{i:02d}", _D) for i in range(12)] + [T.StructField("executed_action", T.IntegerType()), T.StructField("gt_hr_bpm", _D)])
# Arrays of a historical cache, its version and its rates.
CACHE = frozenset({"hr_meas", "conf", "ppr", "cov", "gt_hr", "view", "condition", "fs", "stem", "cache_schema_version", "gt_subharmonic_labels"})
CACHE_VERSION, CACHE_RATES = 3, (24.0, 30.0)
INVENTORY = "files array<struct<path: string, sha256: string, size: bigint>>"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Closed-schema CSV: the header must equal the declaration and bad cells fail the job."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Typed rows plus the rows with a cell that does not parse (text kept)."""
    text = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    typed = {f.name: F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") for f in schema}
    broken = F.lit(False)
    for f in schema:
        broken = broken | (F.col(f.name).isNotNull() & typed[f.name].isNull())
    return text.where(~broken).select(*[typed[f.name].alias(f.name) for f in schema]), text.where(broken)


def name_parts(file_name: Column) -> list[Column]:
    """clip_id, subject_id, camera_id and condition from a file name."""
    stem = F.regexp_replace(file_name, f"({STATE_SUFFIX}|{TRUTH_SUFFIX})$".replace(".", r"\."), "")
    return [stem.alias("clip_id"), *[F.regexp_extract(stem, NAME + "$", i + 1).alias(n) for i, n in enumerate(("subject_id", "camera_id", "condition"))]]


def camera_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAMERAS), "camera_id string, view string, camera_fps double")


def read_states(spark: SparkSession, root: str) -> DataFrame:
    df = read_csv(spark, f"{root}/*{STATE_SUFFIX}", STATE)
    return df.select(*name_parts(F.col("_metadata.file_name")), *STATE.names)


def read_truth(spark: SparkSession, root: str) -> DataFrame:
    df = read_csv(spark, f"{root}/*{TRUTH_SUFFIX}", TRUTH)
    return df.select(*name_parts(F.col("_metadata.file_name")), *TRUTH.names)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Split assignment; a subject listed twice or an unknown split fails."""
    df = read_csv(spark, path, SPLIT)
    require_none(df.where(~F.coalesce(F.col("split").isin("train", "eval"), F.lit(False)) | (F.length(F.trim("subject_id")) == 0)), "split rows")
    require_none(df.groupBy("subject_id").count().where("count > 1"), "subjects listed twice")
    return df


def discover(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """One row per source file, with the clip dimension joined; unknown names fail."""
    files = spark.read.format("binaryFile").load(f"{root}/*{suffix}").select("path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("file_name"))
    parsed = files.select("path", "bytes", *name_parts(F.col("file_name")))
    require_none(parsed.where("subject_id = ''"), "file names")
    return parsed.join(camera_dimension(spark), "camera_id")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file, ordered by path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def long_frames(states: DataFrame) -> DataFrame:
    """Wide state rows to one row per (clip, frame, region)."""
    regions = F.array(*[F.struct(F.lit(r).alias("roi_name"), *[F.col(f"{r}_{f}").alias(f) for f in ROI_FIELDS]) for r in ROIS])
    return states.select("clip_id", "frame_idx", F.posexplode(regions).alias("roi_index", "v")).select("clip_id", "frame_idx", "roi_index", "v.*")


def wide_frames(long: DataFrame, field: str) -> DataFrame:
    """One column per region; the region list is given, so the pivot needs no extra pass."""
    return long.groupBy("clip_id", "frame_idx").pivot("roi_name", list(ROIS)).agg(F.first(field))


def roi_frames(states: DataFrame) -> DataFrame:
    """Frames with a region array for :func:`windfold.operators.signal.hop_measurements`."""
    region = lambda r: F.struct(F.col(f"{r}_r_mean").alias("r"), F.col(f"{r}_g_mean").alias("g"), F.col(f"{r}_b_mean").alias("b"), F.col(f"{r}_coverage").alias("coverage"))
    return states.select("clip_id", "frame_idx", F.array(*[region(r) for r in ROIS]).alias("rois"))


def build_manifest(spark: SparkSession, root: str, split_path: str) -> dict[str, DataFrame]:
    """Clip, split and dataset tables from the source folder; inconsistent sources fail."""
    state, truth = discover(spark, root, STATE_SUFFIX), discover(spark, root, TRUTH_SUFFIX)
    require_none(one_sided(state, truth, ["clip_id"]), "clips without a state/ground-truth pair")
    split = read_split(spark, split_path)
    require_none(one_sided(state, split, ["subject_id"]), "subjects and split disagree")
    counts = read_states(spark, root).groupBy("clip_id").agg(F.count(F.lit(1)).alias("state_row_count"))
    truth_counts = read_truth(spark, root).groupBy("clip_id").agg(F.count(F.lit(1)).alias("gt_row_count"))
    size, step = F.round(8 * F.col("camera_fps")), F.round(F.col("camera_fps"))
    clips = (state.drop("path", "bytes").join(counts, "clip_id").join(truth_counts, "clip_id").join(split, "subject_id")
             .withColumn("expected_hops", F.greatest(F.lit(0), F.floor((F.col("state_row_count") - size) / step) + 1).cast("bigint")))
    require_none(clips.where("state_row_count <> gt_row_count"), "row counts of the pair")
    dataset = clips.agg(F.countDistinct("clip_id").alias("clips"), F.countDistinct("subject_id").alias("subjects"), F.sum("state_row_count").alias("frames"), F.sum("expected_hops").alias("hops"))
    return {"clips": clips, "splits": split, "dataset": dataset}


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write each table once; an existing table is never overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str, names: Sequence[str] = ("clips", "splits", "dataset")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def _cache_fault(z) -> str | None:
    """The first rule that an opened cache breaks."""
    if set(z.files) != CACHE:
        return f"arrays {sorted(set(z.files) ^ CACHE)} are missing or not known"
    names = ("stem", "view", "condition", "fs", "cache_schema_version", "gt_subharmonic_labels")
    if any(z[n].ndim for n in names):
        return "metadata is not scalar"
    if not all(isinstance(z[n].item(), str) and z[n].item() for n in names[:3]):
        return "names are empty or no text"
    if int(z["cache_schema_version"]) != CACHE_VERSION or bool(z["gt_subharmonic_labels"]) or float(z["fs"]) not in CACHE_RATES:
        return "version, label rule or rate"
    hr, shape = z["hr_meas"], (len(z["hr_meas"]) if z["hr_meas"].ndim else 0, len(ROIS))
    if hr.shape != shape or z["gt_hr"].shape != shape[:1] or any(z[a].shape != shape for a in ("conf", "ppr", "cov")):
        return "arrays do not align"
    if np.isinf(hr).any() or not all(np.isfinite(z[a]).all() for a in ("gt_hr", "conf", "ppr", "cov")):
        return "values are not finite"
    if (z["conf"] < 0).any() or (np.isnan(hr) & (z["conf"] > 0)).any():
        return "confidence without a rate, or negative"
    return None


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Historical NPZ caches to hop rows, one file at a time inside the tasks; a file that breaks a rule fails the job."""
    schema = "clip_id string, fs double, hop_idx bigint, hr array<double>, confidence array<double>, ppr array<double>, coverage array<double>, gt_hr_bpm double"

    def load(frames):
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    fault = _cache_fault(z)
                    if fault:
                        raise ConstraintError(f"cache: {fault}")
                    n = len(z["gt_hr"])
                    yield pd.DataFrame({"clip_id": str(z["stem"]), "fs": float(z["fs"]), "hop_idx": np.arange(n), "hr": list(z["hr_meas"]), "confidence": list(z["conf"]),
                                        "ppr": list(z["ppr"]), "coverage": list(z["cov"]), "gt_hr_bpm": z["gt_hr"]})

    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    raw = files.select("content").mapInPandas(load, schema)
    null = lambda c: F.transform(c, lambda v: F.when(~F.isnan(v), v)).alias(c)
    return raw.select("clip_id", "fs", "hop_idx", null("hr"), null("confidence"), null("ppr"), null("coverage"), "gt_hr_bpm")


def read_inventory_json(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(INVENTORY).json(path, multiLine=True, mode="FAILFAST")
    return df.select(F.explode("files").alias("f")).select("f.*")


def read_results(spark: SparkSession, path: str, schema: T.StructType, arm: str, expected: int) -> DataFrame:
    """Reference results with an equal, known number of rows per arm."""
    df = read_csv(spark, path, schema)
    require_none(df.groupBy(arm).count().where(F.col("count") != expected), "rows per arm")
    return df


def read_observations(spark: SparkSession, glob: str) -> DataFrame:
    df = read_csv(spark, glob, OBSERVATION)
    return df.select("clip_id", "hop_idx", F.array(*[f"obs_{i:03d}" for i in range(101)]).alias("obs"), F.array(*[f"alt_err_{i:02d}" for i in range(12)]).alias("errors"), "executed_action", "gt_hr_bpm")


def write_task_subsets(rows: DataFrame, root: str, family: str) -> DataFrame:
    """Repartition replay rows into (clip, seed) folders and return their index.

    Rows are clustered by clip before the write, so a task opens few folders;
    AQE's rebalance splits a clip that is far larger than the others.
    """
    kept = rows.where(F.col("family") == family).drop("family").hint("rebalance", "clip_id", "seed")
    kept.write.mode("errorifexists").partitionBy("clip_id", "seed").parquet(root)
    back = rows.sparkSession.read.parquet(root)
    return back.groupBy("clip_id", "seed").agg(F.count(F.lit(1)).alias("rows"), F.min("hop_idx").alias("first_hop"), F.max("hop_idx").alias("last_hop"))


def read_task_subset(spark: SparkSession, root: str, clip_id: str, seed: int) -> DataFrame:
    """One (clip, seed): a partition filter, no other folder is read."""
    return spark.read.parquet(root).where((F.col("clip_id") == clip_id) & (F.col("seed") == seed))


def write_subsets(rows: DataFrame, root: str, parts: int = 64) -> DataFrame:
    """Lay replay rows out by (seed, part of the clips) with an index of every (clip, seed) beside them; return the index.

    The number of folders is ``parts`` for each seed, whatever the number of
    clips; raise it with the table.  AQE's rebalance splits a part that is far
    larger than the others.  The index has a digest of hops and actions.
    """
    schema = T.StructType([f for f in rows.schema if f.name not in ("seed", "part")] + [T.StructField("seed", T.IntegerType()), T.StructField("part", T.IntegerType())])
    laid = rows.withColumn("seed", F.col("seed").cast("int")).withColumn("part", F.pmod(F.xxhash64("clip_id"), F.lit(parts)).cast("int"))
    laid.select(*schema.names).hint("rebalance", "seed", "part").write.mode("errorifexists").partitionBy("seed", "part").parquet(f"{root}/rows")
    back = rows.sparkSession.read.schema(schema).parquet(f"{root}/rows")
    subset_digest(back, "seed", "part", "clip_id").write.mode("errorifexists").parquet(f"{root}/index")
    return rows.sparkSession.read.parquet(f"{root}/index")


def subset_digest(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("hop_idx").alias("first_hop"), F.max("hop_idx").alias("last_hop"),
                                   F.sum(F.col("hop_idx") * 31 + F.col("executed_action")).alias("digest"))


def read_subsets(spark: SparkSession, root: str, wanted: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the (clip, seed) pairs in ``wanted``.  The index names their folders; a
    selective ``wanted`` prunes the others while the query runs."""
    laid = T.StructType([f for f in schema if f.name not in ("seed", "part")] + [T.StructField("seed", T.IntegerType()), T.StructField("part", T.IntegerType())])
    index = spark.read.parquet(f"{root}/index").join(wanted.select("clip_id", F.col("seed").cast("int")).distinct(), ["clip_id", "seed"]).select("seed", "part", "clip_id")
    return spark.read.schema(laid).parquet(f"{root}/rows").join(index, ["seed", "part", "clip_id"]).drop("part")


def write_bucketed(df: DataFrame, root: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` in sorted buckets of ``keys`` and return it as a table of that layout.

    Two tables with one layout join on ``keys`` without a shuffle.  Name keys
    that spread a large clip, such as (clip, hop).
    """
    spark, name = df.sparkSession, f"layout_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).option("path", root).saveAsTable(name)
    return spark.table(name)


def write_rows(df: DataFrame, root: str, by: str = "method_id") -> None:
    df.write.mode("errorifexists").partitionBy(by).parquet(root)


def write_report(report: DataFrame, path: str) -> None:
    """Nested report of one row as JSON."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def read_metadata(spark: SparkSession, path: str, clips: DataFrame) -> DataFrame:
    """Corpus metadata; must cover exactly the given clips."""
    df = spark.read.schema("clip_id string, subject_id string, view string, condition string").json(path, mode="FAILFAST")
    require_none(one_sided(df, clips, ["clip_id"]), "metadata coverage")
    return df


def cohort_grid(spark: SparkSession, subjects: int = 15, clips: int = 20, missing: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Planned cohort: ``subjects`` x ``clips``, minus the declared gaps."""
    grid = spark.range(1, subjects + 1).select(F.col("id").alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(clips - 1))).alias("clip"))
    for s, c in missing:
        grid = grid.where(~((F.col("subject") == s) & (F.col("clip") == c)))
    return grid.select("subject", "clip", F.format_string("p%02d_%02d", "subject", "clip").alias("clip_id"))




def run_extractor(producer: Callable[[SparkSession, dict], dict[str, DataFrame]], spark: SparkSession, config: dict, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Run a pluggable row producer and hold its tables to the declared schemas."""
    tables = producer(spark, config)
    if set(tables) != set(schemas):
        raise ConstraintError(f"producer returned {sorted(tables)}, expected {sorted(schemas)}")
    for name, schema in schemas.items():
        got = [(f.name, f.dataType) for f in tables[name].schema]
        if got != [(f.name, f.dataType) for f in schema]:
            raise ConstraintError(f"{name}: schema {got}")
    return tables


def expected_hops(rows: Column, fps: float) -> Column:
    return hop_count(rows, round(8 * fps), round(fps))
