"""Run a streaming plan to the end of its available input and read the result back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windfold.session import checkpoint_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Process what is available and return every emitted row with its ``batch_id``.

    Batches are written as Parquet below the shared checkpoint folder, under a
    fresh name, so no result passes through the driver.
    """
    root = _fresh(stream.sparkSession, folder)
    _drain(stream, mode, root)
    return _emitted(stream, root)


def run_deliveries(spark: SparkSession, tables: Mapping[str, DataFrame], build: Callable[[Mapping[str, DataFrame]], DataFrame], mode: str,
                   by: str = "delivery", folder: str | None = None) -> DataFrame:
    """Deliver the rows of ``tables`` in the order of their column ``by`` and return what the query emits.

    ``build`` makes one streaming query of the tables' streams.  After each
    delivery the query is started anew from its checkpoint, takes what is there,
    moves its watermark and stops: rows of delivery ``d`` meet the watermark of
    all deliveries before it, state lives in the shared folder between them.
    Each table is written once, partitioned by delivery; a delivery then reads
    its own partition only.  The driver sees the different values of ``by``.
    """
    root = _fresh(spark, folder)
    staged, values = {}, set()
    for name, df in tables.items():
        df.write.partitionBy(by).parquet(f"{root}/staged/{name}")
        staged[name] = spark.read.schema(df.schema).parquet(f"{root}/staged/{name}")
        values |= {r[0] for r in staged[name].select(by).distinct().collect()}
        df.limit(0).drop(by).write.parquet(f"{root}/in/{name}")
    streams = {name: spark.readStream.schema(df.drop(by).schema).parquet(f"{root}/in/{name}") for name, df in staged.items()}
    query = build(streams)
    for value in sorted(values):
        for name, df in staged.items():
            df.where(F.col(by) == value).drop(by).write.mode("append").parquet(f"{root}/in/{name}")
        _drain(query, mode, root)
    return _emitted(query, root)


def _fresh(spark: SparkSession, folder: str | None) -> str:
    return f"{folder or checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drain(stream: DataFrame, mode: str, root: str) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _emitted(stream: DataFrame, root: str) -> DataFrame:
    return stream.sparkSession.read.schema(_with_batch(stream)).parquet(f"{root}/out")


def _with_batch(stream: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last emitted version of each key (update mode)."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v")).select(*keys, "v.*")


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
