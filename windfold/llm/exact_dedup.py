"""Exact dedup by a distributed content sort, with DataFrame functions only.

Spark samples splitters of (first bytes, hash, slot) and range-partitions the
normalised texts by them; each partition is sorted externally, so equal texts
are adjacent, and the window operator compares neighbouring texts in full.  A
run of equal texts gives the identifier that stays and the size.  The hash only
parts texts with one beginning.  A text of more than a 65,536th of all rows is
hot: its rows are dealt to ``slots`` runs by identifier, and the runs, one small
row each, meet again by the text's SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windfold.llm import common as c

#: At most so many texts are hot.
HOT_TEXTS = 1 << 16


def _sorted(rows: DataFrame, text: str, slots: int, prefix: int, hot_rows: int) -> tuple[DataFrame, list[str]]:
    """``rows`` dealt by range, with ``_norm``, ``_slot`` (0 for texts that are not hot), and the columns whose equal values make a run."""
    raw = F.coalesce(F.expr(text), F.lit(""))
    keyed = rows.withColumns({"_pre": c.lowered(F.substring(raw, 1, prefix)), "_hash": F.xxhash64(c.lowered(raw))})
    floor = max(hot_rows, rows.count() // HOT_TEXTS + 1)
    hot = [r[0] for r in keyed.groupBy("_hash").count().where(F.col("count") >= floor).select("_hash").collect()]
    slot = F.when(F.col("_hash").isin(hot), 1 + F.pmod(F.xxhash64("_id"), F.lit(slots))).otherwise(0)
    # a constant slot would be folded out of the window's keys, and the texts would be shuffled again
    keys = ["_pre", "_hash", "_slot"] if hot else ["_pre", "_hash"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partitioning already clusters the keys with _norm: no other exchange follows
    dealt = keyed.withColumn("_slot", slot.cast("long")).repartitionByRange(n, *keys).withColumn("_norm", c.lowered(raw))
    return dealt, [*keys, "_norm"]


def _by_id(keep: str):
    return F.col("_id").desc() if keep == "largest" else F.col("_id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", slots: int = 256, prefix: int = 48, hot_rows: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A to Z.  ``keep`` names the
    identifier that stays, "largest" or "smallest".  Null and empty texts are one
    text.  A null identifier ranks below all others.  Of repeated rows with the
    identifier that stays, exactly one is kept.  No rows give no rows; further
    columns are ignored.  Splitters are compared on ``prefix`` characters, so
    what Spark samples to the driver is small; texts are compared whole.  Texts
    of fewer than ``hot_rows`` rows are never cut into slots; that decides on
    the work's division only.
    """
    last = F.max if keep == "largest" else F.min
    dealt, keys = _sorted(c.texts(docs, id_col, text_col), "_text", slots, prefix, hot_rows)
    run = Window.partitionBy(*keys)
    rows = dealt.select("_id", "_slot", F.sha2("_norm", 256).alias("text_sha256"), last("_id").over(run).alias("_keep"), F.count("*").over(run).alias("_n"), F.row_number().over(run.orderBy(_by_id(keep))).alias("_nth"))
    rows = c.settled(rows)
    if "_slot" in keys:
        runs = rows.where("_slot > 0 AND _nth = 1").select("text_sha256", "_slot", "_keep", "_n")
        whole = runs.groupBy("text_sha256").agg(last("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        whole = runs.select("text_sha256", "_slot").join(whole, "text_sha256")
        rows = rows.where("_slot = 0").unionByName(rows.where("_slot > 0").drop("_keep", "_n").join(whole, ["text_sha256", "_slot"]))
    return rows.select(
        c.id_back("_id").alias("doc_id"),
        c.id_back("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        ((F.col("_id") == F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", slots: int = 256, prefix: int = 48, hot_rows: int = 64) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns.

    The documents travel with the sort, and the first row of each run stays; of
    a hot text the runs' first rows, ``slots`` at most, are compared again.
    Common and hot texts are read and shuffled apart, each text once.  Repeated
    rows with the identifier that stays are reduced to one; rows that share an
    identifier but not a text are separate documents.
    """
    dealt, keys = _sorted(c.carried(docs, _id=c.key_of(id_col)), f"_row.`{text_col}`", slots, prefix, hot_rows)
    first = lambda rows, keys: rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(_by_id(keep)))).where("_nth = 1")
    if "_slot" not in keys:
        return first(dealt, keys).select("_row.*")
    hot = first(dealt.where("_slot > 0"), keys).select("_row", "_id", F.sha2("_norm", 256).alias("_sha"))
    return first(dealt.where("_slot < 1"), keys).select("_row").unionByName(first(hot, ["_sha"]).select("_row")).select("_row.*")


EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
