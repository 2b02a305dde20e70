"""Assigning ordered rows to overlapping windows, and dense ordering.

Every operator here keeps work spread over (key, block) pairs, so a key that
owns a large share of the rows is split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windfold.operators.fold import spread
from windfold.session import cut_lineage


def hop_count(n_rows: Column, size: int, step: int) -> Column:
    """Windows of ``size`` rows every ``step`` rows that fit in ``n_rows``."""
    return F.greatest(F.lit(0), F.floor((n_rows - size) / step) + 1).cast("long")


def hop_windows(
    df: DataFrame, index: str, n_rows: Column, size: int, step: int, out: str = "hop_idx"
) -> DataFrame:
    """One output row per (input row, window that contains it).

    Row ``i`` lies in window ``h`` when ``h*step <= i < h*step + size``.  The
    window ids come from ``sequence``, so no range join is planned.  Rows that
    fall in no complete window disappear.
    """
    i = F.col(index)
    lo = F.greatest(F.lit(0), F.ceil((i - (size - 1)) / step)).cast("long")
    hi = F.least(hop_count(n_rows, size, step) - 1, F.floor(i / step).cast("long"))
    hops = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.explode(hops))


def centred_windows(
    df: DataFrame, index: str, n_rows: Column, size: int, step: int, half: int, out: str = "hop_idx"
) -> DataFrame:
    """Rows ``end-half .. end+half-1`` for each hop, ``end = h*step + size``.

    Clipped at both ends of the series; ``end`` is exclusive and need not be an
    existing row.
    """
    i = F.col(index)
    lo = F.greatest(F.lit(0), F.ceil((i - (half - 1) - size) / step)).cast("long")
    hi = F.least(hop_count(n_rows, size, step) - 1, F.floor((i + half - size) / step).cast("long"))
    hops = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.explode(hops))


def hop_blocks(
    df: DataFrame, index: str, size: int, step: int, hops_per_block: int, out: str = "block"
) -> DataFrame:
    """Copy each row to every block of windows that needs it.

    Block ``b`` holds windows ``b*hops_per_block ..``; a block therefore needs
    ``hops_per_block*step`` own rows plus a halo of ``size - step`` rows.  With
    many hops per block the copies cost a few percent, and no task ever holds
    more than one block of one key.
    """
    span = hops_per_block * step
    i = F.col(index)
    lo = F.greatest(F.lit(0), F.ceil((i - (span + size - step) + 1) / span)).cast("long")
    hi = F.floor(i / span).cast("long")
    return df.withColumn(out, F.explode(F.sequence(lo, hi)))


def index_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], grain: Column, out: str = "frame_idx"
) -> DataFrame:
    """Dense 0-based position of each row within its key, without one task per key.

    ``grain`` is a coarse, order-preserving bucket of the order columns (for a
    timestamp: its minute).  Rows are ranked inside (key, bucket) and shifted by
    the number of rows in the key's earlier buckets, which needs a window only
    over the small bucket counts.
    """
    keys, order = list(keys), list(order)
    graded = df.withColumn("__grain", grain)
    counts = graded.groupBy(*keys, "__grain").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__grain").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "__grain", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__grain").orderBy(*order)
    return (
        graded.join(offsets, [*keys, "__grain"])
        .withColumn(out, (F.col("__before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__grain", "__before")
    )


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Dense 0-based position of each row in the order of all rows; equal ones in either order.

    Rows are sorted once in range partitions taken from the data.  A position is
    that within the partition plus the rows of the partitions before it, and those
    sums are one number for each partition.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # the id has the partition above its 33 lower bits
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "__part bigint, __before bigint")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + within).drop("__part", "__at", "__before")


def ahead(tables: dict[str, DataFrame], keys: Sequence[str], index: str, columns: dict[str, tuple[str, int]], block: int = 4096) -> DataFrame:
    """Rows of several tables side by side, each with what lies ahead of it.

    A row of a table is a struct named as the table, with its index, and null in the rows
    of the others.  ``columns`` has SQL aggregates over the structs of the same key from the
    row's index to some indexes further, ``collect_list`` for instance, which lists them in
    index order.  Nothing is joined and no row is copied but the first of a block, which the
    block before it needs: all tables meet in one exchange by (key, block).
    """
    by, rows, reach = ", ".join(keys), None, max(far for _, far in columns.values())
    for name, df in tables.items():
        one = df.select(*keys, index, F.struct(index, *[c for c in df.columns if c not in (*keys, index)]).alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    cut = rows.selectExpr("*", f"explode(if({index} >= {block} AND {index} % {block} < {reach}, array(0, 1), array(0))) AS __halo").selectExpr(
        "*", f"({index} DIV {block}) - __halo AS __block")
    w = f"OVER (PARTITION BY {by}, __block ORDER BY {index} RANGE BETWEEN CURRENT ROW AND {{}} FOLLOWING)"
    out = spread(cut, [*keys, "__block"]).selectExpr("*", *[f"{text} {w.format(far)} AS {name}" for name, (text, far) in columns.items()])
    return out.where("__halo = 0").drop("__halo", "__block")


def neighbour(
    df: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], prefix: str = "prev_", block: int = 4096
) -> DataFrame:
    """Attach the columns of row ``index - 1`` of the same key.

    Same result as ``lag`` on a dense index.  Rows are cut into blocks of
    ``block`` indexes and the last row of each block is copied to the next one,
    so the sort and the window run per (key, block).  A missing predecessor
    gives nulls, also in the middle of a key.
    """
    keys = list(keys)
    by = ", ".join(keys)
    cut = df.selectExpr("*", f"explode(if(({index} + 1) % {block} = 0, array(0, 1), array(0))) AS __halo").selectExpr(
        "*", f"({index} DIV {block}) + __halo AS __block")
    w = f"OVER (PARTITION BY {by}, __block ORDER BY {index})"
    out = cut.selectExpr("*", *[f"if(lag({index}) {w} = {index} - 1, lag({c}) {w}, NULL) AS {prefix}{c}" for c in columns])
    return out.where("__halo = 0").drop("__halo", "__block")
