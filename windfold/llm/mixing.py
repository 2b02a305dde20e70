"""Temperature mixing of sources, with DataFrame functions only.

The weight of a source is its token share to the power ``alpha``, normalised.
``alpha`` is bisected in [0, 1] to meet a repetition limit or a target entropy,
and the weights are then realised as budgets of tokens: a source goes through
its documents in whole passes and one part of a pass, in the order of a
permutation of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windfold.llm import common as c

#: Halvings of [0, 1].
STEPS = 50


def source_weights(tokens: DataFrame, max_repetition: float | None = 4.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """``tokens`` (source, tokens long) with ``share, alpha, weight, budget``.

    Give one of ``max_repetition`` (largest number of passes over any source) or
    ``entropy`` (in nats, of the weights).  With a repetition limit the largest
    ``alpha`` that the limit needs is 1 (plain shares) and smaller ones are more
    even; the smallest that holds the limit is taken.  With an entropy, the
    largest ``alpha`` whose weights have at least that entropy.  Without a
    ``budget``, the budget is the one at which the source that is repeated least
    is passed once, so no document is left out.  Sources are a dimension: their
    totals are one array.
    """
    if (max_repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    live = tokens.where("tokens > 0")
    one = live.agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("_s"), F.sum("tokens").alias("_total"))
    logs = "transform(_s, x -> ln(x.tokens / _total))"
    if entropy is None:
        # passes over a source are weight * budget / tokens
        limit = f"{float(max_repetition)!r}D"
        b = f"{int(budget)}D" if budget else None
        most = "aggregate(_l, 0D, (z, x) -> z + exp(m * x))"
        passes = f"(array_max(transform(_l, x -> exp((m - 1D) * x))) / {most} * {b} / _total)" if b else "(exp((m - 1D) * array_min(_l)) / exp((m - 1D) * array_max(_l)))"
        low_is_bad, ok = True, f"{passes} <= {limit}"
    else:
        z = "aggregate(_l, 0D, (z, x) -> z + exp(m * x))"
        h = f"aggregate(_l, 0D, (h, x) -> h - exp(m * x) / {z} * (m * x - ln({z})))"
        low_is_bad, ok = False, f"{h} >= {float(entropy)!r}D"
    # the invariant: [lo, hi] holds the boundary between where ok holds and where it does not
    go_down = ok if low_is_bad else f"NOT ({ok})"
    step = f"aggregate(array((s.lo + s.hi) / 2D), s, (t, m) -> IF({go_down}, named_struct('lo', t.lo, 'hi', m), named_struct('lo', m, 'hi', t.hi)))"
    pick = "hi" if low_is_bad else "lo"
    solved = one.selectExpr("_s", "_total", f"{logs} AS _l")
    solved = solved.selectExpr("_s", "_total", "_l", f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> {step}).{pick} AS alpha")
    solved = solved.selectExpr("_s", "_total", "alpha", "_l", "transform(_l, x -> exp(alpha * x)) AS _p").selectExpr("*", "aggregate(_p, 0D, (z, x) -> z + x) AS _z")
    whole = f"{int(budget)}D" if budget else "array_max(zip_with(_s, _p, (s, p) -> s.tokens * _z / p))"
    solved = solved.selectExpr("*", f"{whole} AS _budget")
    return solved.selectExpr("inline(zip_with(_s, _p, (s, p) -> named_struct('source', s.source, 'tokens', s.tokens, 'share', s.tokens / _total, 'alpha', alpha, 'weight', p / _z, 'budget', CAST(round(_budget * p / _z) AS BIGINT))))")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repetition: float | None = 4.0, entropy: float | None = None, budget: int | None = None, blocks: int = 4096, seed: int = 7) -> DataFrame:
    """One row per document and pass: ``doc_id, source, tokens, epoch, block, place``.

    ``tokens`` are the words of a text.  A document belongs to one of ``blocks``
    blocks by a hash of its identifier, seeded: ordering by (source, epoch,
    block, place) is a permuted pass over the source.  A part of a pass takes
    whole blocks in order while they fit the budget, then documents of the next
    block in order while they fit.  Documents without words stay at one pass and
    cost nothing.  A null source is a source of its own; a null identifier ranks
    first in its block; repeated rows are documents of their own.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string")))
    words = F.size(F.split(F.trim(F.regexp_replace("_text", "[\\x09-\\x0D]", " ")), " +"))
    base = docs.select(c.key_of(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.select("_id", "source", F.when(F.length(F.trim(F.regexp_replace("_text", "[\\x09-\\x0D]", " "))) > 0, words).otherwise(0).cast("long").alias("tokens"), hashed.alias("_h"))
    base = c.settled(base.withColumns({"block": (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % blocks).cast("int")}))
    sums = base.groupBy("source", "block").agg(F.sum("tokens").alias("_block"))
    totals = sums.groupBy("source").agg(F.sum("_block").alias("tokens"))
    weights = source_weights(totals, max_repetition, entropy, budget).select("source", F.col("tokens").alias("_all"), F.col("budget").alias("_budget"))
    # at most `blocks` rows of a source meet in this window
    before = F.sum("_block").over(Window.partitionBy("source").orderBy("block")) - F.col("_block")
    weights = weights.withColumnRenamed("source", "_of")
    part = sums.withColumn("_before", before).join(weights, F.col("source").eqNullSafe(F.col("_of")), "left")
    part = part.select(F.col("source").alias("_source"), F.col("block").alias("_nr"), "_block", "_before", (F.col("_budget") / F.col("_all")).cast("long").alias("_passes"), (F.col("_budget") % F.col("_all")).alias("_rest"))
    part = part.withColumn("_state", F.when(F.col("_rest").isNull(), 0).when(F.col("_before") + F.col("_block") <= F.col("_rest"), 2).when(F.col("_before") < F.col("_rest"), 1).otherwise(0))
    joined = base.join(part, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_nr"))).select("_id", "source", "tokens", "block", "_h", "_passes", "_state", (F.col("_rest") - F.col("_before")).alias("_room"))
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy("_h", "_id", "tokens"))
    joined = joined.withColumn("place", place)
    used = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.when(F.col("tokens") == 0, 0).when(F.col("_state") == 2, 1).when((F.col("_state") == 1) & (used <= F.col("_room")), 1).otherwise(0)
    copies = F.when(F.col("tokens") == 0, 1).otherwise(F.coalesce("_passes", F.lit(0)) + extra)
    out = joined.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return out.select(c.id_back("_id").alias("doc_id"), "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("epoch"), "block", "place")


def remix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mixture` passes it, and with its columns only."""
    rows = mixture(docs, id_col=id_col, source_col=source_col, **options)
    times = rows.groupBy(F.coalesce("doc_id", F.lit(c.NULL_ID)).alias("_id"), F.col("source").alias("_source")).agg(F.count("*").alias("_n"), F.countDistinct("place", "block").alias("_rows"))
    marked = c.carried(docs, _key=c.key_of(id_col), _from=F.col(source_col).cast("string"))
    joined = marked.join(times, (F.col("_key") == F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_n") / F.col("_rows")).cast("int")))).select("_row.*")


MIXTURE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D]', ' ', 'g'), ' ') = '' THEN 0
    ELSE len(regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D]', ' ', 'g'), ' '), ' +')) END AS tokens, md5('7:' || doc_id) AS h
  FROM documents),
b AS (SELECT *, CAST(('0x' || substr(h, 1, 8))::UBIGINT % 4096 AS INTEGER) AS block FROM d),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM b GROUP BY 1 HAVING sum(tokens) > 0),
l AS (SELECT source, tokens, ln(tokens / sum(tokens) OVER ()) AS l FROM s),
e AS (SELECT min(l) AS lo_l, max(l) AS hi_l FROM l),
bis AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN exp(((lo + hi) / 2 - 1) * lo_l) / exp(((lo + hi) / 2 - 1) * hi_l) <= 4 THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN exp(((lo + hi) / 2 - 1) * lo_l) / exp(((lo + hi) / 2 - 1) * hi_l) <= 4 THEN (lo + hi) / 2 ELSE hi END
  FROM bis, e WHERE i < 50),
p AS (SELECT source, tokens, exp((SELECT hi FROM bis WHERE i = 50) * l) AS p FROM l),
w AS (SELECT source, tokens, CAST(round((SELECT max(tokens * (SELECT sum(p) FROM p) / p) FROM p) * p / (SELECT sum(p) FROM p)) AS BIGINT) AS budget FROM p),
k AS (SELECT source, block, sum(tokens)::BIGINT AS bt, (sum(sum(tokens)) OVER (PARTITION BY source ORDER BY block) - sum(tokens))::BIGINT AS before FROM b GROUP BY 1, 2),
j AS (
  SELECT b.doc_id, b.source, b.tokens, b.block, b.h, budget // w.tokens AS passes, budget % w.tokens AS rest, before, bt,
    row_number() OVER (PARTITION BY b.source, b.block ORDER BY h, doc_id) AS place
  FROM b JOIN k USING (source, block) LEFT JOIN w USING (source)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY place) AS used FROM j),
c AS (
  SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE coalesce(passes, 0) + CASE WHEN before + bt <= rest THEN 1 WHEN before < rest AND used <= rest - before THEN 1 ELSE 0 END END AS copies FROM u)
SELECT doc_id, source, tokens, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS epoch, block, place FROM c WHERE copies > 0
"""
