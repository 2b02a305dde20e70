"""Column expressions: hash draws, content ids, observations, filter step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_draw(*parts: Column | int | str) -> Column:
    """Deterministic 32-bit draw from the parts (first 8 hex digits of an MD5)."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def content_id(prefix: str, columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON form of the columns in sorted name order."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def digest(*columns: Column) -> Column:
    """SHA-256 over the columns joined by '|'; null is written as an empty field."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def finite(c: Column) -> Column:
    inf = F.lit(float("inf"))
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def filter_step(mean: Column, velocity: Column, p00: Column, p01: Column, p10: Column, p11: Column,
                value: Column, confidence: Column) -> dict[str, Column]:
    """One predict/update of the belief filter as expressions (no fold)."""
    x = mean + velocity
    q00 = p00 + p01 + p10 + p11 + F.lit(0.1) / 3
    q10 = p10 + p11 + F.lit(0.1) / 2
    use = finite(value) & finite(confidence) & (confidence > 0)
    total = q00 + F.lit(200.0) / F.greatest(confidence, F.lit(1e-6))
    g0 = F.when(use, q00 / total).otherwise(F.lit(0.0))
    g1 = F.when(use, q10 / total).otherwise(F.lit(0.0))
    miss = F.when(use, value).otherwise(x) - x
    return {"mean": x + g0 * miss, "velocity": velocity + g1 * miss, "valid": use}


def agreement(values: Column, tolerance: float = 5.0) -> Column:
    """Per channel: share of the *other* valid channels within ``tolerance``.

    An array function over the channel array, so no self join is planned; null
    marks an invalid channel and yields 0.
    """
    others = F.size(F.filter(values, lambda v: v.isNotNull())) - 1

    def share(v: Column) -> Column:
        near = F.size(F.filter(values, lambda o: o.isNotNull() & (F.abs(o - v) <= tolerance))) - 1
        return F.when(v.isNotNull() & (others > 0), near / F.nullif(others, F.lit(0))).otherwise(F.lit(0.0)).cast("double")

    return F.transform(values, share)


def observation(channels: int, hr: Column, confidence: Column, ppr: Column, coverage: Column, agree: Column,
                mean: Column, p00: Column, velocity: Column, since_confident: Column, previous: Column, hold: Column) -> Column:
    """The controller's observation: 7 values per channel, 4 belief values, a
    one-hot of the previous action and the hold count (101 values for 12 channels).

    Invalid channels: the rate slots take the belief mean, confidence and ratio
    are 0, coverage is kept.
    """
    out = []
    for i in range(channels):
        v = hr[i]
        rate = F.coalesce(v, mean)
        zero = lambda c: F.when(v.isNotNull(), clip01(c)).otherwise(F.lit(0.0))
        out += [(rate - 90.0) / 40.0, (rate - mean) / 40.0, zero(confidence[i]), zero(ppr[i]),
                F.coalesce(clip01(coverage[i]), F.lit(0.0)), agree[i], v.isNotNull().cast("double")]
    out += [(mean - 90.0) / 40.0, F.sqrt(F.greatest(p00, F.lit(0.0))) / 40.0, velocity / 10.0,
            F.least(since_confident, F.lit(20)) / 20.0]
    out += [F.coalesce(previous == i, F.lit(False)).cast("double") for i in range(channels)]
    out.append(F.least(hold, F.lit(10)) / 10.0)
    return F.array(*[c.cast("float") for c in out])
