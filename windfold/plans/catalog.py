"""All registered queries."""

from windfold.plans import anchors, branching, checks, replays, resampling, scores, screens, signals, sqlviews, streams, strict  # noqa: F401
from windfold.session import ship
from windfold.plans.registry import ORACLES, QUERIES, full_sql


def _shipping(fn):
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    return run


def queries():
    return {name: _shipping(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return {name: full_sql(text) for name, text in ORACLES.items()}
