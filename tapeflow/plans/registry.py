"""Where queries and their check SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeflow.functions.columns import NUDGE
from tapeflow.plans.views import Inputs, with_views
from tapeflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(inputs) -> DataFrame`` as a query, with its check SQL."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return wrap


def rnd(expr: str, digits: int = 6) -> str:
    """SQL rounding that matches ``rounded``."""
    return f"round({expr} + {NUDGE!r}, {digits}) + 0e0"


def r6(*cols: str, digits: int = 6) -> str:
    """SQL select items rounding the given columns under their own names."""
    return ", ".join(f"{rnd(c, digits)} AS {c.split('.')[-1]}" for c in cols)
