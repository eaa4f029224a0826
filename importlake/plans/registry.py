"""Where queries register: a name, a function of the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from importlake.plans.views import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of ``Tables`` under ``name``. ``sql`` may begin with further ``name as (...)`` parts after the views."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            if views:
                head = ctes(*views)
                text = f"{head}{text}" if text.startswith(",") else f"{head} {text}"
            ORACLES[name] = text
        return f

    return add
