"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.fixtures import fixture, sql_with

Loader = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, fixtures: str = "", sql: str | None = None, dates: str = "") -> Callable[[Callable[[Loader], DataFrame]], Callable[[Loader], DataFrame]]:
    """Register a function of a loader of fixtures and tables; ``sql`` may use the fixtures named. ``dates`` (columns,
    space-separated) come out as text, since engines differ in how they hand over days and times."""
    days = dates.split()

    def register(build: Callable[[Loader], DataFrame]) -> Callable[[Loader], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(lambda n: fixture(spark, sf_dir, n)).withColumns({d: F.date_format(d, "yyyy-MM-dd HH:mm:ss") for d in days})
        if sql is not None:
            text = sql_with(fixtures, sql)
            shown = ", ".join(f"strftime(\"{d}\", '%Y-%m-%d %H:%M:%S') AS \"{d}\"" for d in days)
            ORACLES[name] = f"SELECT * REPLACE ({shown}) FROM ({text}) z" if days else text
        return build

    return register
