"""Registry of the runnable queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..handle import TS
from ..operators.create import multi_time_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000
HOUR = 3_600_000
#: Rows of a table that one task aggregates and joins.
TASK_ROWS = 500_000

# The event series as seen by the check SQL.
E = "e AS (SELECT user_id, epoch_us(ts) // 1000 AS tick, event_id, value, event_type FROM events)"
# Daily sales per supplier.
D = (
    "d AS (SELECT l_suppkey, CAST(epoch_ms(l_shipdate) // 86400000 AS BIGINT) AS tick, round(sum(l_extendedprice), 2) AS value "
    "FROM lineitem GROUP BY ALL)"
)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check on the same tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` dealt by ``cols`` to tasks of at most some ``TASK_ROWS`` of its ``rows``, for all aggregates and joins on ``cols`` that follow."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *cols)


def events(spark, sf, value="value", where: str | None = None) -> TS:
    """Events per user in milliseconds, ``event_id`` breaking ties."""
    df = table(spark, sf, "events")
    if where:
        df = df.where(where)
    return multi_time_series(df, "ts", "user_id", value, ord="event_id")


def daily(spark, sf) -> TS:
    """Sales per supplier and day (tick: days since 1970-01-01)."""
    ts = multi_time_series(
        table(spark, sf, "lineitem"), "l_shipdate", "l_suppkey", "l_extendedprice",
        granularity=timedelta(days=1), start_time=datetime(1970, 1, 1, tzinfo=timezone.utc),
    )
    df = ts.df.groupBy("l_suppkey", "tick").agg(F.round(F.sum("value"), 2).alias("value"))
    return ts.with_df(df)


def r(col, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
