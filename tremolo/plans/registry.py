"""Where query modules put their queries and the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions.clock import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if it has one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of stations' rows: event_id, station, us (microseconds), kind, value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("station"), micros(F.col("ts")).alias("us"), F.col("event_type").alias("kind"), "value")


#: The same in SQL, to put before a query.
DETECTIONS = "e AS (SELECT event_id, user_id AS station, epoch_us(ts) AS us, event_type AS kind, value FROM events)"


def r6(x: Column) -> Column:
    """Six decimals, for comparison."""
    return F.round(x, 6)


def place(key: Column) -> tuple[Column, Column]:
    """Pseudo coordinates of a key, by integer arithmetic: latitude and longitude in degrees."""
    return (F.lit(36.0) + F.pmod(key * 7919, F.lit(601)) / F.lit(100.0), F.lit(26.0) + F.pmod(key * 104_729, F.lit(1201)) / F.lit(100.0))


LAT, LON = "(36.0::DOUBLE + (({k} * 7919) % 601) / 100.0::DOUBLE)", "(26.0::DOUBLE + (({k} * 104729) % 1201) / 100.0::DOUBLE)"


def km_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
