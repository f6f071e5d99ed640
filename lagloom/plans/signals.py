"""Regular signals derived from the driver's tables, each as a frame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.sources.grid import mode_of, regular_grid


def _cents(column: str):
    """Sum of a column in whole hundredths, so that the order of rows does not matter."""
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double") / F.lit(100.0)


def events_hour(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select("ts", "value", "event_type")
    return regular_grid(df, "ts", "hour", {"x": _cents("value"), "n": F.count("*").cast("double"), "cat": mode_of("event_type")})


def lineitem_day(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    return regular_grid(df, "l_shipdate", "day", {"x": _cents("l_extendedprice"), "m": F.sum(F.col("l_quantity").cast("long")).cast("double") / F.lit(1000.0), "cat": mode_of("l_returnflag")})


def orders_day(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_totalprice")
    return regular_grid(df, "o_orderdate", "day", {"x": _cents("o_totalprice"), "n": F.count("*").cast("double")})


def _sql(table: str, time: str, unit: str, aggs: dict[str, str], mode: str | None = None) -> str:
    """CTEs ending in sig(t, i, ...)."""
    cols = "".join(f", {e} AS {k}" for k, e in aggs.items())
    out = f"b AS (SELECT date_trunc('{unit}', {time})::TIMESTAMP AS t{cols} FROM {table} GROUP BY 1), sp AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 1 {unit})) AS t FROM (SELECT min(t) AS lo, max(t) AS hi FROM b))"
    names, more = "".join(f", b.{k}" for k in aggs), ""
    if mode:
        out += f", md AS (SELECT t, cat FROM (SELECT date_trunc('{unit}', {time})::TIMESTAMP AS t, {mode} AS cat, row_number() OVER (PARTITION BY date_trunc('{unit}', {time}) ORDER BY count(*) DESC, {mode}) AS rn FROM {table} GROUP BY 1, 2, date_trunc('{unit}', {time})) WHERE rn = 1)"
        names, more = names + ", md.cat", " LEFT JOIN md ON md.t = sp.t"
    return out + f", sig AS (SELECT sp.t AS t, date_diff('{unit}', sp.lo, sp.t)::BIGINT AS i{names} FROM sp LEFT JOIN b ON b.t = sp.t{more})"


def _cents_sql(column: str) -> str:
    return f"sum(CAST(round({column} * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE"


EVENTS_HOUR = _sql("events", "ts", "hour", {"x": _cents_sql("value"), "n": "count(*)::DOUBLE"}, "event_type")
LINEITEM_DAY = _sql("lineitem", "l_shipdate", "day", {"x": _cents_sql("l_extendedprice"), "m": "sum(CAST(l_quantity AS BIGINT))::DOUBLE / 1000.0::DOUBLE"}, "l_returnflag")
ORDERS_DAY = _sql("orders", "o_orderdate", "day", {"x": _cents_sql("o_totalprice"), "n": "count(*)::DOUBLE"})

SIGNALS = {"events_hour": (events_hour, EVENTS_HOUR), "lineitem_day": (lineitem_day, LINEITEM_DAY), "orders_day": (orders_day, ORDERS_DAY)}
