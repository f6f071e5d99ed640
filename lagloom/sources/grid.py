"""Regular time grids: durations, grid checks, row indexes, and adapters from event tables."""

from __future__ import annotations

import math
import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
INDEX = "_idx"
#: Rows of a range, ranges at most, and rows from which a range of one value is cut by the next column.
RANGE_ROWS, MOST_RANGES, HEAVY_ROWS = 1_000_000, 1024, 100_000


def ident(name: str) -> Column:
    """A column by its exact name, whatever letters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def duration_seconds(value: timedelta | str, name: str = "duration") -> float:
    """Seconds of a timedelta or of a text such as ``"90s"``, ``"5m"``, ``"2h"`` or ``"1d"``."""
    if isinstance(value, timedelta):
        if value <= timedelta(0):
            raise ValueError(f"{name} must be positive")
        return value / timedelta(seconds=1)
    if isinstance(value, str) and (m := re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", value)):
        return int(m[1]) * _UNITS[m[2]]
    raise ValueError(f"{name}: not a duration: {value!r}")


def duration_text(seconds: float) -> str:
    """The shortest exact text of a whole number of seconds."""
    if seconds != int(seconds):
        raise ValueError("not a whole number of seconds")
    return next(f"{int(seconds) // n}{u}" for u, n in reversed(_UNITS.items()) if int(seconds) % n == 0)


def lag_to_steps(value: int | str | timedelta, *, dt: float, name: str = "lag") -> int:
    """A lag in rows: steps as they are, durations if they are exact multiples of dt."""
    if isinstance(value, int):
        if value < 0:
            raise ValueError(f"{name} must not be negative")
        return int(value)
    seconds = duration_seconds(value, name)
    steps = seconds / dt
    if steps != int(steps):
        raise ValueError(f"{name} is not a multiple of dt")
    return int(steps)


def micros(column: str | Column) -> Column:
    """A date or time as microseconds."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def grid_stats(df: DataFrame, time_col: str) -> DataFrame:
    """One row: n_rows, n_null, n_distinct, min_step_s, max_step_s, gap_rows, is_regular.

    Steps come from one window by day, joined by each day's last time, so the
    series never meets in a single task.
    """
    t = df.select(F.col(time_col).alias("t"), micros(time_col).alias("us"))
    day = F.floor(F.col("us") / 86_400_000_000)
    rows = t.where("us IS NOT NULL").select("us", day.alias("day"))
    ends = rows.groupBy("day").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    # one row a day: small enough for one ordered window
    between = ends.select((F.col("first") - F.lag("last").over(W.orderBy("day"))).alias("step"))
    inside = rows.select((F.col("us") - F.lag("us").over(W.partitionBy("day").orderBy("us"))).alias("step"))
    steps = inside.unionByName(between).where("step IS NOT NULL").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count("*").alias("n"), F.sum("step").alias("span"))
    counts = t.agg(F.count("*").alias("n_rows"), F.count_if(F.col("us").isNull()).alias("n_null"), F.count_distinct("us").alias("n_distinct"))
    one = counts.join(steps, F.lit(True))
    return one.select(
        "n_rows",
        "n_null",
        "n_distinct",
        (F.col("lo") / 1e6).alias("min_step_s"),
        (F.col("hi") / 1e6).alias("max_step_s"),
        F.when(F.col("lo") > 0, F.floor(F.col("span") / F.col("lo")) - F.col("n")).alias("gap_rows"),
        (F.coalesce((F.col("n_null") == 0) & (F.col("lo") > 0) & (F.col("lo") == F.col("hi")), F.lit(False))).alias("is_regular"),
    )


def infer_regular_dt(df: DataFrame, *, time_col: str) -> float:
    """Seconds between rows of a regular grid; raises with the reason where it is none.

    One aggregate: on a regular grid all times are distinct and lie at multiples
    of span / (n - 1) from the first.
    """
    kind = df.schema[time_col].dataType
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("the time column must hold dates or times")
    t = micros(time_col)
    r = df.agg(F.count("*").alias("n"), F.count_if(t.isNull()).alias("nulls"), F.count_distinct(t).alias("distinct"), F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if r.n < 2:
        raise ValueError("a grid needs at least two rows")
    if r.nulls:
        raise ValueError("the time column holds nulls")
    if r.distinct < r.n:
        raise ValueError("times must be strictly increasing with no duplicates")
    step, rest = divmod(r.hi - r.lo, r.n - 1)
    if rest or df.where((t - F.lit(r.lo)) % step != 0).limit(1).count():
        raise ValueError("the time grid is irregular")
    return step / 1e6


def resolve_dt(df: DataFrame, *, time_col: str, dt: float | str | timedelta | None) -> float:
    """The grid's step; a given dt must equal it."""
    found = infer_regular_dt(df, time_col=time_col)
    if dt is not None and (dt if isinstance(dt, (int, float)) else duration_seconds(dt, "dt")) != found:
        raise ValueError("dt differs from the grid's step")
    return found


def check_order(df: DataFrame, *, time_col: str, input_order_col: str) -> DataFrame:
    """The frame, if time never falls along input_order_col; raises otherwise.

    Ranges of the order are looked at by themselves, then where they meet.
    """
    parted, _ = _ranges(df.select(ident(time_col).alias("_t"), ident(input_order_col).alias("_o")), ["_o"], None)
    before = F.lag("_t").over(W.partitionBy("_part").orderBy("_o"))
    inside = parted.select("_part", "_t", before.alias("_before"))
    ends = inside.groupBy("_part").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.max(F.col("_before") > F.col("_t")).alias("falls"))
    # one row a range
    if ends.select("falls", (F.max("last").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)) > F.col("first")).alias("apart")).where("falls OR apart").limit(1).count():
        raise ValueError("the time column is not sorted")
    return df


def regular_grid(df: DataFrame, time_col: str, every: str, aggs: dict[str, Column], as_col: str = "t") -> DataFrame:
    """Event rows gathered by hour or day on a spine without gaps: t, _idx and the aggregates; empty buckets are null."""
    t = F.date_trunc(every, F.col(time_col))
    rows = df.groupBy(t.alias(as_col)).agg(*[a.alias(k) for k, a in aggs.items()])
    step = {"hour": 3600, "day": 86400, "minute": 60}[every]
    span = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step} SECONDS"))).alias(as_col), F.unix_seconds("lo").alias("from"))
    spine = spine.select(as_col, ((F.unix_seconds(as_col) - F.col("from")) / step).cast("long").alias(INDEX))
    return spine.join(rows, as_col, "left").withColumn(as_col, F.col(as_col).cast("timestamp_ntz"))


def mode_of(column: str) -> Column:
    """The most frequent value, ties to the smallest."""
    return F.mode(column, True)


def grid_index(df: DataFrame, *, time_col: str, dt: float) -> DataFrame:
    """The frame with _idx from the grid formula: no sort, no window."""
    lo = df.agg(F.min(micros(time_col))).first()[0]
    return df.withColumn(INDEX, ((micros(time_col) - F.lit(lo)) / F.lit(round(dt * 1e6))).cast("long"))


def _number(df: DataFrame, column: str) -> Column:
    """The column as a double in the same order; null where it has no such form."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return micros(ident(column)).cast("double")
    return ident(column).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def _cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    """Approximate quantiles; a value that is several of them gets a range of its own."""
    found = sorted(df.stat.approxQuantile(column, [k / parts for k in range(1, parts)], 0.2 / parts)) if parts > 1 else []
    return sorted({*found, *(math.nextafter(a, math.inf) for a, b in zip(found, found[1:]) if a == b)})


def _place(cuts: list[float], column: str) -> Column:
    """How many cuts are not above the column; -1 for null, which comes first."""
    if not cuts:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column))), F.lit(-1))


def _ranges(df: DataFrame, order_by: list[str], parts: int | None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The frame with _part, ranges of the order columns that ascend with it, and (part, rows) of each.

    Ranges are cut at quantiles of the first column; a range that one value fills
    far beyond its share is cut at quantiles of the second.
    """
    keyed = df.withColumn("_key", _number(df, order_by[0])).withColumn("_next", _number(df, order_by[1]) if len(order_by) > 1 else F.lit(None).cast("double"))
    n = keyed.count()
    parts = parts or min(MOST_RANGES, max(64, n // RANGE_ROWS))
    parted = keyed.withColumn("_part", _place(_cuts(keyed, "_key", parts), "_key") * (MOST_RANGES + 2))
    stats = parted.groupBy("_part").agg(F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()  # one row a range
    heavy = [r for r in stats if r.n > max(4 * n / parts, HEAVY_ROWS) and (r.lo == r.hi)]
    if heavy and len(order_by) > 1:
        inner = F.lit(0)
        for r in heavy:
            mine = F.col("_part") == r["_part"]
            cuts = _cuts(parted.where(mine), "_next", min(MOST_RANGES, int(r.n * parts / n)))
            inner = F.when(mine, _place(cuts, "_next") + 1).otherwise(inner)
        parted = parted.withColumn("_part", F.col("_part") + inner)
        stats = parted.groupBy("_part").agg(F.count("*").alias("n")).collect()
    return parted.drop("_key", "_next"), sorted((r["_part"], r["n"]) for r in stats)


def row_index(df: DataFrame, order_by: list[str], parts: int | None = None) -> DataFrame:
    """The frame with _idx, the row's place in the order, for irregular grids.

    Rows are cut into ranges, whose number follows the rows; each range is numbered
    by itself and starts where the ranges before it end.  Rows without an order
    value come first.
    """
    parted, sizes = _ranges(df, order_by, parts)
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before long")
    number = F.row_number().over(W.partitionBy("_part").orderBy(*[ident(c) for c in order_by])) - 1
    return parted.join(F.broadcast(offsets), "_part").withColumn(INDEX, (number + F.col("_before")).cast("long")).drop("_part", "_before")
