"""Intervals, calendars and series: live days, as-of joins, carrying forward, change and rebasing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up


def live_days(rows: DataFrame, start: date | Column, end: date | Column) -> DataFrame:
    """A row per advertisement and day it was live on between two days: clipped first, never joined to a calendar."""
    lo, hi = (F.lit(d) if isinstance(d, date) else d for d in (start, end))
    cut = rows.where((F.col("first_seen") <= hi) & (F.col("last_seen") >= lo))
    return cut.withColumn("day", F.explode(F.sequence(F.greatest("first_seen", lo), F.least("last_seen", hi))))


def overlap_days(start: date, end: date) -> Column:
    """Days on which the advertisement was live between two days."""
    lo, hi = F.greatest("first_seen", F.lit(start)), F.least("last_seen", F.lit(end))
    return F.greatest(F.lit(0), F.datediff(hi, lo) + 1)


def calendar(spark, start: date, end: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row at or before its time; null before the first.

    One union, one shuffle by key, and the last value carried along: no join on a range.
    """
    cols = [c for c in left.columns if c not in (*keys, left_time)]
    marked = left.select(*keys, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), *cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_time].dataType).alias("_vt"))
    given = right.where(F.col(value).isNotNull()).select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(value).alias("_v"), F.col(right_time).alias("_vt"))
    past = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.unionByName(given).select("*", F.last("_v", True).over(past).alias("_carried"), F.last("_vt", True).over(past).alias("_carried_at"))
    return carried.where("_side = 1").select(*keys, F.col("_at").alias(left_time), *cols, F.col("_carried").alias(value), F.col("_carried_at").alias(f"{value}_at"))


def carry_forward(value: Column, keys: list[str], order: str) -> Column:
    """The last value that isn't null; null before the first."""
    return F.last(value, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def hold_rounds(rounds: DataFrame, months: DataFrame, panel: str = "panel") -> DataFrame:
    """Survey rounds (panel, start, value) held from their start until the panel's next round begins."""
    following = F.lead("start").over(Window.partitionBy(panel).orderBy("start"))
    last = months.agg(F.max("month").alias("last"))
    held = rounds.withColumn("next", following).join(F.broadcast(last)).withColumn("until", F.coalesce(F.add_months("next", -1), F.col("last")))  # one row
    return held.where(F.col("start") <= F.col("until")).select(panel, "value", F.explode(F.expr("sequence(start, until, interval 1 month)")).alias("month"))


def half_window_change(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean of the first against mean of the last half of a series, in percent to one decimal.

    The middle of an odd number of points is left out.  Null for fewer than five
    points, and where the first half's mean isn't positive.
    """
    by = Window.partitionBy(*keys)
    placed = points.select(*keys, F.col(value).alias("v"), F.row_number().over(by.orderBy(order)).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    half = F.floor(F.col("n") / 2)
    first, last = F.avg(F.when(F.col("i") <= half, F.col("v"))), F.avg(F.when(F.col("i") > F.col("n") - half, F.col("v")))
    means = placed.groupBy(*keys).agg(F.max("n").alias("n_points"), first.alias("a"), last.alias("b"))
    pct = F.when((F.col("n_points") >= 5) & (F.col("a") > 0), half_up((F.col("b") - F.col("a")) / F.col("a") * 100, 1))
    return means.select(*keys, "n_points", pct.alias("pct"))


def trim_leading(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The series from its first positive point on."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("begun", F.max(F.col(value) > 0).over(past)).where("begun").drop("begun")


def rebased(value: Column, keys: list[str], order: str) -> Column:
    """100 at the first positive point, to one decimal; null before it."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.first(F.when(value > 0, value), True).over(past)
    return half_up(100 * value / base, 1)


def lag_change(value: Column, keys: list[str], order: str, steps: int, start: Column | None = None) -> Column:
    """Change in percent against some steps before, to one decimal; null where the base isn't positive, or
    lies before ``start`` (the number of the series' first point)."""
    by = Window.partitionBy(*keys).orderBy(order)
    base = F.lag(value, steps).over(by)
    fits = base > 0
    if start is not None:
        fits = fits & (F.row_number().over(by) - steps >= start)
    return F.when(fits, half_up((value - base) / base * 100, 1))


def month_axis(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key (keys, month, value) on all months from the first to the last of the table; null where nothing was counted.

    Points are unique by key and month.  They are read once, into a map of months per key;
    the ends of the axis come from the same maps, so both sides share one exchange.
    """
    per_key = points.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month", value))).alias("known"))
    ends = per_key.agg(F.min(F.array_min(F.map_keys("known"))).alias("a"), F.max(F.array_max(F.map_keys("known"))).alias("b"))
    axis = per_key.join(F.broadcast(ends)).select(*keys, "known", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))  # one row
    return axis.select(*keys, "month", F.try_element_at("known", "month").alias(value))


def on_month_axis(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The points on the whole axis, nought where nothing was counted."""
    return month_axis(points, keys, value).withColumn(value, F.coalesce(value, F.lit(0)))


def trailing_change(value: Column, keys: list[str], order: str, steps: int = 12) -> Column:
    """Change in percent against ``steps`` before, or against the first point where there are fewer; 0 where the base isn't positive."""
    by = Window.partitionBy(*keys).orderBy(order)
    first = F.first(value).over(by.rowsBetween(Window.unboundedPreceding, 0))
    base = F.coalesce(F.lag(value, steps).over(by), first)
    return F.when(base > 0, half_up((value - base) / base * 100, 1)).otherwise(0.0)


def with_share(rows: DataFrame, group: list[str], weight: Column, floor: float = 1.0) -> DataFrame:
    """Each row's share of its group's weights, a weight counting at least ``floor``."""
    w = F.greatest(weight, F.lit(floor))
    return rows.withColumn("share", w / F.sum(w).over(Window.partitionBy(*group)))


def own_maximum(value: Column, *keys: str) -> Column:
    """The value over the largest of its group."""
    return value / F.max(value).over(Window.partitionBy(*keys))


def priced_days(prices: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Days with the last price at or before them, the first price before that; groups with fewer than two
    days that hold a price of their own are left out."""
    joined = days.join(prices, [*keys, "day"], "left")
    by = Window.partitionBy(*keys)
    exact = F.count("price").over(by)
    back = F.last("price", True).over(by.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("price", True).over(by.orderBy("day").rowsBetween(0, Window.unboundedFollowing))
    return joined.withColumn("exact", exact).withColumn("filled", F.coalesce(back, ahead)).where("exact >= 2").drop("exact")
