"""Which days the feeds cover: no figure of change may span days on which its feeds did not exist.

All of these read one aggregated row per feed or per day, so their windows
without a partition hold a few thousand rows whatever the archive's size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import upper_median


def coverage_day(feeds: DataFrame, need: float = 0.95) -> DataFrame:
    """The latest day by which feeds with ``need`` of all rows had pulled; feeds are rows of (mx, n)."""
    days = feeds.where("n > 0").groupBy("mx").agg(F.sum("n").alias("n"))
    newest_first = days.select("mx", F.sum("n").over(Window.orderBy(F.desc("mx"))).alias("run"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return newest_first.where(F.col("run") >= need * F.col("total")).agg(F.max("mx").alias("coverage_day"))


def covered_from(feeds: DataFrame, need: float = 0.95) -> DataFrame:
    """The first day on which feeds with ``need`` of all rows had begun; feeds are rows of (mn, n)."""
    days = feeds.where("n > 0").groupBy("mn").agg(F.sum("n").alias("n"))
    oldest_first = days.select("mn", F.sum("n").over(Window.orderBy("mn")).alias("run"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return oldest_first.where(F.col("run") >= need * F.col("total")).agg(F.min("mn").alias("covered_from"))


def longest_window(feeds: DataFrame, as_of: date, most: int = 30, least: int = 3, need: float = 0.5) -> DataFrame:
    """The longest window of days such that feeds with ``need`` of all rows existed before two of them."""
    sized = feeds.select("mn", "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    tried = sized.select("*", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("w"))
    fits = F.col("mn") <= F.date_sub(F.lit(as_of), 2 * F.col("w") - 1)
    shares = tried.groupBy("w").agg((F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.max("total")).alias("share"))
    return shares.where(F.col("share") >= need).agg(F.max("w").alias("window_days"))


def collection_start(days: DataFrame, horizon: int = 60, share: float = 0.1) -> DataFrame:
    """The first of the last ``horizon`` collecting days whose count reaches a share of their upper median."""
    last = days.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("nth") <= horizon)
    middle = last.agg(upper_median("n").alias("middle"))
    return last.join(F.broadcast(middle)).where(F.col("n") >= share * F.col("middle")).agg(F.min("day").alias("collection_start"))
