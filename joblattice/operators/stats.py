"""Medians, quantiles, ranks and bands.  Each of the four medians is a definition of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up


def floored_median(x: Column, least: int = 8) -> Column:
    """Median rounded half up, null for fewer than ``least`` values."""
    return F.when(F.count(x) >= least, half_up(F.percentile(x, 0.5)).cast("long"))


def quartiles(x: Column) -> Column:
    """25, 50 and 75 percent, interpolated between neighbours."""
    return F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def lower_median(x: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})")


def upper_median(x: str) -> Column:
    """The upper of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def threshold(x: str, p: float) -> Column:
    """The value at place floor(p * n), counted from 0."""
    return F.expr(f"percentile_disc({1 - p:.10g}) WITHIN GROUP (ORDER BY {x} DESC)")


def median_of_medians(rows: DataFrame, keys: list[str], market: str, x: str, least: int = 8) -> DataFrame:
    """One vote per market that has enough values; n counts all values, markets those with a vote."""
    inner = rows.groupBy(*keys, market).agg(floored_median(F.col(x), least).alias("m"), F.count(x).alias("k"))
    pooled = half_up(F.percentile("m", 0.5)).cast("long")
    return inner.groupBy(*keys).agg(pooled.alias("pay"), F.count("m").alias("markets"), F.sum("k").alias("n"))


def competition_rank(n: Column, *keys: str) -> Column:
    """1 for the largest; equal values share a rank and leave a gap."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(n.desc()))


def percent_below(x: Column, *keys: str) -> Column:
    """Percent of the group strictly below, rounded half up; not percent_rank, which divides by n - 1."""
    by = Window.partitionBy(*keys)
    below = F.rank().over(by.orderBy(x)) - 1
    return half_up(100 * below / F.count(F.lit(1)).over(by)).cast("long")


def banded(x: Column, edges: list[tuple[str, float]]) -> Column:
    """The name of the last band whose lower edge x reaches."""
    found = F.lit(None).cast("string")
    for name, low in edges:
        found = F.when(x >= low, F.lit(name)).otherwise(found)
    return found


def scaled(x: Column, *keys: str) -> Column:
    """Where x lies between its group's least and largest value, 0 to 1; 0.5 where they are equal."""
    by = Window.partitionBy(*keys)
    least, most = F.min(x).over(by), F.max(x).over(by)
    return F.when(most > least, (x - least) / (most - least)).when(most == least, 0.5)


def per_head(millions: Column, heads: Column) -> Column:
    """A figure in millions per employee, to two decimals; null without employees."""
    return F.when(heads > 0, half_up(millions * 1_000_000 / heads, 2))


def share_percent(n: Column, *keys: str) -> Column:
    """Share of the group's sum in whole percent, at least 1."""
    return F.greatest(F.lit(1), half_up(100 * n / F.sum(n).over(Window.partitionBy(*keys))).cast("long"))


def rank_within(rows: DataFrame, keys: list[str], order: list[Column], top: int, name: str = "place") -> DataFrame:
    """The first rows of each group, numbered."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)


def placed(rows: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """``rows`` with ``nth``: their place from 1 in ``order``, nulls last, over all rows.

    ``bucket`` rises with the order and has few values; only these are numbered in one task, the rows within their buckets.
    """
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_bucket").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.asc_nulls_last(c) for c in order]))
    numbered = dealt.withColumn("_within", within).join(starts, F.col("_bucket").eqNullSafe(F.col("_of")))
    return numbered.withColumn("nth", F.col("_before") + F.col("_within")).drop("_bucket", "_of", "_before", "_within")
