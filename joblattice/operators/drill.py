"""Drill-downs: an employer's skill movers, its peers, how long advertisements stay up, and what a scope pays."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up

# Days of a comparison, weeks of a line, movers shown; closed advertisements read, and the least of
# them overall and for a skill; least salaries in the dominant currency.
MOVER_DAYS, LINE_WEEKS, MOVERS_SHOWN = 30, 13, 8
NEWEST_ADS, LEAST_ADS, LEAST_SKILL_ADS = 8_000, 40, 8
LEAST_SALARIES = 20


def employer_movers(rows: DataFrame, as_of: date) -> DataFrame:
    """(company_id, place, skill, now_n, prev_n, delta, pct, dir, series): each employer's skills that moved most.

    Advertisements seen in the last 30 days against those live in the 30 before (the
    windows share their boundary day); the series counts those live in each of the last 13 weeks.
    """
    back = lambda n: F.date_sub(F.lit(as_of), n)
    now = F.count_if(F.col("last_seen") >= back(MOVER_DAYS))
    prev = F.count_if((F.col("first_seen") <= back(MOVER_DAYS)) & (F.col("last_seen") >= back(2 * MOVER_DAYS)))
    weeks = [F.count_if((F.col("first_seen") <= back(7 * i)) & (F.col("last_seen") >= back(7 * i + 6))) for i in range(LINE_WEEKS - 1, -1, -1)]
    each = rows.where(F.col("company_id").isNotNull()).withColumn("skill", F.explode(F.array_distinct("skills")))
    counted = each.groupBy("company_id", "skill").agg(now.alias("now_n"), prev.alias("prev_n"), F.array(*weeks).alias("series"))
    moved = counted.withColumn("delta", F.col("now_n") - F.col("prev_n")).where("delta <> 0")
    pct = F.when(F.col("prev_n") > 0, half_up(100 * F.col("delta") / F.nullif(F.col("prev_n"), F.lit(0)))).otherwise(100).cast("long")
    order = Window.partitionBy("company_id").orderBy(F.desc(F.abs("delta")), F.desc("delta"), "skill")
    way = F.when(F.col("delta") > 0, "up").otherwise("down")
    return moved.select("*", pct.alias("pct"), way.alias("dir"), F.row_number().over(order).alias("place")).where(F.col("place") <= MOVERS_SHOWN)


def _nearest(companies: DataFrame, keys: list[str], k: int, only: DataFrame | None = None) -> DataFrame:
    """(id, peer, apart): of each company (whose id is in ``only``) the ``k`` next in size within its keys: among the ``k`` before and after it, no others can be nearer."""
    by = Window.partitionBy(*keys).orderBy("headcount", "id")
    around = F.concat(F.collect_list(F.struct("id", "headcount")).over(by.rowsBetween(-k, -1)), F.collect_list(F.struct("id", "headcount")).over(by.rowsBetween(1, k)))
    asked = companies.withColumn("around", around)
    asked = asked if only is None else asked.join(only, "id", "left_semi")
    pairs = asked.select("id", "headcount", F.explode("around").alias("p"))
    return pairs.select("id", F.col("p.id").alias("peer"), F.abs(F.col("p.headcount") - F.col("headcount")).alias("apart"))


def peers(companies: DataFrame, k: int = 4) -> DataFrame:
    """(id, place, peer, tier): the ``k`` companies nearest in headcount of the same country and sector, or, for a
    company alone in its sector, of the same country and group.

    ``companies`` has id, country, sector, grp and headcount.  Of more than ``k`` of one headcount, those next to it by id are taken.
    """
    own = _nearest(companies, ["country", "sector"], k).withColumn("tier", F.lit("sector"))
    alone = companies.groupBy("country", "sector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("id")
    wider = _nearest(companies, ["country", "grp"], k, alone).withColumn("tier", F.lit("group"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("apart", "peer"))
    return own.unionByName(wider).withColumn("place", nth).where(F.col("place") <= k).select("id", "place", "peer", "tier")


def ad_durations(rows: DataFrame, as_of: date) -> DataFrame:
    """(skill, days, n, place): the median days that advertisements stayed up, slowest skill first; the row without a skill is all of them.

    ``rows`` has job_key, skills, last_seen and days_since_posted.  Read are the newest 8,000 that have
    come down and carried a posting day; with fewer than 40 nothing is told, and of a skill with fewer than 8 neither.
    """
    closed = rows.where((F.col("last_seen") < F.lit(as_of)) & (F.col("days_since_posted") >= 0)).orderBy(F.desc("last_seen"), "job_key").limit(NEWEST_ADS)
    middle = half_up(F.percentile("days_since_posted", 0.5)).cast("long").alias("days")
    # At most 8,000 advertisements are left, so the medians' groups are as bounded.
    whole = closed.agg(middle, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ADS)
    each = closed.withColumn("skill", F.explode(F.array_distinct("skills"))).groupBy("skill").agg(middle, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SKILL_ADS)
    told = each.join(F.broadcast(whole.select(F.lit(True).alias("enough")))).drop("enough")  # one row, or none
    placed = told.withColumn("place", F.row_number().over(Window.orderBy(F.desc("days"), "skill")))
    return placed.unionByName(whole.select(F.lit(None).cast("string").alias("skill"), "days", "n", F.lit(0).alias("place")))


def scope_pay(rows: DataFrame) -> DataFrame:
    """(scope, currency, n, live, share, p25, p50, p75): what a scope's live advertisements pay, in its dominant currency.

    ``rows`` has scope and pay (annual and currency, or null).  The currency with most
    figures counts, the alphabetically first of equals; with fewer than 20 figures the scope has no row.
    Figures are first counted by value, so a scope's quantiles are read off its distinct figures.
    """
    live = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("live"))
    known = rows.where("pay.currency IS NOT NULL AND pay.annual IS NOT NULL")
    counts = known.groupBy("scope", F.col("pay.currency").alias("currency"), F.col("pay.annual").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("scope", "currency").agg(F.sum("c").alias("n"))
    first = sizes.withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n"), "currency"))).where((F.col("nth") == 1) & (F.col("n") >= LEAST_SALARIES)).drop("nth")
    ranked = counts.join(first, ["scope", "currency"]).withColumn("upto", F.sum("c").over(Window.partitionBy("scope").orderBy("v")))

    def quantile(p: float):
        place = (F.col("n") - 1) * p  # from 0; between two neighbours
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    quartiles = ranked.groupBy("scope", "currency", "n").agg(*[quantile(p).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)])
    share = half_up(100 * F.col("n") / F.col("live")).cast("long")
    return quartiles.join(live, "scope").select("scope", "currency", "n", "live", share.alias("share"), "p25", "p50", "p75")
