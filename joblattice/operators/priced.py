"""The priced market: what skills are asked for, what they pay, and how both move over a window that the feeds allow.

Advertisements have skills (a list, each once), source, country, salary (a year's, in
one currency, or null), first_seen and last_seen.  The window's length and its first
covered day come out of the feeds as tables of one row and clip the advertisements' counts inside
the same plan, so nothing is collected and no count is spread over days that are
cut off again.  Ranks over all skills run in one task: skills are as many as the taxonomy has.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up
from .coverage import covered_from
from .stats import floored_median, median_of_medians, upper_median

# Least points of a line, least advertisements on a skill's best day, the feeds' least share of all
# rows, the ticker's windows, how much it shows and when it is filled up, and the band its changes are kept in.
LEAST_POINTS, LEAST_VOLUME, LEAST_SHARE = 5, 3, 0.5
WINDOWS = {"24h": 1, "7d": 7, "30d": 30}
MOST_MOVERS, FEW_MOVERS, FILLED_MOVERS, MOST_FILL = 16, 6, 12, 18
BAND = (-16.0, 24.0)


def market_window(feeds: DataFrame, as_of: date, want: int = 30) -> DataFrame:
    """One row (span): the longest window up to ``want`` days on whose first day feeds with half of all rows existed.

    ``feeds`` is one row per feed: mn (first day) and n.  Null where even five days have too little.
    """
    sized = feeds.select("mn", "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    tried = sized.select("*", F.explode(F.sequence(F.lit(LEAST_POINTS), F.lit(want))).alias("w"))
    begun = F.sum(F.when(F.col("mn") <= F.date_sub(F.lit(as_of), F.col("w") - 1), F.col("n")).otherwise(0))
    return tried.groupBy("w").agg((begun / F.max("total")).alias("share")).where(F.col("share") >= LEAST_SHARE).agg(F.max("w").alias("span"))


def _half_change(line: Column) -> Column:
    """Mean of the last half of a line against that of the first, in percent; null for short lines and empty first halves."""
    half = F.floor(F.size(line) / 2).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / half
    before, after = mean(F.slice(line, F.lit(1), half)), mean(F.slice(line, F.size(line) - half + 1, half))
    return F.when((F.size(line) >= LEAST_POINTS) & (before > 0), half_up((after - before) / F.nullif(before, F.lit(0.0)) * 100, 1))


def _begin(rows: DataFrame, as_of: date, want: int) -> DataFrame:
    """One row (begin): the window's first day, no earlier than feeds with 95 % of its rows had begun; no row without a window.

    The archive is counted once, by feed and last day inside the widest window; both steps read these counts.
    """
    inside = (F.col("last_seen") >= F.date_sub(F.lit(as_of), want - 1)) & (F.col("first_seen") <= F.lit(as_of))
    counts = rows.groupBy("source", F.when(inside, F.least("last_seen", F.lit(as_of))).alias("seen")).agg(F.min("first_seen").alias("mn"), F.count(F.lit(1)).alias("n"))
    feeds = counts.groupBy("source").agg(F.min("mn").alias("mn"), F.sum("n").alias("n"), F.collect_list(F.struct("seen", "mn", "n")).alias("counts"))  # a window's days at most
    span = market_window(feeds, as_of, want).where("span IS NOT NULL").select(F.date_sub(F.lit(as_of), F.col("span") - 1).alias("start"))
    held = feeds.select("source", F.inline("counts")).join(F.broadcast(span)).where(F.col("seen") >= F.col("start"))  # one row
    whole = covered_from(held.groupBy("source").agg(F.min("mn").alias("mn"), F.sum("n").alias("n")))
    return span.join(F.broadcast(whole)).select(F.least(F.lit(as_of), F.greatest("start", "covered_from")).alias("begin"))  # one row


def daily_lines(rows: DataFrame, as_of: date, want: int = 30) -> DataFrame:
    """(skill, begin, line): each skill's advertisements on every day from the window's first covered day on.

    Advertisements of a skill with the same days inside the widest window are counted before they are spread.
    """
    low = F.date_sub(F.lit(as_of), want - 1)
    recent = rows.where((F.col("last_seen") >= low) & (F.col("first_seen") <= F.lit(as_of)))
    runs = recent.select(F.explode("skills").alias("skill"), F.greatest("first_seen", low).alias("from"), F.least("last_seen", F.lit(as_of)).alias("to")).groupBy("skill", "from", "to").agg(F.count(F.lit(1)).alias("k"))
    covered = runs.join(F.broadcast(_begin(rows, as_of, want))).where(F.col("to") >= F.col("begin"))  # one row
    spread = covered.select("skill", "begin", "k", F.explode(F.sequence(F.greatest("from", "begin"), "to")).alias("day"))
    per_day = spread.groupBy("skill", "begin", "day").agg(F.sum("k").alias("n"))
    known = per_day.groupBy("skill", "begin").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("known"))  # a window's days at most
    return known.select("skill", "begin", F.transform(F.sequence("begin", F.lit(as_of)), lambda d: F.coalesce(F.try_element_at("known", d), F.lit(0).cast("long"))).alias("line"))


def priced_skills(rows: DataFrame, as_of: date, categories: DataFrame, want: int = 30) -> DataFrame:
    """Skills live on the day: category, how many advertisements, line, change, price, markets, value and place.

    The price is the median of the markets' medians; the value is price times advertisements, null
    for a skill without a price.  Places go by value (nulls last), advertisements and name.
    A skill's change needs a day with three advertisements; a flat or short line isn't told.
    """
    canonical = categories.select("skill", "category").distinct()
    kept = F.filter(F.array_distinct("skills"), lambda s: F.array_contains("_known", s))
    known = canonical.agg(F.collect_set("skill").alias("_known"))  # the taxonomy's skills
    own = rows.join(F.broadcast(known)).where(F.arrays_overlap("skills", "_known")).withColumn("skills", kept).drop("_known")
    now = own.where((F.col("first_seen") <= F.lit(as_of)) & (F.col("last_seen") >= F.lit(as_of))).withColumn("skill", F.explode("skills"))
    vote = F.when(F.col("country").isNotNull(), floored_median(F.col("salary")))
    markets = now.groupBy("skill", "country").agg(F.count(F.lit(1)).alias("n"), vote.alias("m"))
    level = markets.groupBy("skill").agg(F.sum("n").alias("now_n"), half_up(F.percentile("m", 0.5)).cast("long").alias("pay"), F.count("m").alias("pay_markets"))
    lines = daily_lines(own, as_of, want)
    loud = F.array_max("line") >= LEAST_VOLUME
    moves = (F.size("line") >= LEAST_POINTS) & (F.array_min("line") != F.array_max("line"))
    pct = F.when(loud, _half_change(F.col("line")))
    all_of = level.join(lines, "skill").join(canonical, "skill")
    valued = all_of.select("skill", "category", "now_n", "begin", "line", F.when(moves, F.col("line")).alias("spark"), pct.alias("pct"), "pay", "pay_markets", (F.col("pay") * F.col("now_n")).alias("value"))
    way = F.when(F.coalesce("pct", F.lit(0.0)) == 0, "flat").when(F.col("pct") > 0, "up").otherwise("down")
    order = Window.orderBy(F.desc_nulls_last("value"), F.desc("now_n"), "skill")
    return valued.withColumn("dir", way).withColumn("place", F.row_number().over(order))


def value_series(skills: DataFrame, *keys: str) -> DataFrame:
    """(keys, day, value): price times advertisements of the priced skills, day by day."""
    days = skills.where("pay IS NOT NULL").select(*keys, "begin", "pay", F.posexplode("line").alias("i", "n"))
    return days.groupBy(*keys, F.date_add("begin", F.col("i")).alias("day")).agg(F.sum(F.col("n") * F.col("pay")).alias("value"))


def category_market(skills: DataFrame) -> DataFrame:
    """Categories: skills, priced ones, advertisements, value (null if none is priced), and the change of their value."""
    # A skill's own figures stand with its first day, so the skills are read once for both.
    days = skills.select("category", "begin", "pay", "now_n", "value", F.posexplode_outer("line").alias("i", "n"))
    of_skill = lambda c: F.when(F.coalesce("i", F.lit(0)) == 0, c)
    figures = [F.count(of_skill(F.lit(1))).alias("skills"), F.count(of_skill(F.col("pay"))).alias("priced"), F.sum(of_skill(F.col("now_n"))).alias("now_n"), F.sum(of_skill(F.col("value"))).alias("value")]
    by_day = days.groupBy("category", F.date_add("begin", F.col("i")).alias("day")).agg(F.sum(F.col("n") * F.col("pay")).alias("worth"), *figures)
    worths = F.collect_list(F.when(F.col("worth").isNotNull(), F.struct("day", "worth")))  # a window's days at most
    sums = by_day.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("skills", "priced", "now_n", "value")], F.transform(F.sort_array(worths), lambda p: p["worth"]).alias("line"))
    line = F.when(F.size("line") > 0, F.col("line"))
    return sums.withColumn("line", line).select("category", "skills", "priced", "now_n", "value", _half_change(F.col("line")).alias("pct"))


def ticker(rows: DataFrame, as_of: date, canonical: DataFrame) -> DataFrame:
    """(window, place, skill, v, sig, filled, pay, spark): the movers of each window, largest first.

    A listing counts as now if it was seen in the window, and as before if it was live in
    the one before; the windows share their boundary day.  A window whose earlier half begins
    before collecting did stays empty; collecting began on the first day with a tenth of
    the (upper) median day's new listings.  A window with fewer than six movers is filled up
    to twelve with the skills most in demand.  Lines are those of the last 30 days that
    anything was collected on, told if they have five points and move.
    """
    back = lambda n: F.date_sub(F.lit(as_of), n)
    widest = max(WINDOWS.values())
    scanned = rows.where((F.size("skills") > 0) & (F.col("last_seen") >= back(2 * widest)))
    new = scanned.groupBy("first_seen").agg(F.count(F.lit(1)).alias("n"))
    start = new.join(F.broadcast(new.agg(upper_median("n").alias("middle"), F.min("first_seen").alias("oldest")))).where("n >= 0.1 * middle").agg(F.min("first_seen").alias("began"), F.min("oldest").alias("oldest"))  # one row
    each = scanned.withColumn("skill", F.explode(F.array_distinct("skills"))).join(canonical.select("skill").distinct(), "skill", "left_semi")
    counts = []
    for days in WINDOWS.values():
        counts += [F.count_if(F.col("last_seen") >= back(days)).alias(f"now{days}"), F.count_if((F.col("first_seen") <= back(days)) & (F.col("last_seen") >= back(2 * days))).alias(f"prev{days}")]
    stacked = ", ".join(f"'{name}', {d}, now{d}, prev{d}" for name, d in WINDOWS.items())
    wide = each.groupBy("skill").agg(*counts).select("skill", F.expr(f"stack({len(WINDOWS)}, {stacked}) AS (window, days, now_n, prev_n)"))
    told = wide.join(F.broadcast(start)).where(F.date_sub(F.lit(as_of), 2 * F.col("days")) >= F.col("began"))  # one row
    delta = F.col("now_n") - F.col("prev_n")
    change = F.when(F.col("prev_n") > 0, delta / F.nullif(F.col("prev_n"), F.lit(0)) * 100).otherwise(100.0)
    v = half_up(F.least(F.greatest(change, F.lit(BAND[0])), F.lit(BAND[1])), 1)
    movers = told.where((F.col("now_n") + F.col("prev_n") >= 3) & (delta != 0)).select("window", "skill", v.alias("v"), F.abs(delta).alias("sig"))
    by_size = Window.partitionBy("window").orderBy(F.desc("sig"), F.desc(F.abs("v")), "skill")
    picked = movers.withColumn("place", F.row_number().over(by_size)).where(F.col("place") <= MOST_MOVERS).withColumn("filled", F.lit(False))
    demand = told.where("now_n > 0").withColumn("nth", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("now_n"), "skill"))).where(F.col("nth") <= MOST_MOVERS)
    n = picked.groupBy("window").agg(F.count(F.lit(1)).alias("picked"))
    rest = demand.join(picked.select("window", "skill"), ["window", "skill"], "left_anti").join(n, "window", "left").withColumn("picked", F.coalesce("picked", F.lit(0))).where(F.col("picked") < FEW_MOVERS)
    place = F.row_number().over(Window.partitionBy("window").orderBy("nth")) + F.col("picked")
    filled = rest.withColumn("place", place).where(F.col("place") <= FILLED_MOVERS)
    mild = F.least(F.lit(MOST_FILL), 2 + half_up(F.col("now_n") / 3)).cast("double")
    both = picked.select("window", "place", "skill", "v", "sig", "filled").unionByName(filled.select("window", F.col("place").cast("int").alias("place"), "skill", mild.alias("v"), F.col("now_n").alias("sig"), F.lit(True).alias("filled")))
    pay = median_of_medians(each.where((F.col("last_seen") >= back(1)) & F.col("country").isNotNull()), ["skill"], "country", "salary").select("skill", "pay")
    return both.join(pay, "skill", "left").join(_sparks(each, as_of, start), "skill", "left").select("window", "place", "skill", "v", "sig", "filled", "pay", "spark")


def _sparks(each: DataFrame, as_of: date, start: DataFrame) -> DataFrame:
    """(skill, spark): live listings on each of the last 30 days from the oldest row on."""
    first = F.date_sub(F.lit(as_of), max(WINDOWS.values()) - 1)
    begun = each.join(F.broadcast(start.select(F.greatest("oldest", first).alias("begin")))).where((F.col("last_seen") >= F.col("begin")) & (F.col("first_seen") <= F.lit(as_of)))  # one row
    days = begun.select("skill", "begin", F.explode(F.sequence(F.greatest("first_seen", "begin"), F.least("last_seen", F.lit(as_of)))).alias("day")).groupBy("skill", "begin", "day").agg(F.count(F.lit(1)).alias("n"))
    known = days.groupBy("skill", "begin").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("known"))  # 30 days at most
    lines = known.select("skill", F.transform(F.sequence("begin", F.lit(as_of)), lambda d: F.coalesce(F.try_element_at("known", d), F.lit(0).cast("long"))).alias("spark"))
    return lines.where((F.size("spark") >= LEAST_POINTS) & (F.array_min("spark") != F.array_max("spark")))
