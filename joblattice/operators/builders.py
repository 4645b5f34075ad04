"""Monthly demand by skill out of statistical releases: counts, stocks, indices and surveys on one month axis.

Every builder keeps the rule of the release it reads: what is held, what is
shared out, what is left out.  Months are dates of a month's first day; ``months``
tables have a column month and one row per month, so they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.money import half_up, openings


def _whole(x: Column) -> Column:
    return half_up(x).cast("long")


def mapped_skills(title: Column, code: Column, taxonomy: list[dict], overrides: dict[str, list[str]]) -> Column:
    """An occupation's skills: those its code is given by hand, else those its title holds."""
    by_title = tx.contained_skills(title, taxonomy)
    if not overrides:
        return by_title
    given = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.try_element_at(given, code), by_title)


def counted_by_skill(rows: DataFrame, taxonomy: list[dict], overrides: dict[str, list[str]] | None = None, national: str = "AUST") -> DataFrame:
    """(skill, state, month, v) from occupation rows (code, title, state, month, value).

    An occupation of several skills counts in full for each.  The national figure is
    the release's own row, never the sum of the states.
    """
    each = rows.withColumn("skill", F.explode(mapped_skills(F.col("title"), F.col("code"), taxonomy, overrides or {})))
    named = F.when(F.col("state") == national, "national").otherwise(F.col("state"))
    return each.groupBy("skill", named.alias("state"), "month").agg(_whole(F.sum("value")).alias("v"))


def stock_by_skill(rows: DataFrame, taxonomy: list[dict], overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """(skill, state, quarter, persons) from (occupation, state, quarter, thousands); ``national`` is the sum of the states.

    An occupation reads "1234 Title"; titles not further defined (nfd) and rows
    without a code belong to no skill; a missing figure counts as none.
    """
    code = F.regexp_extract("occupation", r"^\s*(\d{4})\s+(.*)$", 1)
    title = F.trim(F.regexp_extract("occupation", r"^\s*(\d{4})\s+(.*)$", 2))
    read = rows.select("state", "quarter", (F.coalesce("thousands", F.lit(0.0)) * 1000).alias("persons"), code.alias("code"), title.alias("title"))
    known = read.where((F.col("code") != "") & ~F.lower("title").endswith("nfd"))
    each = known.withColumn("skill", F.explode(mapped_skills(F.col("title"), F.col("code"), taxonomy, overrides or {})))
    by_state = each.groupBy("skill", "state", "quarter").agg(_whole(F.sum("persons")).alias("persons"))
    whole = by_state.groupBy("skill", "quarter").agg(F.sum("persons").alias("persons")).withColumn("state", F.lit("national"))
    return by_state.unionByName(whole)


def shares(members: DataFrame) -> DataFrame:
    """(skill, grp, share) of members (skill, grp, weight); a weight counts at least 1, so every skill has a share."""
    w = F.greatest(F.coalesce("weight", F.lit(0)), F.lit(1))
    return members.select("skill", "grp", (w / F.sum(w).over(Window.partitionBy("grp"))).alias("share"))


def _on_months(values: DataFrame, months: DataFrame, keys: list[str], start: str, value: str) -> DataFrame:
    """(keys, month, value): each key's value of the period that holds the month, or of the last period before; null before the first."""
    grid = values.select(*keys).distinct().join(F.broadcast(months.select("month").distinct()))
    marked = values.where(F.col(value).isNotNull()).select(*keys, F.col(start).alias("month"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    every = marked.unionByName(grid.select(*keys, "month", F.lit(None).cast(values.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")))
    past = Window.partitionBy(*keys).orderBy("month", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last("_v", True).over(past)).where("_side = 1").select(*keys, "month", value)


def shared_out(groups: DataFrame, members: DataFrame, months: DataFrame, cities: DataFrame) -> DataFrame:
    """(skill, city, month, v) from quarterly group totals (grp, quarter, value) with quarters labelled by their first month.

    A group's figure is carried on after its last quarter and nought before its
    first; it is shared out by the members' weights and rounded, then by the cities'
    (city, w) and rounded again.
    """
    at = _on_months(groups.withColumn("value", F.col("value").cast("double")), months, ["grp"], "quarter", "value")
    national = at.join(shares(members), "grp").select("skill", "month", half_up(F.coalesce("value", F.lit(0.0)) * F.col("share")).alias("n"))
    return national.join(F.broadcast(cities)).select("skill", "city", "month", _whole(F.col("n") * F.col("w")).alias("v"))


def indexed(index: DataFrame, members: DataFrame, months: DataFrame, anchor: Column, level: float) -> DataFrame:
    """(skill, month, v): a level at the anchor month, shared out over all skills, moved by each group's index (grp, quarter, value).

    Nought before a group's first quarter; 100 stands in for an index missing at the anchor.
    """
    weighed = members.select("skill", "grp", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(1)).alias("w"))
    now = weighed.join(F.broadcast(weighed.agg(F.sum("w").alias("all")))).select("skill", "grp", (F.lit(level) * F.col("w") / F.col("all")).alias("cur"))  # one row
    at = _on_months(index.withColumn("value", F.col("value").cast("double")), months, ["grp"], "quarter", "value")
    base = at.where(F.col("month") == anchor).select("grp", F.col("value").alias("base"))
    joined = at.join(base, "grp", "left").join(now, "grp")
    v = F.col("cur") * F.col("value") / F.coalesce("base", F.lit(100.0))
    return joined.select("skill", "month", F.coalesce(_whole(v), F.lit(0)).alias("v"))


def inherited(sections: DataFrame, members: DataFrame, months: DataFrame) -> DataFrame:
    """(skill, month, v): every skill of a section (grp) has the section's own figure, not a part of it.

    A quarterly figure (grp, quarter_end, value), dated at its last month, holds for
    its three months, and is carried on where later ones are missing.
    """
    held = sections.where(F.col("value").isNotNull()).withColumn("month", F.explode(F.expr("sequence(add_months(quarter_end, -2), quarter_end, interval 1 month)")))
    at = _on_months(held, months, ["grp"], "month", "value").where("value IS NOT NULL")
    return at.join(members.select("grp", "skill").distinct(), "grp").select("skill", "month", F.col("value").alias("v"))


def held_flat(annual: DataFrame, months: DataFrame) -> DataFrame:
    """(skill, geo, month, v) from annual thousands (skill, geo, year, thousands), the year's figure held flat and carried on.

    Figures that round to nought are left out: they are no measured absence.
    """
    counts = annual.withColumn("n", _whole(F.col("thousands") * 1000)).where("n > 0")
    yearly = counts.groupBy("skill", "geo", "year").agg(F.sum("n").alias("v")).withColumn("start", F.make_date("year", F.lit(1), F.lit(1)))
    return _on_months(yearly, months, ["skill", "geo"], "start", "v").where("v IS NOT NULL")


def openings_by_skill(employed: DataFrame, rates: DataFrame, months: DataFrame) -> DataFrame:
    """(skill, month, v): employment of the latest year at or before the month (skill, year, employed) times the openings rate (month, rate) in force; null without either."""
    yearly = employed.withColumn("start", F.make_date("year", F.lit(1), F.lit(1)))
    stock = _on_months(yearly, months, ["skill"], "start", "employed")
    rate = _on_months(rates.withColumn("all", F.lit(0)).withColumnRenamed("month", "from"), months, ["all"], "from", "rate")
    return stock.join(F.broadcast(rate.select("month", "rate")), "month").select("skill", "month", _whole(openings(F.col("employed"), F.col("rate"))).alias("v"))


def by_group(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """(skill, year, persons): each skill with the figure of the group it is mapped to by hand (skill, grp); an unmeasured year stays null."""
    return bridge.join(rows, "grp").select("skill", "year", "persons")


def inverted_rates(quotes: DataFrame) -> DataFrame:
    """(currency, to_home) from quotes of the home currency in others (currency, per_home), to six decimals; quotes of nought or less are left out."""
    return quotes.where("per_home > 0").select("currency", half_up(1 / F.col("per_home"), 6).alias("to_home"))


def monthly_close(prices: DataFrame) -> DataFrame:
    """(listing, month, close): the last close of each month that isn't null; a month without one is missing, not carried."""
    known = prices.where(F.col("close").isNotNull())
    return known.groupBy("listing", F.trunc("day", "month").alias("month")).agg(F.max_by("close", "day").alias("close"))
