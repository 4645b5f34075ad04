"""Series over months: coverage rules, demand bands, rates, disaggregation, comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import half_up, per_thousand
from ..operators import coverage, series, stats
from .fixture import ADS, AS_OF, CUBE, EMPLOYMENT, MONTHLY, ads, cube, employment, exploded, monthly
from .registry import query

_FEEDS = f"WITH {ADS}, feeds AS (SELECT hub, max(last_seen) AS mx, min(first_seen) AS mn, count(*) AS n FROM ads WHERE first_seen <= DATE '2001-07-31' GROUP BY hub)"


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ads(spark, sf_dir).where(F.col("first_seen") <= F.lit(AS_OF))
    return rows.groupBy("hub").agg(F.max("last_seen").alias("mx"), F.min("first_seen").alias("mn"), F.count(F.lit(1)).alias("n"))


@query(f"{_FEEDS} SELECT max(mx) AS coverage_day FROM (SELECT DISTINCT mx, (SELECT sum(n) FROM feeds g WHERE g.mx >= f.mx) AS run FROM feeds f) WHERE run >= 0.95 * (SELECT sum(n) FROM feeds)", days="coverage_day")
def coverage_day(spark, sf_dir):
    return coverage.coverage_day(_feeds(spark, sf_dir))


@query(f"{_FEEDS} SELECT min(mn) AS covered_from FROM (SELECT DISTINCT mn, (SELECT sum(n) FROM feeds g WHERE g.mn <= f.mn) AS run FROM feeds f) WHERE run >= 0.95 * (SELECT sum(n) FROM feeds)", days="covered_from")
def covered_from(spark, sf_dir):
    return coverage.covered_from(_feeds(spark, sf_dir))


@query(f"{_FEEDS} SELECT max(w)::INT AS window_days FROM range(3, 31) AS r(w) WHERE (SELECT sum(n) FROM feeds WHERE mn <= DATE '2001-07-31' - (2 * w - 1)::INT) >= 0.5 * (SELECT sum(n) FROM feeds)")
def longest_window(spark, sf_dir):
    return coverage.longest_window(_feeds(spark, sf_dir), AS_OF)


@query(f"""WITH {ADS}, d AS (SELECT first_seen AS day, count(*) AS n FROM ads WHERE first_seen <= DATE '2001-07-31' GROUP BY first_seen ORDER BY day DESC LIMIT 60)
SELECT min(day) AS collection_start FROM d WHERE n >= 0.1 * (SELECT list_sort(list(n))[count(*) // 2 + 1] FROM d)""", days="collection_start")
def collection_start(spark, sf_dir):
    days = ads(spark, sf_dir).where(F.col("first_seen") <= F.lit(AS_OF)).groupBy(F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return coverage.collection_start(days)


@query(f"""{_FEEDS}, c AS (SELECT max(mx) AS covered FROM (SELECT DISTINCT mx, (SELECT sum(n) FROM feeds g WHERE g.mx >= f.mx) AS run FROM feeds f) WHERE run >= 0.95 * (SELECT sum(n) FROM feeds))
SELECT greatest(least(covered, DATE '2001-07-31'), DATE '2001-07-28') AS as_of_day FROM c""", days="as_of_day")
def as_of_day(spark, sf_dir):
    """The covered day, but three days back at most, and never after today."""
    day = coverage.coverage_day(_feeds(spark, sf_dir))
    return day.select(F.greatest(F.least("coverage_day", F.lit(AS_OF)), F.date_sub(F.lit(AS_OF), 3)).alias("as_of_day"))


@query(f"WITH {MONTHLY} SELECT skill, month, v, floor(100.0 * (rank() OVER (PARTITION BY month ORDER BY v) - 1) / count(*) OVER (PARTITION BY month) + 0.5)::BIGINT AS percentile FROM monthly", days="month")
def demand_percentile(spark, sf_dir):
    """Percent of the month's skills with strictly less demand."""
    return monthly(spark, sf_dir).withColumn("percentile", stats.percent_below(F.col("v"), "month"))


@query(f"""WITH {MONTHLY}, s AS (SELECT list_sort(list(v)) AS vs, count(*) AS n FROM monthly), t AS (SELECT vs[least(n - 1, floor(0.34 * n)::BIGINT) + 1] AS low, vs[least(n - 1, floor(0.67 * n)::BIGINT) + 1] AS high FROM s)
SELECT skill, month, v, CASE WHEN v >= high THEN 'High' WHEN v >= low THEN 'Moderate' ELSE 'Low' END AS band FROM monthly, t""", days="month")
def demand_band(spark, sf_dir):
    """Low, Moderate or High by thresholds at 34 and 67 percent of the values."""
    m = monthly(spark, sf_dir)
    cuts = m.agg(stats.threshold("v", 0.34).alias("low"), stats.threshold("v", 0.67).alias("high"))
    band = F.when(F.col("v") >= F.col("high"), "High").when(F.col("v") >= F.col("low"), "Moderate").otherwise("Low")
    return m.join(F.broadcast(cuts)).select("skill", "month", "v", band.alias("band"))


_AXIS = MONTHLY + ", axis AS (SELECT CAST(d AS DATE) AS month FROM range((SELECT min(month) FROM monthly), (SELECT max(month) + INTERVAL 1 DAY FROM monthly), INTERVAL 1 MONTH) AS r(d)), full_m AS (SELECT k.skill, axis.month, coalesce(m.v, 0)::BIGINT AS v FROM (SELECT DISTINCT skill FROM monthly) k CROSS JOIN axis LEFT JOIN monthly m ON m.skill = k.skill AND m.month = axis.month)"


def _full_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.on_month_axis(monthly(spark, sf_dir), ["skill"], "v")


@query(f"""WITH {_AXIS}, l AS (SELECT x.*, b.v AS y1, c.v AS y5 FROM full_m x LEFT JOIN full_m b ON b.skill = x.skill AND b.month = x.month - INTERVAL 12 MONTH LEFT JOIN full_m c ON c.skill = x.skill AND c.month = x.month - INTERVAL 60 MONTH),
p AS (SELECT skill, month AS peak_month, v AS peak FROM full_m QUALIFY row_number() OVER (PARTITION BY skill ORDER BY v DESC, month) = 1)
SELECT skill, month, v, CASE WHEN y1 > 0 THEN floor((v - y1) / y1 * 1000 + 0.5) / 10 END AS yoy, CASE WHEN y5 > 0 THEN floor((v - y5) / y5 * 1000 + 0.5) / 10 END AS five_year, peak_month, peak
FROM l JOIN p USING (skill) WHERE month = (SELECT max(month) FROM monthly)""", days="month peak_month")
def yoy_five_year_peak(spark, sf_dir):
    """The latest month of each skill against 12 and 60 months before, whatever months hold no advertisement, and the first month of its peak."""
    m = _full_months(spark, sf_dir)
    v, by = F.col("v"), Window.partitionBy("skill")
    peak = F.max(F.struct("v", -F.unix_date("month"), "month")).over(by)
    marked = m.select("*", series.lag_change(v, ["skill"], "month", 12).alias("yoy"), series.lag_change(v, ["skill"], "month", 60).alias("five_year"), F.max("month").over(by).alias("latest"), peak.alias("p"))
    return marked.where("month = latest").select("skill", "month", "v", "yoy", "five_year", F.col("p.month").alias("peak_month"), F.col("p.v").alias("peak"))


@query(f"""WITH {_AXIS}, l AS (SELECT *, coalesce(lag(v, 12) OVER w, first_value(v) OVER w) AS b FROM full_m WINDOW w AS (PARTITION BY skill ORDER BY month))
SELECT skill, month, CASE WHEN b > 0 THEN floor((v - b) / b * 1000 + 0.5) / 10 ELSE 0 END AS pct FROM l""", days="month")
def trailing_change(spark, sf_dir):
    """Each month against twelve before, or against the first month of all where there are fewer."""
    return _full_months(spark, sf_dir).select("skill", "month", series.trailing_change(F.col("v"), ["skill"], "month").alias("pct"))


@query(f"WITH {CUBE}, s AS (SELECT skill, month, sum(v)::BIGINT AS v FROM cube WHERE place IN ('CHINA', 'INDIA', 'JAPAN', 'FRANCE', 'GERMANY', 'NATION_1', 'NATION_2', 'NATION_3') OR place LIKE '%1%' GROUP BY ALL) SELECT skill, month, v FROM s QUALIFY row_number() OVER (PARTITION BY skill ORDER BY month DESC) = 1 AND v >= 3 ORDER BY v DESC, skill LIMIT 12", days="month")
def top_skills_in_scope(spark, sf_dir):
    """The latest month's demand of each skill over the places of a scope, floor applied."""
    places = ["CHINA", "INDIA", "JAPAN", "FRANCE", "GERMANY", "NATION_1", "NATION_2", "NATION_3"]
    s = cube(spark, sf_dir).where(F.col("place").isin(places) | F.col("place").contains("1")).groupBy("skill", "month").agg(F.sum("v").alias("v"))
    return stats.rank_within(s, ["skill"], [F.desc("month")], 1).where("v >= 3").orderBy(F.desc("v"), "skill").limit(12).select("skill", "month", "v")


@query(f"""WITH {MONTHLY}, {EMPLOYMENT}
SELECT m.skill, m.month, m.v, e.employed, CASE WHEN e.employed >= 1000 THEN floor(1000.0 * m.v / e.employed * 10 + 0.5) / 10 END AS rate, (datediff('month', e.quarter, m.month))::INT AS lag_months
FROM monthly m ASOF LEFT JOIN employment e ON m.skill = e.skill AND m.month >= e.quarter""", days="month")
def vacancy_rate_asof(spark, sf_dir):
    """Vacancies per 1,000 employed at the latest quarter at or before the month; no quarter, no rate."""
    joined = series.asof_backward(monthly(spark, sf_dir), employment(spark, sf_dir), ["skill"], "month", "quarter", "employed")
    lag = F.months_between("month", "employed_at").cast("int")
    return joined.select("skill", "month", "v", "employed", per_thousand(F.col("v"), F.col("employed")).alias("rate"), lag.alias("lag_months"))


@query(f"""WITH {CUBE}, ax AS (SELECT DISTINCT month FROM cube), s AS (SELECT DISTINCT skill, place FROM cube), g AS (SELECT skill, place, month, v FROM s CROSS JOIN ax LEFT JOIN cube USING (skill, place, month))
SELECT skill, place, month, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY skill, place ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM g""", days="month")
def locf_series(spark, sf_dir):
    """Every series on the whole axis: the last value carried forward, zero before the first."""
    grid = series.month_axis(cube(spark, sf_dir), ["skill", "place"], "v")
    return grid.select("skill", "place", "month", F.coalesce(series.carry_forward(F.col("v"), ["skill", "place"], "month"), F.lit(0)).alias("v"))


@query(f"WITH {MONTHLY} SELECT skill, month, v, floor(1000.0 * v / first_value(v) OVER (PARTITION BY skill ORDER BY month) + 0.5) / 10 AS index_100 FROM monthly", days="month")
def rebase_index(spark, sf_dir):
    return monthly(spark, sf_dir).withColumn("index_100", series.rebased(F.col("v"), ["skill"], "month"))


@query(f"""WITH {CUBE}, g AS (SELECT month, sum(v)::BIGINT AS total FROM cube GROUP BY month), w AS (SELECT skill, sum(v) AS w FROM cube GROUP BY skill)
SELECT skill, month, floor(total * (greatest(w, 1) / (SELECT sum(greatest(w, 1)) FROM w)) + 0.5)::BIGINT AS v FROM g CROSS JOIN w""", days="month")
def disaggregate_share(spark, sf_dir):
    """Monthly totals of a group given to its skills by their share of the whole period, rounded at the end."""
    c = cube(spark, sf_dir)
    weights = series.with_share(c.groupBy("skill").agg(F.sum("v").alias("w")).withColumn("g", F.lit(0)), ["g"], F.col("w"))
    totals = c.groupBy("month").agg(F.sum("v").alias("total")).withColumn("g", F.lit(0))
    return totals.join(F.broadcast(weights), "g").select("skill", "month", half_up(F.col("total") * F.col("share")).cast("long").alias("v"))


@query(f"WITH {ADS} SELECT country, hub, count(*) AS n, grouping(hub)::INT AS is_total FROM ads WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31' GROUP BY ROLLUP (country, hub)")
def region_rollup(spark, sf_dir):
    live = ads(spark, sf_dir).where((F.col("first_seen") <= F.lit(AS_OF)) & (F.col("last_seen") >= F.lit(AS_OF)))
    return live.rollup("country", "hub").agg(F.count(F.lit(1)).alias("n"), F.grouping("hub").cast("int").alias("is_total"))


@query(f"""WITH {MONTHLY}, {EMPLOYMENT}, d AS (SELECT skill, sum(v)::DOUBLE AS v FROM monthly WHERE month >= DATE '2001-01-01' GROUP BY skill), e AS (SELECT skill, sum(employed)::DOUBLE AS e FROM employment GROUP BY skill)
SELECT skill, floor((v / max(v) OVER () + 1.25 * (e / max(e) OVER ())) * 1000 + 0.5) / 1000 AS score FROM d JOIN e USING (skill)""")
def popular_skills(spark, sf_dir):
    """Two measures, each over its own maximum, blended 1 to 1.25."""
    d = monthly(spark, sf_dir).where("month >= DATE '2001-01-01'").groupBy("skill").agg(F.sum("v").cast("double").alias("v"))
    e = employment(spark, sf_dir).groupBy("skill").agg(F.sum("employed").cast("double").alias("e"))
    j = d.join(e, "skill")
    return j.select("skill", half_up(series.own_maximum(F.col("v")) + 1.25 * series.own_maximum(F.col("e")), 3).alias("score"))


@query(f"""WITH {_AXIS}, l AS (SELECT x.*, b.v AS b FROM full_m x JOIN full_m b ON b.skill = x.skill AND b.month = x.month - INTERVAL 3 MONTH), c AS (SELECT skill, month, v, (v - b) * 100.0 / b AS pct FROM l WHERE b > 0)
SELECT skill, month, floor(pct * 10 + 0.5) / 10 AS pct, CASE WHEN abs(pct) <= 0.35 THEN 'flat' WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction FROM c""", days="month")
def skill_card_change(spark, sf_dir):
    """Change over three months, counted on the calendar, with a flat band of 0.35 percent."""
    b = F.lag("v", 3).over(Window.partitionBy("skill").orderBy("month"))
    c = _full_months(spark, sf_dir).withColumn("b", b).where("b > 0").withColumn("pct", (F.col("v") - F.col("b")) * 100 / F.col("b"))
    direction = F.when(F.abs("pct") <= 0.35, "flat").when(F.col("pct") > 0, "up").otherwise("down")
    return c.select("skill", "month", half_up(F.col("pct"), 1).alias("pct"), direction.alias("direction"))


@query(f"""{_FEEDS.replace("WITH ads", "WITH ads")}, r AS (SELECT hub, n, floor((n - lo) / nullif(hi - lo, 0)::DOUBLE * 1000 + 0.5) / 1000 AS s FROM feeds, (SELECT min(n) AS lo, max(n) AS hi FROM feeds)) SELECT hub, n, coalesce(s, 0.5) AS position, floor(n * 1000000 / 7.0 * 100 + 0.5) / 100 AS per_head FROM r""")
def radar_positions(spark, sf_dir):
    """Where each hub lies between the least and the largest, and a ratio per head."""
    f = _feeds(spark, sf_dir).select("hub", "n")
    return f.select("hub", "n", half_up(stats.scaled(F.col("n")), 3).alias("position"), stats.per_head(F.col("n"), F.lit(7.0)).alias("per_head"))


@query(f"""WITH {ADS}, c AS (SELECT company_id, any_value(country) AS country, avg(salary) AS pay, count(*)::DOUBLE AS roles FROM ads GROUP BY company_id), b AS (SELECT country, avg(nullif(pay, 0)) AS pay_b, avg(nullif(roles, 0)) AS roles_b FROM c GROUP BY country)
SELECT company_id, CASE WHEN abs(floor(1000 * (pay - pay_b) / pay_b + 0.5) / 10) < 0.5 THEN 0.0 ELSE floor(1000 * (pay - pay_b) / pay_b + 0.5) / 10 END AS pay_gap, CASE WHEN abs(floor(1000 * (roles - roles_b) / roles_b + 0.5) / 10) < 0.5 THEN 0.0 ELSE floor(1000 * (roles - roles_b) / roles_b + 0.5) / 10 END AS roles_gap,
  floor(100.0 * (rank() OVER (PARTITION BY country ORDER BY roles) - 1) / count(*) OVER (PARTITION BY country) + 0.5)::BIGINT AS percentile FROM c JOIN b USING (country)""")
def compare_metrics(spark, sf_dir):
    """An employer's metrics against its market's mean (zeros left out), small gaps as none."""
    from ..functions.money import gap

    c = ads(spark, sf_dir).groupBy("company_id").agg(F.first("country").alias("country"), F.avg("salary").alias("pay"), F.count(F.lit(1)).cast("double").alias("roles"))
    b = c.groupBy("country").agg(F.avg(F.nullif("pay", F.lit(0))).alias("pay_b"), F.avg(F.nullif("roles", F.lit(0))).alias("roles_b"))
    j = c.join(b, "country")
    return j.select("company_id", gap(F.col("pay"), F.col("pay_b")).alias("pay_gap"), gap(F.col("roles"), F.col("roles_b")).alias("roles_gap"), stats.percent_below(F.col("roles"), "country").alias("percentile"))


@query(f"""WITH {CUBE}, {EMPLOYMENT}, r AS (SELECT skill, employed FROM employment WHERE quarter = DATE '2001-04-01' AND employed >= 1000)
SELECT place, sum(v)::BIGINT AS v, floor(sum(v * 1000.0 / employed) * 1000 + 0.5) / 1000 AS rate FROM cube JOIN r USING (skill) WHERE month = DATE '2001-06-01' GROUP BY place""")
def city_demand_at(spark, sf_dir):
    """A month's demand by place in rate mode: skills without a denominator are left out, not counted as zero."""
    r = employment(spark, sf_dir).where("quarter = DATE '2001-04-01' AND employed >= 1000").select("skill", "employed")
    j = cube(spark, sf_dir).where("month = DATE '2001-06-01'").join(r, "skill")
    return j.groupBy("place").agg(F.sum("v").alias("v"), half_up(F.sum(F.col("v") * 1000.0 / F.col("employed")), 3).alias("rate"))


@query(f"""WITH {MONTHLY}, r AS (SELECT skill AS panel, month AS start, v AS value, lead(month) OVER (PARTITION BY skill ORDER BY month) AS nxt FROM monthly WHERE month(month) IN (1, 6)), ax AS (SELECT DISTINCT month FROM monthly)
SELECT panel, value, month FROM r JOIN ax ON month >= start AND (nxt IS NULL OR month < nxt)""", days="month")
def hold_rounds(spark, sf_dir):
    """Survey rounds (January and June) held until the same panel's next round."""
    m = monthly(spark, sf_dir)
    rounds = m.where(F.month("month").isin(1, 6)).select(F.col("skill").alias("panel"), F.col("month").alias("start"), F.col("v").alias("value"))
    return series.hold_rounds(rounds, m)


@query(f"""WITH {MONTHLY}, q AS (SELECT skill, CAST(date_trunc('quarter', month) AS DATE) AS quarter, sum(v)::BIGINT AS v FROM monthly GROUP BY ALL), t AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY skill ORDER BY quarter DESC) <= 8)
SELECT skill, quarter, floor(1000.0 * v / first_value(v) OVER (PARTITION BY skill ORDER BY quarter) + 0.5) / 10 AS index_100 FROM t""", days="quarter")
def basket_index(spark, sf_dir):
    """The last eight quarters, 100 at the first shown."""
    q = monthly(spark, sf_dir).groupBy("skill", F.trunc("month", "quarter").alias("quarter")).agg(F.sum("v").alias("v"))
    t = stats.rank_within(q, ["skill"], [F.desc("quarter")], 8)
    return t.select("skill", "quarter", series.rebased(F.col("v"), ["skill"], "quarter").alias("index_100"))


@query(f"""WITH {ADS}, d AS (SELECT company_id, first_seen AS day, count(*) AS opened FROM ads GROUP BY ALL), e AS (SELECT company_id, day, opened FROM d WHERE day > DATE '2001-07-01' AND day <= DATE '2001-07-31')
SELECT company_id, arg_max(opened, day) - arg_min(opened, day) AS change, count(*) AS points FROM e GROUP BY company_id HAVING count(*) >= 2""")
def company_velocity(spark, sf_dir):
    """Last against first day of the last thirty, per employer with two days or more."""
    d = ads(spark, sf_dir).groupBy("company_id", F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("opened")).where(F.col("day").between(F.lit(date(2001, 7, 2)), F.lit(AS_OF)))
    e = d.groupBy("company_id").agg((F.max_by("opened", "day") - F.min_by("opened", "day")).alias("change"), F.count(F.lit(1)).alias("points"))
    return e.where("points >= 2")


@query(f"""WITH {ADS}, ex AS (SELECT * EXCLUDE skills, unnest(list_distinct(skills)) AS skill FROM ads), s AS (SELECT category AS sector, skill, count(*) AS n FROM ex GROUP BY ALL) SELECT sector, skill, n FROM s QUALIFY row_number() OVER (PARTITION BY sector ORDER BY n DESC, skill) <= 5""")
def sector_skills(spark, sf_dir):
    s = exploded(ads(spark, sf_dir)).groupBy(F.col("category").alias("sector"), "skill").agg(F.count(F.lit(1)).alias("n"))
    return stats.rank_within(s, ["sector"], [F.desc("n"), F.asc("skill")], 5).drop("place")
