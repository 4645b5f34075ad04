"""The market now: live advertisements, skills, pay, employers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.money import clamp, half_up
from ..operators import archive, series, stats
from .fixture import ADS, AS_OF, LIVE, SKILLS, ads, exploded
from .registry import query


def _back(days: int) -> date:
    return AS_OF - timedelta(days=days)


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads(spark, sf_dir).where(archive.live_feeds() & archive.live_on(AS_OF))


def count_between(day: str, lo: date, hi: date):
    return F.count_if(F.col(day).between(F.lit(lo), F.lit(hi)))


@query(f"WITH {ADS} SELECT job_key, source, company_id, hub, country, category, first_seen, last_seen, (last_seen - first_seen)::INT AS days_advertised FROM ads", days="first_seen last_seen")
def ads_view(spark, sf_dir):
    return ads(spark, sf_dir).select("job_key", "source", "company_id", "hub", "country", "category", "first_seen", "last_seen", F.datediff("last_seen", "first_seen").alias("days_advertised"))


@query(f"{LIVE} SELECT source, count(*) AS live_ads, count(DISTINCT company_id) AS employers, min(first_seen) AS oldest FROM live GROUP BY source", days="oldest")
def live_on_day(spark, sf_dir):
    return _live(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("live_ads"), F.countDistinct("company_id").alias("employers"), F.min("first_seen").alias("oldest"))


@query(f"WITH {ADS} SELECT CAST(d AS DATE) AS day, count(job_key) AS live_ads FROM range(DATE '2001-07-02', DATE '2001-08-01', INTERVAL 1 DAY) AS r(d) LEFT JOIN ads ON first_seen <= d AND last_seen >= d GROUP BY d", days="day")
def daily_live_series(spark, sf_dir):
    days = series.live_days(ads(spark, sf_dir).where(archive.live_feeds()), _back(29), AS_OF).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return series.calendar(spark, _back(29), AS_OF).join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("live_ads"))


@query(f"WITH {ADS} SELECT CAST(d AS DATE) AS day, count(DISTINCT (company_id, title)) AS roles FROM range(DATE '2001-05-03', DATE '2001-08-01', INTERVAL 1 DAY) AS r(d) JOIN ads ON first_seen <= d AND last_seen >= d GROUP BY d", days="day")
def distinct_role_trend(spark, sf_dir):
    """Distinct roles (employer and normalised title) live per day over 90 days, from the first covered day."""
    rows = ads(spark, sf_dir).where(archive.live_feeds()).withColumn("role", F.concat_ws("|", "company_id", tx.norm(F.col("title"))))
    daily = series.live_days(rows, _back(89), AS_OF).groupBy("day").agg(F.countDistinct("role").alias("roles"))
    return series.trim_leading(daily.withColumn("scope", F.lit(0)), ["scope"], "day", "roles").select("day", "roles")


@query(f"""{SKILLS}, live AS (SELECT * FROM ex WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31'),
g AS (SELECT skill, count(*) AS global_n FROM live GROUP BY skill), l AS (SELECT skill, count(*) AS local_n FROM live WHERE country = 'ASIA' GROUP BY skill)
SELECT skill, global_n, rank() OVER (ORDER BY global_n DESC) AS global_rank, count(*) OVER () AS global_of, local_n,
  CASE WHEN local_n IS NOT NULL THEN rank() OVER (ORDER BY local_n DESC NULLS LAST) END AS local_rank FROM g LEFT JOIN l USING (skill)""")
def skill_market_ranks(spark, sf_dir):
    """Each skill's rank among live advertisements, worldwide and in one market; null where it is absent."""
    live = exploded(_live(spark, sf_dir))
    counts = live.groupBy("skill").agg(F.count(F.lit(1)).alias("global_n"), F.nullif(F.count_if(F.col("country") == "ASIA"), F.lit(0)).alias("local_n"))
    everywhere = Window.partitionBy()
    local = F.when(F.col("local_n").isNotNull(), F.rank().over(Window.orderBy(F.desc_nulls_last("local_n"))))
    return counts.select("skill", "global_n", stats.competition_rank(F.col("global_n")).alias("global_rank"), F.count(F.lit(1)).over(everywhere).alias("global_of"), "local_n", local.alias("local_rank"))


@query(f"""{SKILLS}, c AS (SELECT skill, count(*) FILTER (first_seen BETWEEN DATE '2001-07-01' AND DATE '2001-07-31') AS now_n, count(*) FILTER (first_seen BETWEEN DATE '2001-06-01' AND DATE '2001-07-01') AS prev_n FROM ex GROUP BY skill)
SELECT skill, now_n, prev_n, now_n - prev_n AS delta, CASE WHEN prev_n = 0 THEN 100.0 ELSE floor(1000.0 * (now_n - prev_n) / prev_n + 0.5) / 10 END AS pct
FROM c WHERE now_n + prev_n > 0 ORDER BY abs(now_n - prev_n) DESC, delta DESC, skill LIMIT 8""")
def skill_movers(spark, sf_dir):
    """New advertisements of 30 days against the 30 before (they share the boundary day); the eight largest moves."""
    rows = exploded(ads(spark, sf_dir).where(archive.live_feeds() & F.col("first_seen").between(F.lit(_back(60)), F.lit(AS_OF))))
    c = rows.groupBy("skill").agg(count_between("first_seen", _back(30), AS_OF).alias("now_n"), count_between("first_seen", _back(60), _back(30)).alias("prev_n")).where("now_n + prev_n > 0")
    delta = F.col("now_n") - F.col("prev_n")
    pct = F.when(F.col("prev_n") == 0, 100.0).otherwise(half_up(100 * delta / F.col("prev_n"), 1))
    return c.select("*", delta.alias("delta"), pct.alias("pct")).orderBy(F.desc(F.abs("delta")), F.desc("delta"), "skill").limit(8)


@query(f"""{SKILLS}, c AS (SELECT skill, w, count(*) FILTER (first_seen > DATE '2001-07-31' - w) AS now_n, count(*) FILTER (first_seen <= DATE '2001-07-31' - w AND first_seen > DATE '2001-07-31' - 2 * w) AS prev_n
  FROM ex, (VALUES (1), (7), (30)) AS v(w) WHERE first_seen <= DATE '2001-07-31' GROUP BY skill, w)
SELECT skill, w, now_n, prev_n, least(greatest(CASE WHEN prev_n = 0 THEN 100.0 ELSE floor(1000.0 * (now_n - prev_n) / prev_n + 0.5) / 10 END, -16.0), 24.0) AS pct
FROM c WHERE now_n + prev_n >= 3 QUALIFY row_number() OVER (PARTITION BY w ORDER BY abs(now_n - prev_n) DESC, abs(pct) DESC, skill) <= 16""")
def market_ticker(spark, sf_dir):
    """Movers of 1, 7 and 30 days: at least three advertisements in both windows, changes clamped, sixteen each."""
    rows = exploded(ads(spark, sf_dir).where(archive.live_feeds() & F.col("first_seen").between(F.lit(_back(59)), F.lit(AS_OF))))
    counts = [c.alias(f"{side}{w}") for w in (1, 7, 30) for side, c in (("now", count_between("first_seen", _back(w - 1), AS_OF)), ("prev", count_between("first_seen", _back(2 * w - 1), _back(w))))]
    wide = rows.groupBy("skill").agg(*counts)
    parts = wide.select("skill", F.expr("stack(3, 1, now1, prev1, 7, now7, prev7, 30, now30, prev30) AS (w, now_n, prev_n)"))
    delta = F.col("now_n") - F.col("prev_n")
    pct = clamp(F.when(F.col("prev_n") == 0, 100.0).otherwise(half_up(100 * delta / F.col("prev_n"), 1)), -16.0, 24.0)
    return stats.rank_within(parts.where("now_n + prev_n >= 3").withColumn("pct", pct), ["w"], [F.desc(F.abs(delta)), F.desc(F.abs("pct")), F.asc("skill")], 16).drop("place")


@query(f"""{SKILLS}, c AS (SELECT skill,
  sum(greatest(0, (least(last_seen, DATE '2001-07-31') - greatest(first_seen, DATE '2001-07-02')) + 1)) / 30.0 AS now_level,
  sum(greatest(0, (least(last_seen, DATE '2001-07-01') - greatest(first_seen, DATE '2001-06-02')) + 1)) / 30.0 AS prev_level FROM ex GROUP BY skill),
m AS (SELECT skill, now_level, prev_level, floor(1000 * (now_level - prev_level) / prev_level + 0.5) / 10 AS pct FROM c WHERE now_level >= 3 AND prev_level >= 3)
SELECT * FROM (SELECT *, 'up' AS side, row_number() OVER (ORDER BY pct DESC, skill) AS place FROM m WHERE pct >= 0.5) WHERE place <= 6
UNION ALL SELECT * FROM (SELECT *, 'down' AS side, row_number() OVER (ORDER BY pct, skill) AS place FROM m WHERE pct <= -0.5) WHERE place <= 6""")
def market_risers_fallers(spark, sf_dir):
    """Mean daily level of 30 days against the 30 before: six skills that rose most, six that fell most."""
    rows = exploded(ads(spark, sf_dir).where(archive.live_feeds() & (F.col("last_seen") >= F.lit(_back(59))) & (F.col("first_seen") <= F.lit(AS_OF))))
    level = lambda a, b: F.sum(series.overlap_days(a, b)) / 30.0
    c = rows.groupBy("skill").agg(level(_back(29), AS_OF).alias("now_level"), level(_back(59), _back(30)).alias("prev_level")).where("now_level >= 3 AND prev_level >= 3")
    m = c.withColumn("pct", half_up(100 * (F.col("now_level") - F.col("prev_level")) / F.col("prev_level"), 1))
    up = stats.rank_within(m.where("pct >= 0.5").withColumn("side", F.lit("up")), ["side"], [F.desc("pct"), F.asc("skill")], 6)
    return up.unionByName(stats.rank_within(m.where("pct <= -0.5").withColumn("side", F.lit("down")), ["side"], [F.asc("pct"), F.asc("skill")], 6))


_MEDIANS = f"""{SKILLS}, live AS (SELECT * FROM ex WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31'),
per AS (SELECT skill, category, country, count(*) AS k, CASE WHEN count(salary) >= 8 THEN floor(median(salary) + 0.5)::BIGINT END AS m FROM live GROUP BY ALL),
pay AS (SELECT skill, category, floor(median(m) + 0.5)::BIGINT AS pay, count(m) AS markets, sum(k)::BIGINT AS now_n FROM per GROUP BY ALL)"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = stats.median_of_medians(exploded(_live(spark, sf_dir)), ["skill", "category"], "country", "salary")
    return priced.select("skill", "category", "pay", "markets", F.col("n").alias("now_n"))


@query(f"{_MEDIANS} SELECT *, pay * now_n AS value FROM pay")
def skill_market_value(spark, sf_dir):
    """Price, volume and value of each skill in its category; null where no market has eight priced rows."""
    return _priced(spark, sf_dir).withColumn("value", F.col("pay") * F.col("now_n"))


@query(f"{_MEDIANS} SELECT category, count(*) AS skills, count(pay) AS priced, sum(now_n)::BIGINT AS now_n, sum(pay * now_n)::BIGINT AS value FROM pay GROUP BY category")
def category_index(spark, sf_dir):
    """Categories: skills, priced ones, volume, and value (null if none is priced)."""
    return _priced(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("skills"), F.count("pay").alias("priced"), F.sum("now_n").alias("now_n"), F.sum(F.col("pay") * F.col("now_n")).alias("value"))


@query(f"{SKILLS} SELECT skill, CASE WHEN count(salary) >= 8 THEN floor(median(salary) + 0.5)::BIGINT END AS pay, count(*) AS n FROM ex WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31' GROUP BY skill")
def priced_median_pooled(spark, sf_dir):
    return exploded(_live(spark, sf_dir)).groupBy("skill").agg(stats.floored_median(F.col("salary")).alias("pay"), F.count(F.lit(1)).alias("n"))


@query(f"""{SKILLS}, live AS (SELECT * FROM ex WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31'),
per AS (SELECT skill, country, count(*) AS k, CASE WHEN count(salary) >= 8 THEN floor(median(salary) + 0.5)::BIGINT END AS m FROM live GROUP BY ALL)
SELECT skill, floor(median(m) + 0.5)::BIGINT AS pay, count(m) AS markets, sum(k)::BIGINT AS n FROM per GROUP BY skill""")
def priced_median_of_medians(spark, sf_dir):
    return stats.median_of_medians(exploded(_live(spark, sf_dir)), ["skill"], "country", "salary")


@query(f"""WITH {ADS}, pts AS (SELECT k.category, CAST(d AS DATE) AS day, count(job_key) AS n FROM range(DATE '2001-07-02', DATE '2001-08-01', INTERVAL 1 DAY) AS r(d) CROSS JOIN (SELECT DISTINCT category FROM ads WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-02') k LEFT JOIN ads ON first_seen <= d AND last_seen >= d AND ads.category = k.category GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day) AS i, count(*) OVER (PARTITION BY category) AS k FROM pts),
m AS (SELECT category, max(k) AS n_points, avg(n) FILTER (i <= k // 2) AS a, avg(n) FILTER (i > k - k // 2) AS b FROM p GROUP BY category)
SELECT category, n_points, CASE WHEN n_points >= 5 AND a > 0 THEN floor((b - a) / a * 100 * 10 + 0.5) / 10 END AS pct FROM m""")
def half_window_change(spark, sf_dir):
    """First against last half of thirty days; a day without advertisements counts as nought."""
    rows = ads(spark, sf_dir).where(archive.live_feeds())
    daily = series.live_days(rows, _back(29), AS_OF).groupBy("category", "day").agg(F.count(F.lit(1)).alias("n"))
    grid = daily.select("category").distinct().join(F.broadcast(series.calendar(spark, _back(29), AS_OF)))  # thirty rows
    full = grid.join(daily, ["category", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return series.half_window_change(full, ["category"], "day", "n")


@query(f"""{SKILLS}, live AS (SELECT * FROM ex WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31')
SELECT skill, hub, count(*) AS n, sum(count(*)) OVER (PARTITION BY skill)::BIGINT AS now_n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY skill) AS share FROM live GROUP BY skill, hub""")
def skill_hub_split(spark, sf_dir):
    """Live advertisements of a skill by hub beside the skill's own count."""
    by = Window.partitionBy("skill")
    n = exploded(_live(spark, sf_dir)).groupBy("skill", "hub").agg(F.count(F.lit(1)).alias("n"))
    return n.select("*", F.sum("n").over(by).alias("now_n"), (F.col("n") / F.sum("n").over(by)).alias("share"))


@query(f"{LIVE} SELECT count(DISTINCT (company_id, title)) AS roles, count(DISTINCT company_id) AS employers, count(DISTINCT country) AS countries, count(DISTINCT hub) AS cities, count(*) AS live_ads FROM live")
def landing_counters(spark, sf_dir):
    """Distinct roles, employers, countries and cities of what is live."""
    role = F.concat_ws("|", "company_id", tx.norm(F.col("title")))
    c = _live(spark, sf_dir).withColumn("role", role)
    return c.agg(F.countDistinct("role").alias("roles"), F.countDistinct("company_id").alias("employers"), F.countDistinct("country").alias("countries"), F.countDistinct("hub").alias("cities"), F.count(F.lit(1)).alias("live_ads"))


@query(f"""{SKILLS}, live AS (SELECT * FROM ex WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31')
SELECT skill, company_id, category, hub, count(*) AS n FROM live GROUP BY GROUPING SETS ((skill), (skill, company_id), (skill, category), (skill, hub))""")
def skill_index_groupingsets(spark, sf_dir):
    """A skill's live advertisements in total, by company, by sector and by city, in one pass."""
    live = exploded(_live(spark, sf_dir))
    sets = [[F.col("skill")], [F.col("skill"), F.col("company_id")], [F.col("skill"), F.col("category")], [F.col("skill"), F.col("hub")]]
    return live.groupingSets(sets, "skill", "company_id", "category", "hub").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ADS} SELECT job_key, company_id, title, first_seen, last_seen, (last_seen - first_seen)::INT AS span, last_seen >= DATE '2001-07-31' AS active FROM ads ORDER BY span DESC, first_seen, job_key LIMIT 40", days="first_seen last_seen")
def role_history(spark, sf_dir):
    """The forty longest-running advertisements and whether they still run."""
    rows = ads(spark, sf_dir).where(archive.live_feeds())
    cols = ["job_key", "company_id", "title", "first_seen", "last_seen"]
    return rows.select(*cols, F.datediff("last_seen", "first_seen").alias("span"), archive.advertised_now(AS_OF).alias("active")).orderBy(F.desc("span"), "first_seen", "job_key").limit(40)


@query(f"""{LIVE} SELECT company_id, title, source, job_key FROM live QUALIFY row_number() OVER (PARTITION BY company_id, title ORDER BY source, job_key) = 1""")
def open_roles(spark, sf_dir):
    """Roles open across all boards, each once per employer and title, from the board that comes first."""
    roles = _live(spark, sf_dir).withColumn("role", tx.norm(F.col("title")))
    return stats.rank_within(roles, ["company_id", "role"], [F.asc("source"), F.asc("job_key")], 1).select("company_id", "title", "source", "job_key")


@query(f"""{SKILLS}, c AS (SELECT skill, hub, count(*) FILTER (first_seen > DATE '2001-07-24') AS week_n, count(*) FILTER (first_seen <= DATE '2001-07-24' AND first_seen > DATE '2001-06-26') / 4.0 AS usual, count(*) FILTER (first_seen <= DATE '2001-07-24' AND first_seen > DATE '2001-06-05') AS past_n
  FROM ex WHERE first_seen <= DATE '2001-07-31' AND country IN ('ASIA', 'EUROPE') GROUP BY skill, hub)
SELECT skill, hub, week_n, usual, CASE WHEN past_n = 0 THEN 'new' WHEN week_n >= 1.5 * usual AND week_n >= 5 THEN 'spike' ELSE 'cooling' END AS alert FROM c
WHERE (past_n = 0 AND week_n >= 5) OR (usual > 0 AND week_n >= 1.5 * usual AND week_n >= 5) OR (usual >= 5 AND week_n <= 0.6 * usual) ORDER BY abs(week_n - usual) DESC, skill, hub LIMIT 40""")
def follow_alerts(spark, sf_dir):
    """Followed markets: this week's new advertisements against a usual week; spikes, cooling, and new skills."""
    follows = spark.createDataFrame([("ASIA",), ("EUROPE",)], "country string")
    rows = exploded(ads(spark, sf_dir).where(archive.live_feeds() & (F.col("first_seen") <= F.lit(AS_OF)))).join(F.broadcast(follows), "country", "left_semi")
    c = rows.groupBy("skill", "hub").agg(count_between("first_seen", _back(6), AS_OF).alias("week_n"), (count_between("first_seen", _back(34), _back(7)) / 4.0).alias("usual"), count_between("first_seen", _back(55), _back(7)).alias("past_n"))
    alert = F.when((F.col("past_n") == 0) & (F.col("week_n") >= 5), "new").when((F.col("usual") > 0) & (F.col("week_n") >= 1.5 * F.col("usual")) & (F.col("week_n") >= 5), "spike").when((F.col("usual") >= 5) & (F.col("week_n") <= 0.6 * F.col("usual")), "cooling")
    return c.select("skill", "hub", "week_n", "usual", alert.alias("alert")).where("alert IS NOT NULL").orderBy(F.desc(F.abs(F.col("week_n") - F.col("usual"))), "skill", "hub").limit(40)


@query(f"""{LIVE}, c AS (SELECT company_id, count(*) AS n FROM live GROUP BY company_id) SELECT company_id, n, floor(100.0 * n / max(n) OVER () + 0.5)::BIGINT AS of_leader, (SELECT count(*) FROM c) AS employers FROM c ORDER BY n DESC, company_id LIMIT 4""")
def top_employers(spark, sf_dir):
    """The four largest employers, each in percent of the first, beside the number of all employers."""
    c = _live(spark, sf_dir).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    whole = c.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("employers"))
    first = c.orderBy(F.desc("n"), "company_id").limit(4).join(F.broadcast(whole))  # one row
    return first.select("company_id", "n", half_up(100 * F.col("n") / F.col("most")).cast("long").alias("of_leader"), "employers")


@query(f"{LIVE}, a AS (SELECT company_id, category, count(*) AS n, median(salary) AS pay FROM live GROUP BY ALL) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC, category) <= 8")
def employer_area_mix(spark, sf_dir):
    """Each employer's areas with their median pay, eight at most."""
    a = _live(spark, sf_dir).groupBy("company_id", "category").agg(F.count(F.lit(1)).alias("n"), F.median("salary").alias("pay"))
    return stats.rank_within(a, ["company_id"], [F.desc("n"), F.asc("category")], 8).drop("place")


@query(f"""WITH {ADS}, n AS (SELECT company_id, category AS sector, count(*) AS k FROM ads GROUP BY ALL), m AS (SELECT company_id, sector FROM n QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY k DESC, sector) = 1),
c AS (SELECT company_id, any_value(country) AS country, count(*) AS roles FROM ads GROUP BY company_id)
SELECT sector, count(*) FILTER (country = 'ASIA' AND roles >= 30) AS employers, count(*) AS all_employers FROM c JOIN m USING (company_id) GROUP BY sector""")
def employer_facets(spark, sf_dir):
    """Employers per sector that pass all filters but the sector's own."""
    rows = ads(spark, sf_dir)
    sector = stats.rank_within(rows.groupBy("company_id", "category").agg(F.count(F.lit(1)).alias("n")), ["company_id"], [F.desc("n"), F.asc("category")], 1).select("company_id", F.col("category").alias("sector"))
    c = rows.groupBy("company_id").agg(F.first("country").alias("country"), F.count(F.lit(1)).alias("roles")).join(sector, "company_id")
    return c.groupBy("sector").agg(F.count_if((F.col("country") == "ASIA") & (F.col("roles") >= 30)).alias("employers"), F.count(F.lit(1)).alias("all_employers"))


@query(f"""WITH {ADS}, c AS (SELECT company_id, any_value(hub) AS hub, count(*) AS size FROM ads GROUP BY company_id),
o AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY size, company_id) AS i FROM c)
SELECT a.company_id, b.company_id AS peer, abs(a.size - b.size) AS apart FROM o a JOIN o b ON a.hub = b.hub AND b.i BETWEEN a.i - 3 AND a.i + 3 AND a.i <> b.i
QUALIFY row_number() OVER (PARTITION BY a.company_id ORDER BY abs(a.size - b.size), b.company_id) <= 3""")
def peers_nearest(spark, sf_dir):
    """Three peers of nearest size in an employer's market: only neighbours in size order are compared, never all pairs."""
    c = ads(spark, sf_dir).groupBy("company_id").agg(F.first("hub").alias("hub"), F.count(F.lit(1)).alias("size"))
    by = Window.partitionBy("hub").orderBy("size", "company_id")
    near = F.array_compact(F.array(*[step(F.struct("company_id", "size"), k).over(by) for k in (1, 2, 3) for step in (F.lag, F.lead)]))
    pairs = c.select("company_id", "size", near.alias("ps")).select("company_id", "size", F.explode("ps").alias("p"))
    apart = pairs.select("company_id", F.col("p.company_id").alias("peer"), F.abs(F.col("size") - F.col("p.size")).alias("apart"))
    return stats.rank_within(apart, ["company_id"], [F.asc("apart"), F.asc("peer")], 3).drop("place")


@query(f"WITH {ADS} SELECT DISTINCT substring(source || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(hub), '[^a-z0-9]+', ' ', 'g')), 1, 400) AS key FROM ads")
def job_key_norm(spark, sf_dir):
    return ads(spark, sf_dir).select(tx.job_key(F.col("source"), F.col("title"), F.col("company"), F.col("hub")).alias("key")).distinct()


@query(f"""{SKILLS} SELECT skill, floor(median(last_seen - first_seen) + 0.5)::BIGINT AS days_open, count(*) AS n FROM ex WHERE last_seen < DATE '2001-07-31' GROUP BY skill HAVING count(*) >= 8""")
def duration_by_skill(spark, sf_dir):
    """Median days that closed advertisements of a skill stayed up, for skills with eight or more."""
    rows = exploded(ads(spark, sf_dir).where(archive.live_feeds() & archive.closed_by(AS_OF)))
    g = rows.groupBy("skill").agg(F.percentile(F.datediff("last_seen", "first_seen"), 0.5).alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    return g.select("skill", half_up(F.col("m")).cast("long").alias("days_open"), "n")


@query(f"{LIVE} SELECT category, quantile_cont(salary, 0.25) AS p25, quantile_cont(salary, 0.5) AS p50, quantile_cont(salary, 0.75) AS p75, count(*) AS n FROM live GROUP BY category HAVING count(*) >= 20")
def pay_quantiles(spark, sf_dir):
    g = _live(spark, sf_dir).groupBy("category").agg(stats.quartiles(F.col("salary")).alias("q"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return g.select("category", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "n")


@query(f"""{SKILLS}, c AS (SELECT skill, count(*) FILTER (first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31') AS now_n, count(*) FILTER (first_seen <= DATE '2001-07-24' AND last_seen >= DATE '2001-07-24') AS then_n FROM ex GROUP BY skill)
SELECT skill, now_n, then_n, floor(100.0 * now_n / max(now_n) OVER () + 0.5)::BIGINT AS of_leader FROM c WHERE now_n > 0 ORDER BY now_n DESC, skill LIMIT 5""")
def analyst_skills(spark, sf_dir):
    """The five skills most asked for now, and their count a week before."""
    rows = exploded(ads(spark, sf_dir).where(archive.live_feeds()))
    c = rows.groupBy("skill").agg(F.count_if(archive.live_on(AS_OF)).alias("now_n"), F.count_if(archive.live_on(_back(7))).alias("then_n")).where("now_n > 0")
    return c.withColumn("of_leader", half_up(100 * F.col("now_n") / F.max("now_n").over(Window.partitionBy())).cast("long")).orderBy(F.desc("now_n"), "skill").limit(5)


@query(f"""WITH {ADS} SELECT count(*) FILTER (first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31') AS live_now, count(*) FILTER (first_seen <= DATE '2001-07-24' AND last_seen >= DATE '2001-07-24') AS live_then, count(*) FILTER (first_seen > DATE '2001-07-24' AND first_seen <= DATE '2001-07-31') AS new_in_window, count(DISTINCT company_id) FILTER (first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31') AS employers FROM ads WHERE country = 'EUROPE'""")
def analyst_volume(spark, sf_dir):
    """Live now and a window before, new in the window, and the true number of employers, for one scope."""
    rows = ads(spark, sf_dir).where(archive.live_feeds() & (F.col("country") == "EUROPE"))
    return rows.agg(F.count_if(archive.live_on(AS_OF)).alias("live_now"), F.count_if(archive.live_on(_back(7))).alias("live_then"), count_between("first_seen", _back(6), AS_OF).alias("new_in_window"), F.countDistinct(F.when(archive.live_on(AS_OF), F.col("company_id"))).alias("employers"))


@query(f"{LIVE} SELECT quantile_cont(salary, 0.25) AS p25, quantile_cont(salary, 0.5) AS p50, quantile_cont(salary, 0.75) AS p75, count(*) AS n, mode_country FROM live, (SELECT country AS mode_country FROM live WHERE list_contains(skills, 'blue') GROUP BY country ORDER BY count(*) DESC, country LIMIT 1) WHERE list_contains(skills, 'blue') AND country = mode_country GROUP BY mode_country")
def pay_for_skill(spark, sf_dir):
    """Pay of one skill in its most frequent market; ties go to the first by name."""
    rows = _live(spark, sf_dir).where(F.array_contains("skills", "blue"))
    per = rows.groupBy("country").agg(stats.quartiles(F.col("salary")).alias("q"), F.count(F.lit(1)).alias("n"))
    top = per.orderBy(F.desc("n"), "country").limit(1)
    return top.select(*[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "n", F.col("country").alias("mode_country"))


@query(f"{LIVE} SELECT source, quantile_disc(last_seen - first_seen, 0.5) AS lower_m, count(*) AS n FROM live GROUP BY source")
def lower_median(spark, sf_dir):
    return _live(spark, sf_dir).withColumn("d", F.datediff("last_seen", "first_seen")).groupBy("source").agg(stats.lower_median("d").alias("lower_m"), F.count(F.lit(1)).alias("n"))


@query(f"{LIVE} SELECT source, list_sort(list(last_seen - first_seen))[count(*) // 2 + 1] AS upper_m FROM live GROUP BY source")
def upper_median(spark, sf_dir):
    return _live(spark, sf_dir).withColumn("d", F.datediff("last_seen", "first_seen")).groupBy("source").agg(stats.upper_median("d").alias("upper_m"))


@query(f"""WITH {ADS}, r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', first_seen) ORDER BY job_key) AS nth FROM ads) SELECT job_key, first_seen FROM r ORDER BY nth, date_trunc('month', first_seen), job_key LIMIT 200""", days="first_seen")
def stratified_sample(spark, sf_dir):
    """Two hundred advertisements taken in turn from every calendar month."""
    return archive.stratified_sample(ads(spark, sf_dir), 200, F.trunc("first_seen", "month"), "job_key").select("job_key", "first_seen")


_SPLIT = f"""WITH {ADS}, old AS (SELECT job_key, title, CASE WHEN company_id % 2 = 0 THEN hub END AS salary, first_seen, last_seen, 1 AS seen_count FROM ads WHERE first_seen <= DATE '2001-07-15'),
news AS (SELECT job_key, title, country AS salary FROM ads WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31')"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ads(spark, sf_dir)
    old = rows.where(F.col("first_seen") <= F.lit(_back(16))).select("job_key", "title", F.when(F.col("company_id") % 2 == 0, F.col("hub")).alias("salary"), "first_seen", "last_seen", F.lit(1).alias("seen_count"))
    news = rows.where(archive.live_on(AS_OF)).select("job_key", "title", F.col("country").alias("salary"), F.lit(0).alias("ordinal"))
    return old, news


@query(f"""{_SPLIT} SELECT coalesce(o.job_key, n.job_key) AS job_key, coalesce(o.title, n.title) AS title, coalesce(nullif(o.salary, ''), n.salary) AS salary, coalesce(o.first_seen, DATE '2001-07-31') AS first_seen,
  CASE WHEN n.job_key IS NOT NULL THEN DATE '2001-07-31' ELSE o.last_seen END AS last_seen, coalesce(o.seen_count, 0) + (n.job_key IS NOT NULL)::INT AS seen_count FROM old o FULL JOIN news n ON o.job_key = n.job_key""", days="first_seen last_seen")
def archive_upsert(spark, sf_dir):
    old, news = _split(spark, sf_dir)
    return archive.upsert(old, news, AS_OF)


@query(f"""WITH {ADS}, u AS (SELECT job_key, title, first_seen, last_seen, 1 AS seen_count FROM ads WHERE first_seen <= DATE '2001-07-15' UNION ALL SELECT job_key, title, first_seen - 3, last_seen - 1, 1 FROM ads WHERE last_seen >= DATE '2001-07-01')
SELECT job_key, any_value(title) AS title, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS seen_count FROM u GROUP BY job_key""", days="first_seen last_seen")
def historical_upsert(spark, sf_dir):
    rows = ads(spark, sf_dir).select("job_key", "title", "first_seen", "last_seen", F.lit(1).alias("seen_count"))
    captures = rows.where(F.col("last_seen") >= F.lit(_back(30))).withColumn("first_seen", F.date_sub("first_seen", 3)).withColumn("last_seen", F.date_sub("last_seen", 1))
    return archive.historical_upsert(rows.where(F.col("first_seen") <= F.lit(_back(16))), captures)


@query(f"""WITH {ADS}, p AS (SELECT source AS key, first_seen AS day, count(*) AS value FROM ads GROUP BY ALL), u AS (SELECT key, day, CASE WHEN day > DATE '2001-06-01' THEN value * 2 ELSE value END AS value FROM p)
SELECT key, day, value FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY day DESC) <= 365""", days="day")
def bounded_series(spark, sf_dir):
    """A daily series per source with late points replaced, its last 365 points kept."""
    p = ads(spark, sf_dir).groupBy(F.col("source").alias("key"), F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("value"))
    return archive.bounded_append(p, p.where("day > DATE '2001-06-01'").withColumn("value", F.col("value") * 2))


@query(f"""WITH {ADS}, s AS (SELECT * FROM ads WHERE last_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-27') SELECT company_id, job_key, last_seen FROM s QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY last_seen DESC, job_key) <= 80""", days="last_seen")
def aged_listings(spark, sf_dir):
    seen = ads(spark, sf_dir).where(F.col("last_seen") <= F.lit(AS_OF))
    return archive.aged_listings(seen, AS_OF).select("company_id", "job_key", "last_seen")
