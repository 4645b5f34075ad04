"""Drill-downs of employers and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import archive, drill, stats
from .fixture import ADS, AS_OF, ads, table
from .registry import query

_WEEKS = ", ".join(f"count(*) FILTER (first_seen <= DATE '2001-07-31' - {7 * i} AND last_seen >= DATE '2001-07-31' - {7 * i + 6})" for i in range(12, -1, -1))


@query(f"""WITH {ADS}, c AS (SELECT company_id, skill, count(*) FILTER (last_seen >= DATE '2001-07-31' - 30) AS now_n, count(*) FILTER (first_seen <= DATE '2001-07-31' - 30 AND last_seen >= DATE '2001-07-31' - 60) AS prev_n, [{_WEEKS}] AS series
  FROM (SELECT * EXCLUDE skills, unnest(list_distinct(skills)) AS skill FROM ads WHERE last_seen >= DATE '2001-01-01') GROUP BY ALL)
SELECT *, now_n - prev_n AS delta, CASE WHEN prev_n > 0 THEN floor(100.0 * (now_n - prev_n) / prev_n + 0.5) ELSE 100 END::BIGINT AS pct, CASE WHEN now_n > prev_n THEN 'up' ELSE 'down' END AS dir,
  row_number() OVER (PARTITION BY company_id ORDER BY abs(now_n - prev_n) DESC, now_n - prev_n DESC, skill) AS place FROM c WHERE now_n <> prev_n QUALIFY place <= 8""")
def employer_skill_movers(spark, sf_dir):
    """Each employer's skills that moved most in 30 days, with 13 weeks of each."""
    return drill.employer_movers(ads(spark, sf_dir).where(archive.live_feeds() & (F.col("last_seen") >= F.lit("2001-01-01").cast("date"))), AS_OF)


_COMPANIES = "c AS (SELECT c_custkey AS id, c_nationkey AS country, CASE WHEN c_custkey % 9 = 0 THEN 'own ' || c_custkey ELSE c_mktsegment END AS sector, c_custkey % 2 AS grp, row_number() OVER (ORDER BY c_acctbal, c_custkey) * 3 + c_custkey % 2 AS headcount FROM customer)"


@query(f"""WITH {_COMPANIES}, s AS (SELECT a.id, b.id AS peer, 'sector' AS tier, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.headcount - b.headcount), b.id) AS place FROM c a JOIN c b ON a.country = b.country AND a.sector = b.sector AND a.id <> b.id),
g AS (SELECT a.id, b.id AS peer, 'group' AS tier, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.headcount - b.headcount), b.id) AS place FROM c a JOIN c b ON a.country = b.country AND a.grp = b.grp AND a.id <> b.id WHERE a.id NOT IN (SELECT id FROM s))
SELECT id, place, peer, tier FROM s WHERE place <= 4 UNION ALL SELECT id, place, peer, tier FROM g WHERE place <= 4""")
def peers_with_fallback(spark, sf_dir):
    """The four nearest in size of the same country and sector, else of the same country and group."""
    customers = stats.placed(table(spark, sf_dir, "customer"), F.floor("c_acctbal"), "c_acctbal", "c_custkey")  # distinct sizes; balances lie between -1,000 and 10,000
    sector = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("own "), "c_custkey")).otherwise(F.col("c_mktsegment"))
    companies = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country"), sector.alias("sector"), (F.col("c_custkey") % 2).alias("grp"), (F.col("nth") * 3 + F.col("c_custkey") % 2).alias("headcount"))
    return drill.peers(companies)


@query(f"""WITH {ADS}, closed AS (SELECT *, last_seen - first_seen AS d FROM ads WHERE last_seen < DATE '2001-07-31' AND length(title) % 3 > 0 ORDER BY last_seen DESC, job_key LIMIT 8000),
w AS (SELECT floor(median(d) + 0.5)::BIGINT AS days, count(*) AS n FROM closed HAVING count(*) >= 40),
s AS (SELECT skill, floor(median(d) + 0.5)::BIGINT AS days, count(*) AS n FROM (SELECT d, unnest(list_distinct(skills)) AS skill FROM closed) GROUP BY skill HAVING count(*) >= 8)
SELECT skill, s.days, s.n, row_number() OVER (ORDER BY s.days DESC, skill) AS place FROM s, w UNION ALL SELECT NULL, days, n, 0 FROM w""")
def ad_durations(spark, sf_dir):
    """Median days advertised of the newest 8,000 closed advertisements with a posting day, by skill and in all."""
    since = F.when(F.length("title") % 3 > 0, F.datediff("last_seen", "first_seen"))
    return drill.ad_durations(ads(spark, sf_dir).where(archive.live_feeds()).withColumn("days_since_posted", since), AS_OF)


@query(f"""WITH {ADS}, live AS (SELECT country AS scope, trunc(salary)::BIGINT AS s, length(title) % 3 AS k FROM ads WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31'),
p AS (SELECT scope, CASE WHEN k = 0 AND s >= 20000 THEN 'AUD' WHEN k = 1 THEN 'SGD' END AS currency, CASE WHEN k = 0 AND s >= 20000 THEN s WHEN k = 1 THEN CASE WHEN s < 30000 THEN s * 12 ELSE s END END::DOUBLE AS annual FROM live),
c AS (SELECT scope, currency, count(*) AS n, quantile_cont(annual, [0.25, 0.5, 0.75]) AS q FROM p WHERE currency IS NOT NULL GROUP BY scope, currency QUALIFY row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, currency) = 1)
SELECT scope, currency, n, live, floor(100.0 * n / live + 0.5)::BIGINT AS share, q[1] AS p25, q[2] AS p50, q[3] AS p75 FROM c JOIN (SELECT scope, count(*) AS live FROM live GROUP BY scope) USING (scope) WHERE n >= 20""")
def scope_pay(spark, sf_dir):
    """Quartiles of pay by country in its dominant currency, where twenty advertisements state one."""
    live = ads(spark, sf_dir).where(archive.live_feeds() & archive.live_on(AS_OF))
    whole = F.col("salary").cast("long").cast("string")
    text = F.get(F.array(F.concat(F.lit("$"), whole, F.lit(" a year")), F.concat(F.lit("S$"), whole), F.lit("competitive")), F.length("title") % 3)
    return drill.scope_pay(live.select(F.col("country").alias("scope"), money.parsed_pay(text, F.lit("AUD")).alias("pay")))
