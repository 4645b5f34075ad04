"""Findings about the feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health
from .fixture import ADS, AS_OF, ads
from .registry import query

_ENDS = {"1-URGENT": 5, "2-HIGH": 3, "3-MEDIUM": 6}
_CASE = " ".join(f"WHEN '{s}' THEN {n}" for s, n in _ENDS.items())


@query(f"""WITH {ADS}, r AS (SELECT source, last_seen, CASE WHEN source = '5-LOW' AND last_seen >= DATE '2001-07-28' AND company_id % 4 > 0 THEN '' ELSE 'x' END AS salary, CASE WHEN source = '4-NOT SPECIFIED' AND last_seen >= DATE '2001-07-28' THEN NULL WHEN company_id % 2 = 0 THEN 'u' END AS url
  FROM ads WHERE last_seen <= DATE '2001-07-31' - CASE source {_CASE} ELSE 0 END AND NOT (source = '5-LOW' AND last_seen = DATE '2001-07-31' AND company_id % 6 > 0)),
lim(source, allowed, quiet, on_demand) AS (VALUES ('1-URGENT', NULL, false, false), ('2-HIGH', NULL, false, false), ('3-MEDIUM', 4, true, false), ('gone', 9, false, false)),
f AS (SELECT source, max(last_seen) AS last, count(*) FILTER (last_seen >= DATE '2001-07-28') AS rn, count(*) FILTER (last_seen < DATE '2001-07-28') AS bn,
  count(*) FILTER (last_seen >= DATE '2001-07-28' AND salary <> '') AS rs, count(*) FILTER (last_seen < DATE '2001-07-28' AND salary <> '') AS bs, count(*) FILTER (last_seen >= DATE '2001-07-28' AND url <> '') AS ru, count(*) FILTER (last_seen < DATE '2001-07-28' AND url <> '') AS bu FROM r GROUP BY source),
d AS (SELECT source, last_seen, count(*) AS n FROM r WHERE last_seen >= DATE '2001-07-10' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_seen DESC) AS i FROM d),
v AS (SELECT source, count(*) AS days, max(n) FILTER (i = 1) AS n, median(n) FILTER (i > 1) AS usual FROM p GROUP BY source),
w AS (SELECT *, DATE '2001-07-31' - last AS age, coalesce(allowed, 3) AS lim FROM lim FULL JOIN f USING (source) LEFT JOIN v USING (source))
SELECT source, 'CRITICAL' AS level, 'NO ROWS' AS finding, '' AS field FROM w WHERE last IS NULL
UNION ALL SELECT source, CASE WHEN age = lim THEN 'WARN' WHEN coalesce(quiet, false) THEN 'NOTE' ELSE 'CRITICAL' END, CASE WHEN age > lim AND coalesce(quiet, false) THEN 'QUIET' ELSE 'STALE' END, '' FROM w WHERE age >= lim AND NOT coalesce(on_demand, false)
UNION ALL SELECT source, CASE WHEN n / usual < 0.25 THEN 'CRITICAL' ELSE 'WARN' END, CASE WHEN n / usual < 0.25 THEN 'VOLUME COLLAPSE' ELSE 'VOLUME DROP' END, '' FROM w WHERE days >= 5 AND usual >= 2 AND n / usual < 0.55
UNION ALL SELECT source, CASE WHEN rs = 0 THEN 'CRITICAL' ELSE 'WARN' END, 'FIELD REGRESSION', 'salary' FROM w WHERE rn >= 15 AND bn >= 60 AND bs / bn >= 0.1 AND rs / rn < bs / bn * 0.5
UNION ALL SELECT source, CASE WHEN ru = 0 THEN 'CRITICAL' ELSE 'WARN' END, 'FIELD REGRESSION', 'url' FROM w WHERE rn >= 15 AND bn >= 60 AND bu / bn >= 0.1 AND ru / rn < bu / bn * 0.5""")
def feed_findings(spark, sf_dir):
    """Every finding about every feed, by limits of its own: silence, volume and lost fields."""
    end = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in _ENDS.items()], F.lit(0))
    late = F.col("last_seen") >= F.date_sub(F.lit(AS_OF), 3)
    rows = ads(spark, sf_dir).where((F.col("last_seen") <= F.date_sub(F.lit(AS_OF), end)) & ~((F.col("source") == "5-LOW") & (F.col("last_seen") == F.lit(AS_OF)) & (F.col("company_id") % 6 > 0)))
    salary = F.when((F.col("source") == "5-LOW") & late & (F.col("company_id") % 4 > 0), "").otherwise("x")
    url = F.when((F.col("source") == "4-NOT SPECIFIED") & late, None).when(F.col("company_id") % 2 == 0, "u")
    limits = spark.createDataFrame([("1-URGENT", None, False, False), ("2-HIGH", None, False, False), ("3-MEDIUM", 4, True, False), ("gone", 9, False, False)], "source string, allowed_days int, quiet boolean, on_demand boolean")
    return health.feed_findings(rows.select("source", "last_seen", salary.alias("salary"), url.alias("url")), limits, AS_OF, ["salary", "url"], least_usual=2)
