"""The priced market over a window that the feeds allow, and the ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive, priced
from .fixture import ADS, AS_OF, ads
from .registry import query

_LATE = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive with three of five feeds that began on 9 July."""
    late = F.col("source").isin(_LATE) & (F.col("first_seen") < F.lit("2001-07-09").cast("date"))
    return ads(spark, sf_dir).where(archive.live_feeds() & ~late)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's skills; lists of them repeat, so each is spread once."""
    return ads(spark, sf_dir).select("skills").distinct().select(F.explode("skills").alias("skill")).distinct()


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    names = _names(spark, sf_dir).where("skill <> 'gizmo'")
    return priced.priced_skills(rows, AS_OF, names.withColumn("category", F.upper(F.substring("skill", 1, 1))))


_BASE = f"""WITH {ADS}, rows AS (SELECT * REPLACE (list_filter(list_distinct(skills), lambda s: s <> 'gizmo') AS skills) FROM ads WHERE NOT (source IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND first_seen < DATE '2001-07-09')),
own AS (SELECT * FROM rows WHERE len(skills) > 0),
feeds AS (SELECT source, min(first_seen) AS mn, count(*) AS n FROM own GROUP BY source),
span AS (SELECT max(w) AS w FROM (SELECT w, sum(CASE WHEN mn <= DATE '2001-07-31' - (w - 1)::INT THEN n ELSE 0 END) / sum(n) AS share FROM feeds, range(5, 31) AS r(w) GROUP BY w) WHERE share >= 0.5),
inside AS (SELECT own.*, DATE '2001-07-31' - (w - 1)::INT AS start FROM own, span WHERE last_seen >= DATE '2001-07-31' - (w - 1)::INT AND first_seen <= DATE '2001-07-31'),
infeeds AS (SELECT mn, sum(n) AS n FROM (SELECT source, min(first_seen) AS mn, count(*) AS n FROM inside GROUP BY source) GROUP BY mn),
whole AS (SELECT min(mn) AS d FROM (SELECT mn, sum(n) OVER (ORDER BY mn) AS run, sum(n) OVER () AS total FROM infeeds) WHERE run >= 0.95 * total),
cut AS (SELECT inside.*, least(DATE '2001-07-31', greatest(start, d)) AS b FROM inside, whole),
days AS (SELECT DISTINCT b, CAST(unnest(generate_series(b, DATE '2001-07-31', INTERVAL 1 DAY)) AS DATE) AS day FROM cut),
ex AS (SELECT *, unnest(skills) AS skill FROM cut),
line AS (SELECT skill, days.day, count(*) FILTER (first_seen <= days.day AND last_seen >= days.day) AS n FROM ex, days GROUP BY skill, days.day),
lines AS (SELECT skill, list(n ORDER BY day) AS line, len(list(n)) // 2 AS h FROM line GROUP BY skill),
now AS (SELECT * FROM (SELECT *, unnest(skills) AS skill FROM own) WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31'),
level AS (SELECT skill, count(*) AS now_n FROM now GROUP BY skill),
price AS (SELECT skill, floor(median(m) + 0.5)::BIGINT AS pay, count(m) AS pay_markets FROM (SELECT skill, country, CASE WHEN count(salary) >= 8 THEN floor(median(salary) + 0.5) END AS m FROM now GROUP BY ALL) GROUP BY skill),
calc AS (SELECT skill, upper(skill[1]) AS category, now_n, line, pay, coalesce(pay_markets, 0) AS pay_markets, pay * now_n AS value,
  CASE WHEN list_max(line) >= 3 AND len(line) >= 5 AND list_sum(line[1:h]) > 0 THEN floor(1000.0 * (list_sum(line[len(line) - h + 1:]) / h::DOUBLE - list_sum(line[1:h]) / h::DOUBLE) / (list_sum(line[1:h]) / h::DOUBLE) + 0.5) / 10 END AS pct FROM level JOIN lines USING (skill) LEFT JOIN price USING (skill)),
market AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, now_n DESC, skill) AS place FROM calc)"""


@query(f"{_BASE} SELECT skill, category, now_n, pct, CASE WHEN coalesce(pct, 0) = 0 THEN 'flat' WHEN pct > 0 THEN 'up' ELSE 'down' END AS dir, pay, pay_markets, value, place, CASE WHEN len(line) >= 5 AND list_min(line) <> list_max(line) THEN line END AS spark FROM market")
def priced_market(spark, sf_dir):
    """Skills by value: price, volume, change over the window the feeds allow, and line."""
    return _market(spark, sf_dir).select("skill", "category", "now_n", "pct", "dir", "pay", "pay_markets", "value", "place", "spark")


@query(f"{_BASE} SELECT day, sum(n * pay)::BIGINT AS value FROM line JOIN market USING (skill) WHERE pay IS NOT NULL GROUP BY day", days="day")
def market_value_series(spark, sf_dir):
    """The market's value day by day, at today's prices."""
    return priced.value_series(_market(spark, sf_dir))


@query(f"""{_BASE}, v AS (SELECT category, day, sum(n * pay)::DOUBLE AS v FROM line JOIN market USING (skill) WHERE pay IS NOT NULL GROUP BY ALL),
vl AS (SELECT category, list(v ORDER BY day) AS line, len(list(v)) // 2 AS h FROM v GROUP BY category),
s AS (SELECT category, count(*) AS skills, count(pay) AS priced, sum(now_n)::BIGINT AS now_n, sum(value)::BIGINT AS value FROM market GROUP BY category)
SELECT category, skills, priced, now_n, value, CASE WHEN len(line) >= 5 AND list_sum(line[1:h]) > 0 THEN floor(1000.0 * (list_sum(line[len(line) - h + 1:]) / h - list_sum(line[1:h]) / h) / (list_sum(line[1:h]) / h) + 0.5) / 10 END AS pct FROM s LEFT JOIN vl USING (category)""")
def market_categories(spark, sf_dir):
    """Categories by value, with the change of their value over the window."""
    return priced.category_market(_market(spark, sf_dir))


@query(f"""WITH {ADS}, scanned AS (SELECT * FROM ads WHERE last_seen >= DATE '2001-07-31' - 60 AND NOT (source IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND first_seen < DATE '2001-07-09')),
new AS (SELECT first_seen AS d, count(*) AS n FROM scanned GROUP BY 1), mid AS (SELECT list(n ORDER BY n)[count(*) // 2 + 1] AS m FROM new),
start AS (SELECT min(d) AS began, (SELECT min(d) FROM new) AS oldest FROM new, mid WHERE n >= 0.1 * m),
ex AS (SELECT * EXCLUDE skills, unnest(list_distinct(skills)) AS skill FROM scanned), w(name, days) AS (VALUES ('24h', 1), ('7d', 7), ('30d', 30)),
c AS (SELECT name, skill, count(*) FILTER (last_seen >= DATE '2001-07-31' - days) AS now_n, count(*) FILTER (first_seen <= DATE '2001-07-31' - days AND last_seen >= DATE '2001-07-31' - 2 * days) AS prev_n FROM ex, w, start WHERE DATE '2001-07-31' - 2 * days >= began GROUP BY name, skill),
mv AS (SELECT name, skill, floor(10 * least(24.0, greatest(-16.0, CASE WHEN prev_n > 0 THEN (now_n - prev_n) / prev_n::DOUBLE * 100 ELSE 100.0 END)) + 0.5) / 10 AS v, abs(now_n - prev_n) AS sig FROM c WHERE now_n + prev_n >= 3 AND now_n <> prev_n),
picked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sig DESC, abs(v) DESC, skill) AS place FROM mv QUALIFY place <= 16),
per AS (SELECT name, count(*) AS k FROM picked GROUP BY name),
top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY now_n DESC, skill) AS nth FROM c WHERE now_n > 0 QUALIFY nth <= 16),
fill AS (SELECT name, skill, least(18, 2 + floor(now_n / 3.0 + 0.5))::DOUBLE AS v, now_n AS sig, coalesce(k, 0) + row_number() OVER (PARTITION BY name ORDER BY nth) AS place FROM top ANTI JOIN picked USING (name, skill) LEFT JOIN per USING (name) WHERE coalesce(k, 0) < 6),
shown AS (SELECT name, place, skill, v, sig, false AS filled FROM picked UNION ALL SELECT name, place, skill, v, sig, true FROM fill WHERE place <= 12),
pay AS (SELECT skill, floor(median(m) + 0.5)::BIGINT AS pay FROM (SELECT skill, country, CASE WHEN count(salary) >= 8 THEN floor(median(salary) + 0.5) END AS m FROM ex WHERE last_seen >= DATE '2001-07-30' GROUP BY ALL) GROUP BY skill),
dd AS (SELECT CAST(unnest(generate_series(greatest(oldest, DATE '2001-07-02'), DATE '2001-07-31', INTERVAL 1 DAY)) AS DATE) AS day FROM start),
line AS (SELECT skill, dd.day, count(*) FILTER (first_seen <= dd.day AND last_seen >= dd.day) AS n FROM ex, dd GROUP BY ALL),
lines AS (SELECT skill, list(n ORDER BY day) AS line FROM line GROUP BY skill)
SELECT name AS "window", place, skill, v, sig, filled, pay, CASE WHEN len(line) >= 5 AND list_min(line) <> list_max(line) THEN line END AS spark FROM shown LEFT JOIN pay USING (skill) LEFT JOIN lines USING (skill)""")
def priced_ticker(spark, sf_dir):
    """Movers of a day, a week and a month with price and line, filled up where few move."""
    rows = _rows(spark, sf_dir)
    return priced.ticker(rows, AS_OF, _names(spark, sf_dir))
