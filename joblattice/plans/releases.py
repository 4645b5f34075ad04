"""The dataset builders on statistical releases; line items and parts stand for the releases' rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builders
from .fixture import table
from .registry import query

_TAXONOMY = [{"skill": "Bolts", "terms": ["bolt"]}, {"skill": "Widgets", "terms": ["widget"], "except": ["old widget"]}, {"skill": "Reds", "terms": ["red "]}]
_OVERRIDES = {"0007": ["Bolts", "Reds"]}
_MAPPED = "CASE WHEN {0} = '0007' THEN ['Bolts', 'Reds'] ELSE list_filter([CASE WHEN contains({1}, 'bolt') THEN 'Bolts' END, CASE WHEN contains({1}, 'widget') AND NOT contains({1}, 'old widget') THEN 'Widgets' END, CASE WHEN contains({1}, 'red ') THEN 'Reds' END], lambda x: x IS NOT NULL) END"

_SHIPPED = """s AS (SELECT p_type AS skill, substring(p_type, 1, 1) AS grp, p_name AS title, lpad(p_size::VARCHAR, 4, '0') AS code, p_size, l_returnflag AS state, l_linenumber, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS day,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, year(l_shipdate)::INT AS year FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'),
months AS (SELECT CAST(d AS DATE) AS month FROM range(DATE '1995-07-01', DATE '2001-01-01', INTERVAL 1 MONTH) AS r(d)),
members AS (SELECT p_type AS skill, substring(p_type, 1, 1) AS grp, count(*) AS weight FROM part GROUP BY ALL),
grps AS (SELECT grp, quarter, count(*)::DOUBLE AS value FROM s WHERE quarter <> DATE '1998-07-01' GROUP BY ALL)"""


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    day = F.to_date("l_shipdate")
    rows = wide.where(day.between(F.lit(date(1996, 1, 1)), F.lit(date(1999, 12, 31))))
    return rows.select(F.col("p_type").alias("skill"), F.substring("p_type", 1, 1).alias("grp"), F.col("p_name").alias("title"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("code"), "p_size", F.col("l_returnflag").alias("state"), "l_linenumber", F.col("l_quantity").alias("quantity"), day.alias("day"), F.trunc(day, "month").alias("month"), F.trunc(day, "quarter").alias("quarter"), F.year(day).alias("year"))


def _months(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr("sequence(DATE '1995-07-01', DATE '2000-12-01', interval 1 month)")).alias("month"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("skill"), F.substring("p_type", 1, 1).alias("grp")).agg(F.count(F.lit(1)).alias("weight"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly totals by group, one quarter unpublished."""
    return _shipped(spark, sf_dir).where(F.col("quarter") != F.lit(date(1998, 7, 1))).groupBy("grp", "quarter").agg(F.count(F.lit(1)).cast("double").alias("value"))


_AT = "held AS (SELECT g.grp, m.month, q.value FROM (SELECT DISTINCT grp FROM grps) g CROSS JOIN months m ASOF LEFT JOIN grps q ON g.grp = q.grp AND m.month >= q.quarter)"
_CITIES = [("toronto", 0.55), ("vancouver", 0.3)]


@query(f"""WITH {_SHIPPED}, {_AT}, sh AS (SELECT skill, grp, greatest(weight, 1) / sum(greatest(weight, 1)) OVER (PARTITION BY grp) AS share FROM members), n AS (SELECT skill, month, floor(coalesce(value, 0) * share + 0.5) AS n FROM held JOIN sh USING (grp))
SELECT skill, city, month, floor(n * w + 0.5)::BIGINT AS v FROM n CROSS JOIN (VALUES ('toronto', 0.55::DOUBLE), ('vancouver', 0.3::DOUBLE)) AS c(city, w)""", days="month")
def group_totals_to_cities(spark, sf_dir):
    """Group totals of a quarter to skills and then to cities, rounded at both steps."""
    cities = spark.createDataFrame(_CITIES, "city string, w double")
    return builders.shared_out(_groups(spark, sf_dir), _members(spark, sf_dir), _months(spark), cities)


@query(f"""WITH {_SHIPPED}, {_AT}, b AS (SELECT grp, value AS base FROM held WHERE month = DATE '1999-06-01'), n AS (SELECT skill, grp, 11000.0::DOUBLE * greatest(weight, 1) / sum(greatest(weight, 1)) OVER () AS cur FROM members)
SELECT skill, month, coalesce(floor(cur * value / coalesce(base, 100) + 0.5), 0)::BIGINT AS v FROM held LEFT JOIN b USING (grp) JOIN n USING (grp)""", days="month")
def index_on_level(spark, sf_dir):
    """A level at one month moved by each group's index."""
    return builders.indexed(_groups(spark, sf_dir), _members(spark, sf_dir), _months(spark), F.lit(date(1999, 6, 1)), 11_000.0)


@query(f"""WITH {_SHIPPED}, {_AT} SELECT skill, month, value AS v FROM held JOIN (SELECT DISTINCT skill, grp FROM members) USING (grp) WHERE value IS NOT NULL""", days="month")
def section_inherited(spark, sf_dir):
    """Every skill of a section with the section's own quarterly figure."""
    ends = _groups(spark, sf_dir).select("grp", F.add_months("quarter", 2).alias("quarter_end"), "value")
    return builders.inherited(ends, _members(spark, sf_dir), _months(spark))


@query(f"""WITH {_SHIPPED}, a AS (SELECT skill, state AS geo, year, floor(count(*) / 7000.0 * 1000 + 0.5)::BIGINT AS n FROM s WHERE year <> 1998 GROUP BY ALL HAVING floor(count(*) / 7000.0 * 1000 + 0.5) > 0)
SELECT k.skill, k.geo, m.month, a.n AS v FROM (SELECT DISTINCT skill, geo FROM a) k CROSS JOIN months m ASOF JOIN a ON k.skill = a.skill AND k.geo = a.geo AND m.month >= make_date(a.year, 1, 1)""", days="month")
def annual_held_flat(spark, sf_dir):
    """Annual figures held over their months, and over a year that is missing."""
    yearly = _shipped(spark, sf_dir).where("year <> 1998").groupBy("skill", F.col("state").alias("geo"), "year").agg((F.count(F.lit(1)) / 7000.0).alias("thousands"))
    return builders.held_flat(yearly, _months(spark))


@query(f"""WITH {_SHIPPED}, e AS (SELECT skill, year, count(*) * 1000.0::DOUBLE AS employed FROM s WHERE year <> 1998 GROUP BY ALL), r AS (SELECT month, least(count(*) / 5000.0::DOUBLE, 0.9) AS rate FROM s WHERE month(month) % 3 = 2 GROUP BY month),
st AS (SELECT k.skill, m.month, e.employed FROM (SELECT DISTINCT skill FROM e) k CROSS JOIN months m ASOF LEFT JOIN e ON k.skill = e.skill AND m.month >= make_date(e.year, 1, 1)), rt AS (SELECT m.month, r.rate FROM months m ASOF LEFT JOIN r ON m.month >= r.month)
SELECT skill, month, floor(employed * rate / (1 - rate) + 0.5)::BIGINT AS v FROM st JOIN rt USING (month)""", days="month")
def openings_from_employment(spark, sf_dir):
    """Employment of the latest year times the openings rate in force; null before either."""
    s = _shipped(spark, sf_dir)
    employed = s.where("year <> 1998").groupBy("skill", "year").agg((F.count(F.lit(1)) * 1000.0).alias("employed"))
    rates = s.where("month(month) % 3 = 2").groupBy("month").agg(F.least(F.count(F.lit(1)) / 5000.0, F.lit(0.9)).alias("rate"))
    return builders.openings_by_skill(employed, rates, _months(spark))


@query(f"""WITH {_SHIPPED}, x AS (SELECT unnest({_MAPPED.format("code", "title")}) AS skill, CASE WHEN state = 'R' THEN 'national' ELSE state END AS state, month, quantity FROM s)
SELECT skill, state, month, floor(sum(quantity) + 0.5)::BIGINT AS v FROM x GROUP BY ALL""", days="month")
def occupation_counts(spark, sf_dir):
    """Occupation rows to skills, by hand-made codes first, in full to each skill."""
    rows = _shipped(spark, sf_dir).withColumnRenamed("quantity", "value")
    return builders.counted_by_skill(rows, _TAXONOMY, _OVERRIDES, national="R")


@query(f"""WITH {_SHIPPED}, o AS (SELECT CASE WHEN p_size % 5 = 0 THEN code || ' ' || title || ' nfd' WHEN p_size % 11 = 0 THEN title ELSE code || ' ' || title END AS occupation, state, quarter, CASE WHEN l_linenumber <> 3 THEN quantity END AS thousands FROM s),
p AS (SELECT regexp_extract(occupation, '^([0-9]{{4}}) (.*)$', 1) AS code, regexp_extract(occupation, '^([0-9]{{4}}) (.*)$', 2) AS title, state, quarter, coalesce(thousands, 0) * 1000 AS persons FROM o),
x AS (SELECT unnest({_MAPPED.format("code", "title")}) AS skill, state, quarter, persons FROM p WHERE code <> '' AND NOT ends_with(lower(title), 'nfd')), b AS (SELECT skill, state, quarter, floor(sum(persons) + 0.5)::BIGINT AS persons FROM x GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT skill, 'national', quarter, sum(persons)::BIGINT FROM b GROUP BY skill, quarter""", days="quarter")
def employment_stock(spark, sf_dir):
    """Employment by skill and state; titles not further defined belong to no skill; the nation is the states' sum."""
    named = F.concat_ws(" ", "code", "title")
    occupation = F.when(F.col("p_size") % 5 == 0, F.concat(named, F.lit(" nfd"))).when(F.col("p_size") % 11 == 0, F.col("title")).otherwise(named)
    rows = _shipped(spark, sf_dir).select(occupation.alias("occupation"), "state", "quarter", F.when(F.col("l_linenumber") != 3, F.col("quantity")).alias("thousands"))
    return builders.stock_by_skill(rows, _TAXONOMY, _OVERRIDES)


@query(f"""WITH {_SHIPPED}, y AS (SELECT grp, year, CASE WHEN year <> 1997 THEN n END AS persons FROM (SELECT grp, year, count(*) AS n FROM s GROUP BY ALL)) SELECT skill, year, persons FROM members JOIN y USING (grp)""")
def group_employment(spark, sf_dir):
    """Each skill with its group's employment; the unmeasured year stays null."""
    yearly = _shipped(spark, sf_dir).groupBy("grp", "year").agg(F.count(F.lit(1)).alias("n")).select("grp", "year", F.when(F.col("year") != 1997, F.col("n")).alias("persons"))
    return builders.by_group(yearly, _members(spark, sf_dir).select("skill", "grp"))


@query("SELECT c_name AS currency, floor(1 / c_acctbal * 1000000 + 0.5) / 1000000 AS to_home FROM customer WHERE c_acctbal > 0")
def exchange_rates(spark, sf_dir):
    return builders.inverted_rates(table(spark, sf_dir, "customer").select(F.col("c_name").alias("currency"), F.col("c_acctbal").alias("per_home")))


@query("""WITH d AS (SELECT o_orderstatus AS listing, CAST(o_orderdate AS DATE) AS day, max(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END) AS close FROM orders GROUP BY ALL)
SELECT listing, CAST(date_trunc('month', day) AS DATE) AS month, arg_max(close, day) AS close FROM d WHERE close IS NOT NULL GROUP BY ALL""", days="month")
def monthly_close(spark, sf_dir):
    """The last close of each month that isn't null."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("listing"), F.to_date("o_orderdate").alias("day")).agg(F.max(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))).alias("close"))
    return builders.monthly_close(daily)
