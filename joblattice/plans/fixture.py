"""The tables as the engine sees them: an archive of advertisements, a monthly cube, events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 7, 31)
EVENTS_AS_OF = date(2024, 1, 29)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order line as an advertisement: job_key, source, title, company, hub, country, category, skills, salary, first_seen, last_seen."""
    t = lambda name: table(spark, sf_dir, name)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by the data model
    # An order stands once, so a task's table of orders is its share of them; the lines, several times as many, need no sort.
    lines = t("lineitem").join(t("orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    wide = lines.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    wide = wide.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.col("o_orderdate").cast("date")
    return wide.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("job_key"),
        F.col("o_orderpriority").alias("source"),
        F.col("p_name").alias("title"),
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("hub"),
        F.col("r_name").alias("country"),
        F.col("p_type").alias("category"),
        F.split("p_name", " ").alias("skills"),
        F.col("l_extendedprice").alias("salary"),
        first.alias("first_seen"),
        F.date_add(first, F.col("l_quantity").cast("int")).alias("last_seen"),
    )


ADS = """ads AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS job_key, o_orderpriority AS source, p_name AS title,
    c_custkey AS company_id, c_name AS company, n_name AS hub, r_name AS country, p_type AS category, string_split(p_name, ' ') AS skills,
    l_extendedprice AS salary, CAST(o_orderdate AS DATE) AS first_seen, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) AS last_seen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
LIVE = f"WITH {ADS}, live AS (SELECT * FROM ads WHERE first_seen <= DATE '2001-07-31' AND last_seen >= DATE '2001-07-31')"
SKILLS = f"WITH {ADS}, ex AS (SELECT * EXCLUDE skills, unnest(list_distinct(skills)) AS skill FROM ads)"


def exploded(rows: DataFrame) -> DataFrame:
    """A row per advertisement and skill, each skill once."""
    return rows.withColumn("skill", F.explode(F.array_distinct("skills"))).drop("skills")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly demand by skill and place: (skill, place, month, v), measured months only."""
    rows = ads(spark, sf_dir)
    return rows.groupBy(F.col("category").alias("skill"), F.col("hub").alias("place"), F.trunc("first_seen", "month").alias("month")).agg(F.count(F.lit(1)).alias("v"))


CUBE = f"{ADS}, cube AS (SELECT category AS skill, hub AS place, CAST(date_trunc('month', first_seen) AS DATE) AS month, count(*) AS v FROM ads GROUP BY ALL)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube over all places."""
    return cube(spark, sf_dir).groupBy("skill", "month").agg(F.sum("v").alias("v"))


MONTHLY = CUBE + ", monthly AS (SELECT skill, month, sum(v)::BIGINT AS v FROM cube GROUP BY ALL)"


def employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly employment stock by skill: (skill, quarter, employed)."""
    rows = ads(spark, sf_dir)
    return rows.groupBy(F.col("category").alias("skill"), F.trunc("last_seen", "quarter").alias("quarter")).agg((F.count(F.lit(1)) * 40).alias("employed"))


EMPLOYMENT = "employment AS (SELECT category AS skill, CAST(date_trunc('quarter', last_seen) AS DATE) AS quarter, count(*) * 40 AS employed FROM ads GROUP BY ALL)"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: user_key, name, at, day, ms."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("user_key"), F.col("event_type").alias("name"), at.alias("at"), F.to_date("ts").alias("day"), F.col("value").alias("ms"), "event_id")


ACTIVITY = "act AS (SELECT user_id AS user_key, event_type AS name, ts AS at, CAST(ts AS DATE) AS day, value AS ms, event_id FROM events)"
