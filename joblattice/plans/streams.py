"""Queries over streams, run to the end of what is there, and over what streams take in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cutting import new_folder
from ..streaming import ingest
from .fixture import table
from .registry import query

_NAMES = ["click", "view", "purchase"]


@query(f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY event_id) AS nth FROM events)
SELECT CASE WHEN user_id % 5 = 0 THEN '' ELSE 'u' || (user_id % 5) END AS user_key, CASE WHEN user_id % 5 = 0 THEN 'device ' || (event_id % 7) ELSE '' END AS anon_key, event_type AS name, trim(props) AS detail, d AS day,
  CASE WHEN event_type = 'session_end' THEN 1 ELSE 0 END AS ms, (nth - 1)::INT AS nth FROM e WHERE nth <= 40 AND event_type IN ('{"', '".join(_NAMES)}')""", days="day")
def accepted_events(spark, sf_dir):
    """Events as requests bring them in, one request per fifth of the users and day: forty of each are read."""
    e = table(spark, sf_dir, "events")
    spaced = F.concat(F.lit("device \n "), (F.col("event_id") % 7).cast("string"))
    event = F.struct("event_id", F.col("event_type").alias("name"), F.concat(F.lit(" "), "props", F.lit("\n")).alias("detail"), spaced.alias("anon_key"), F.lit(None).cast("string").alias("session_id"), F.col("value").alias("ms"))
    user = F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")))
    requests = e.groupBy(user.alias("user_key"), F.to_date("ts").alias("day")).agg(F.max("ts").alias("received"), F.sort_array(F.collect_list(event)).alias("events"))
    return ingest.accepted_events(requests, _NAMES).select("user_key", "anon_key", "name", "detail", "day", "ms", "nth")


_WEEKS = "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS events, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1"


@query(_WEEKS, days="week")
def weekly_users(spark, sf_dir):
    """Events and distinct users by week."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("user_key"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("at"))
    return ingest.weekly_users(rows, _NAMES)


@query(f"SELECT * FROM ({_WEEKS}) WHERE week + INTERVAL 14 DAY <= (SELECT max(ts) FROM events WHERE event_type IN ('click', 'view', 'purchase'))", days="week")
def weekly_users_stream(spark, sf_dir):
    """The same from a stream: the weeks that its watermark has passed."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the table may be one file
    rows = stream.select(F.col("user_id").alias("user_key"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("at"))
    out = new_folder(spark, "weeks")
    weeks = ingest.weekly_users(rows, _NAMES)
    writer = weeks.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "stream"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(weeks.schema).parquet(out)
