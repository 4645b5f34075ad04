"""Is every feed still writing, at its usual volume, with its fields filled: findings with levels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Days a feed may be silent, days of history, days that count as recent, when a latest day's volume is
# critical or worth a warning, the least usual volume and days of history, and when a field counts as lost.
SILENT_DAYS, HISTORY_DAYS, RECENT_DAYS = 3, 21, 3
CRITICAL, WARN, LEAST_USUAL, LEAST_DAYS = 0.25, 0.55, 20, 5
LEAST_RECENT, LEAST_BASE, LEAST_RATE, LOST_RATIO = 15, 60, 0.10, 0.5


def feed_findings(rows: DataFrame, limits: DataFrame, as_of: date, fields: list[str], least_usual: float = LEAST_USUAL) -> DataFrame:
    """(source, level, finding, field): all that is wrong with each feed; a feed may have several findings.

    ``rows`` has source, last_seen and the fields; ``limits`` source, allowed_days (null: three),
    quiet (silence is expected, so it is only noted) and on_demand (silence isn't judged).
    A feed in ``limits`` without rows is critical.  Volume is the latest day's number
    against the median of the days before it within 21 days; a field is lost where the
    last three days fill it far more rarely than the days before.
    """
    known = limits.select("source", F.coalesce("allowed_days", F.lit(SILENT_DAYS)).alias("allowed"), F.coalesce("quiet", F.lit(False)).alias("quiet"), F.coalesce("on_demand", F.lit(False)).alias("on_demand"))
    recent = F.col("last_seen") >= F.date_sub(F.lit(as_of), RECENT_DAYS)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    counts = [F.count_if(recent).alias("recent_n"), F.count_if(~recent).alias("base_n"), F.max("last_seen").alias("last")]
    counts += [x for c in fields for x in (F.count_if(recent & filled(c)).alias(f"recent_{c}"), F.count_if(~recent & filled(c)).alias(f"base_{c}"))]
    per_feed = rows.groupBy("source").agg(*counts)
    daily = rows.where(F.col("last_seen") >= F.date_sub(F.lit(as_of), HISTORY_DAYS)).groupBy("source", "last_seen").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source")
    placed = daily.withColumn("i", F.row_number().over(by.orderBy(F.desc("last_seen"))))
    volume = placed.groupBy("source").agg(F.count(F.lit(1)).alias("days"), F.max(F.when(F.col("i") == 1, F.col("n"))).alias("n"), F.median(F.when(F.col("i") > 1, F.col("n"))).alias("usual"))
    wide = known.join(per_feed, "source", "full_outer").join(volume, "source", "left").withColumn("allowed", F.coalesce("allowed", F.lit(SILENT_DAYS)))
    age = F.datediff(F.lit(as_of), "last")
    found = lambda level, name, field="": F.struct(F.lit(level).alias("level"), F.lit(name).alias("finding"), F.lit(field).alias("field"))
    judged = (F.col("days") >= LEAST_DAYS) & (F.col("usual") >= least_usual)
    share = F.col("n") / F.col("usual")
    rules = [
        F.when(F.col("last").isNull(), found("CRITICAL", "NO ROWS")),
        F.when(~F.coalesce("on_demand", F.lit(False)), F.when((age > F.col("allowed")) & F.coalesce("quiet", F.lit(False)), found("NOTE", "QUIET")).when(age > F.col("allowed"), found("CRITICAL", "STALE")).when(age == F.col("allowed"), found("WARN", "STALE"))),
        F.when(judged, F.when(share < CRITICAL, found("CRITICAL", "VOLUME COLLAPSE")).when(share < WARN, found("WARN", "VOLUME DROP"))),
    ]
    for c in fields:
        now, before = F.col(f"recent_{c}") / F.nullif(F.col("recent_n"), F.lit(0)), F.col(f"base_{c}") / F.nullif(F.col("base_n"), F.lit(0))
        enough = (F.col("recent_n") >= LEAST_RECENT) & (F.col("base_n") >= LEAST_BASE) & (before >= LEAST_RATE) & (now < before * LOST_RATIO)
        rules.append(F.when(enough, F.when(now == 0, found("CRITICAL", "FIELD REGRESSION", c)).otherwise(found("WARN", "FIELD REGRESSION", c))))
    return wide.select("source", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("source", "f.level", "f.finding", "f.field")
