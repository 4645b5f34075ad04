"""Use of the product: weekly signals, cohorts, windows, sessions, views, votes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.dates import week_start
from ..functions.money import half_up
from ..operators import stats
from .fixture import ACTIVITY, EVENTS_AS_OF, activity, table
from .registry import query

_WEEKS = f"WITH {ACTIVITY}, wk AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week FROM act)"


@query(f"""{_WEEKS} SELECT CAST(w AS DATE) AS week, count(DISTINCT user_key) AS users, count(DISTINCT user_key) FILTER (name = 'purchase') AS buyers, count(DISTINCT (user_key, day)) FILTER (user_key IS NOT NULL) AS user_days, count(*) FILTER (name = 'view') AS views
FROM range(DATE '2023-12-11', DATE '2024-02-05', INTERVAL 7 DAY) AS r(w) LEFT JOIN wk ON week = CAST(w AS DATE) GROUP BY w""", days="week")
def weekly_leading(spark, sf_dir):
    """Eight Monday weeks of distinct users, buyers and user days; a week without events is shown empty."""
    last = EVENTS_AS_OF - timedelta(days=EVENTS_AS_OF.weekday())
    weeks = spark.range(8).select(F.date_sub(F.lit(last), (7 * F.col("id")).cast("int")).alias("week"))
    a = activity(spark, sf_dir).withColumn("week", week_start(F.col("day")))
    g = a.groupBy("week").agg(F.countDistinct("user_key").alias("users"), F.countDistinct(F.when(F.col("name") == "purchase", F.col("user_key"))).alias("buyers"), F.countDistinct("user_key", "day").alias("user_days"), F.count_if(F.col("name") == "view").alias("views"))
    return weeks.join(g, "week", "left").select("week", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("users", "buyers", "user_days", "views")])


@query(f"""{_WEEKS}, s AS (SELECT user_key, min(week) AS cohort FROM wk GROUP BY user_key), c AS (SELECT cohort, count(*) AS size FROM s GROUP BY cohort),
k AS (SELECT cohort, (week - cohort) // 7 AS n, count(DISTINCT user_key) AS users FROM wk JOIN s USING (user_key) GROUP BY ALL)
SELECT cohort, size, {", ".join(f"CASE WHEN cohort + {7 * i} <= DATE '2024-01-29' THEN coalesce(max(users) FILTER (n = {i}), 0) END AS w{i}" for i in range(1, 6))}
FROM c LEFT JOIN k USING (cohort) GROUP BY cohort, size ORDER BY cohort DESC LIMIT 6""", days="cohort")
def cohort_retention(spark, sf_dir):
    """Users of each signup week who came back in its weeks 1 to 5; weeks still to come are null, not zero."""
    a = activity(spark, sf_dir).withColumn("week", week_start(F.col("day")))
    joined = a.join(a.groupBy("user_key").agg(F.min("week").alias("cohort")), "user_key").withColumn("n", (F.datediff("week", "cohort") / 7).cast("int"))
    cells = joined.groupBy("cohort").agg(F.countDistinct("user_key").alias("size"), *[F.countDistinct(F.when(F.col("n") == i, F.col("user_key"))).alias(f"w{i}") for i in range(1, 6)])
    shown = [F.when(F.date_add("cohort", 7 * i) <= F.lit(EVENTS_AS_OF), F.col(f"w{i}")).alias(f"w{i}") for i in range(1, 6)]
    return cells.select("cohort", "size", *shown).orderBy(F.desc("cohort")).limit(6)


@query(f"""WITH {ACTIVITY}, w AS (SELECT CASE WHEN day > DATE '2024-01-22' AND day <= DATE '2024-01-29' THEN 'now' WHEN day > DATE '2024-01-15' AND day <= DATE '2024-01-22' THEN 'prev' END AS span, * FROM act)
SELECT count(DISTINCT user_key) FILTER (span = 'now') AS users_now, count(DISTINCT user_key) FILTER (span = 'prev') AS users_prev, count(*) FILTER (span = 'now' AND name = 'purchase') AS buys_now, count(*) FILTER (span = 'prev' AND name = 'purchase') AS buys_prev FROM w""")
def lagging_delta(spark, sf_dir):
    """Seven days against the seven before, half-open windows."""
    day = F.col("day")
    back = lambda n: F.lit(EVENTS_AS_OF - timedelta(days=n))
    now, prev = (day > back(7)) & (day <= back(0)), (day > back(14)) & (day <= back(7))
    buy = F.col("name") == "purchase"
    return activity(spark, sf_dir).agg(F.countDistinct(F.when(now, F.col("user_key"))).alias("users_now"), F.countDistinct(F.when(prev, F.col("user_key"))).alias("users_prev"), F.count_if(now & buy).alias("buys_now"), F.count_if(prev & buy).alias("buys_prev"))


_BANDS = [("under 10", 0.0), ("10 to 50", 10.0), ("50 to 100", 50.0), ("100 to 1000", 100.0), ("1000 and more", 1000.0)]


@query(f"""WITH {ACTIVITY}, b(band, lo, hi) AS (VALUES ('under 10', 0, 10), ('10 to 50', 10, 50), ('50 to 100', 50, 100), ('100 to 1000', 100, 1000), ('1000 and more', 1000, 1e18)),
m AS (SELECT quantile_disc(ms, 0.5) AS middle, count(ms) AS total FROM act)
SELECT band, count(ms) AS n, floor(100.0 * count(ms) / any_value(total) + 0.5)::BIGINT AS percent, any_value(middle) AS median_ms FROM b CROSS JOIN m LEFT JOIN act ON ms >= lo AND ms < hi GROUP BY band""")
def session_bands(spark, sf_dir):
    """Sessions by length in fixed bands, empty ones shown, beside the lower median."""
    a = activity(spark, sf_dir).where("ms IS NOT NULL").withColumn("band", stats.banded(F.col("ms"), _BANDS))
    total = a.agg(F.count("ms").alias("total"), stats.lower_median("ms").alias("median_ms"))
    names = spark.createDataFrame([(b,) for b, _ in _BANDS], "band string")
    shown = names.join(a.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band", "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return shown.select("band", n.alias("n"), half_up(100 * n / F.col("total")).cast("long").alias("percent"), "median_ms")


@query(f"""WITH {ACTIVITY}, c AS (SELECT name AS kind, user_key AS ref, count(*) AS views FROM act GROUP BY ALL) SELECT kind, ref, views, greatest(1, floor(100.0 * views / sum(views) OVER (PARTITION BY kind) + 0.5))::BIGINT AS share FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY views DESC, ref) <= 6""")
def most_viewed_share(spark, sf_dir):
    """The six most viewed of each kind and their share of all views, one percent at least."""
    c = activity(spark, sf_dir).groupBy(F.col("name").alias("kind"), F.col("user_key").alias("ref")).agg(F.count(F.lit(1)).alias("views"))
    return stats.rank_within(c.withColumn("share", stats.share_percent(F.col("views"), "kind")), ["kind"], [F.desc("views"), F.asc("ref")], 6).drop("place")


@query("""WITH v AS (SELECT l_orderkey AS o, l_suppkey AS voter, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS dir FROM lineitem)
SELECT o_orderkey AS feedback_id, coalesce(sum(dir), 0)::BIGINT AS score, max(CASE WHEN voter = 7 THEN dir END)::INT AS own_vote FROM orders LEFT JOIN v ON o = o_orderkey GROUP BY o_orderkey ORDER BY score DESC, feedback_id LIMIT 200""")
def votes_score(spark, sf_dir):
    """Entries with the sum of their votes (0 without any) and the caller's own vote, best first."""
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("dir"))
    joined = table(spark, sf_dir, "orders").join(votes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    g = joined.groupBy(F.col("o_orderkey").alias("feedback_id")).agg(F.coalesce(F.sum("dir"), F.lit(0)).alias("score"), F.max(F.when(F.col("l_suppkey") == 7, F.col("dir"))).alias("own_vote"))
    return g.orderBy(F.desc("score"), "feedback_id").limit(200)
