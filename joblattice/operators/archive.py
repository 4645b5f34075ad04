"""The advertisement archive: predicates, upserts and the rows' derived columns.

An advertisement is live on every day from first_seen to last_seen, both included.
Every operator takes the day it looks from as a parameter.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources that are closed collections: old rows that say nothing about the market now.
CLOSED_SOURCES = ("wayback",)


def live_feeds(source: Column = None) -> Column:
    """Rows of feeds that still collect; a row without a source counts as one."""
    source = F.col("source") if source is None else source
    return ~F.coalesce(source, F.lit("")).isin(*CLOSED_SOURCES)


def live_on(day: date | Column) -> Column:
    day = F.lit(day) if isinstance(day, date) else day
    return (F.col("first_seen") <= day) & (F.col("last_seen") >= day)


def advertised_now(as_of: date) -> Column:
    return F.col("last_seen") >= F.lit(as_of)


def closed_by(as_of: date) -> Column:
    return F.col("last_seen") < F.lit(as_of)


def in_scope(kind: str, ident: str | None = None, hubs: list[str] | None = None, companies: list | None = None) -> Column:
    """The rows of a company, of some hubs or of the whole market; an empty list of companies fits no row."""
    if kind == "company":
        found = F.col("company_id").cast("string") == F.lit(ident)
    elif hubs is not None:
        found = F.lower("hub").isin([h.lower() for h in hubs]) if hubs else F.lit(False)
    else:
        found = F.lit(True)
    if companies is not None:
        found = found & (F.col("company_id").isin(companies) if companies else F.lit(False))
    return live_feeds() & found


def released(rows: DataFrame, hubs: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of a released hub (of its country's), or else of a company plotted in one; without either no row."""
    in_hub = rows.join(hubs.select("hub").distinct(), "hub", "left_semi")
    other = rows.join(hubs.select("hub").distinct(), "hub", "left_anti")
    return in_hub.unionByName(other.join(companies.select("company_id").distinct(), "company_id", "left_semi").select(rows.columns))


_FILLED = ("salary", "url", "posted", "skills")


def upsert(archive: DataFrame, batch: DataFrame, day: date) -> DataFrame:
    """The archive after a day's batch: new keys enter, known ones are seen once more.

    Of a batch's rows with one key the first (by ``ordinal``) counts; rows without
    a title are dropped; salary, url, posted and skills are only filled where they
    were missing.  Columns of the archive: job_key, title, those four,
    first_seen, last_seen, seen_count, and any others, which known rows keep.
    """
    first = Window.partitionBy("job_key").orderBy("ordinal")
    news = batch.where(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "ordinal")
    filled = [c for c in _FILLED if c in archive.columns]
    mark = archive.withColumn("known", F.lit(True)).alias("a").join(news.withColumn("seen", F.lit(True)).alias("b"), "job_key", "full_outer")
    today = F.lit(day)

    def column(name: str) -> Column:
        if name == "job_key":
            return F.col(name)
        if name == "first_seen":
            return F.coalesce("a.first_seen", today)
        if name == "last_seen":
            return F.when(F.col("b.seen"), today).otherwise(F.col("a.last_seen"))
        if name == "seen_count":
            return (F.coalesce("a.seen_count", F.lit(0)) + F.when(F.col("b.seen"), 1).otherwise(0)).cast(archive.schema[name].dataType)
        own, new = F.col(f"a.{name}"), F.col(f"b.{name}")
        if name in filled and archive.schema[name].dataType.simpleString() == "string":
            return F.coalesce(F.nullif(own, F.lit("")), new)
        if name in filled:
            return F.coalesce(own, new)
        return F.when(F.col("a.known"), own).otherwise(new)

    return mark.select(*[column(c).alias(c) for c in archive.columns])


def historical_upsert(archive: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures in any order: first_seen the least, last_seen the greatest, counts added up; the archive's
    other columns win.  Least and greatest commute, so late batches do no harm."""
    tagged = archive.withColumn("own", F.lit(0)).unionByName(captures.select(archive.columns).withColumn("own", F.lit(1)))
    rest = [c for c in archive.columns if c not in ("job_key", "first_seen", "last_seen", "seen_count")]
    kept = [F.min_by(c, F.struct("own", "first_seen", F.col(c).cast("string"))).alias(c) for c in rest]
    grouped = tagged.groupBy("job_key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"), *kept)
    return grouped.select(archive.columns)


def back_catalogue(archive: DataFrame, batch: DataFrame, day: date) -> DataFrame:
    """An upsert whose new rows begin and end on their posting day; last_seen never moves backwards."""
    own = F.coalesce(F.try_to_date(F.substring("posted", 1, 10), "yyyy-MM-dd"), F.lit(day))
    dated = batch.withColumn("first_seen", own).withColumn("last_seen", own).withColumn("seen_count", F.lit(1))
    return historical_upsert(archive, dated.select(archive.columns))


def bounded_append(series: DataFrame, points: DataFrame, keep: int = 365) -> DataFrame:
    """A series per key (key, day, value): a point of a known day replaces it, and the last ``keep`` stay."""
    both = series.withColumn("own", F.lit(0)).unionByName(points.withColumn("own", F.lit(1)))
    merged = both.groupBy("key", "day").agg(F.max_by("value", "own").alias("value"))
    last = Window.partitionBy("key").orderBy(F.desc("day"))
    return merged.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= keep).drop("nth")


def stratified_sample(rows: DataFrame, n: int, stratum: Column, key: str) -> DataFrame:
    """``n`` rows taken in turn from each stratum, by ``key`` inside a stratum."""
    within = Window.partitionBy("stratum").orderBy(key)
    ranked = rows.withColumn("stratum", stratum).withColumn("nth", F.row_number().over(within))
    return ranked.orderBy("nth", "stratum", key).limit(n)


def aged_listings(seen: DataFrame, as_of: date, days: int = 4, cap: int = 80) -> DataFrame:
    """Stored listings per company seen again within some days, the newest ``cap`` of them."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("last_seen"), "job_key")
    fresh = seen.where(F.datediff(F.lit(as_of), "last_seen") <= days)
    return fresh.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= cap).drop("nth")


def filled_from(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored rows with the fresh row's fields where these aren't empty; an empty fresh sample changes nothing."""
    f, s = fresh.alias("f"), stored.alias("s")
    text = lambda c: fresh.schema[c].dataType.simpleString() == "string"
    new = lambda c: F.nullif(F.trim(f"f.{c}"), F.lit("")) if text(c) else F.col(f"f.{c}")
    cols = [F.coalesce(new(c), F.col(f"s.{c}")).cast(stored.schema[c].dataType).alias(c) for c in stored.columns if c != key]
    return s.join(f, key, "full_outer").select(key, *cols)
