"""Streams: events as they come in, weekly figures, and the archive kept up to date row by row."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The recorded events, how many of a batch are read, and how long texts and sessions may be.
ALLOWED = "session_start session_end search company_open skill_open city_open follow_add follow_remove panel_open".split()
MOST_EVENTS = 40
MOST_DETAIL, MOST_KEY = 64, 40
MOST_MS = 4 * 3600 * 1000


def clean_events(events: DataFrame, allowed: list[str]) -> DataFrame:
    """Allowed names only; session lengths clamped to four hours; no device id for signed-in users."""
    rows = events.where(F.col("name").isin(allowed))
    if "ms" in rows.columns:
        rows = rows.withColumn("ms", F.least(F.greatest("ms", F.lit(0)), F.lit(MOST_MS)))
    if "anon_key" in rows.columns:
        rows = rows.withColumn("anon_key", F.when(F.col("user_key").isNull(), F.col("anon_key")))
    return rows


def accepted_events(requests: DataFrame, allowed: list[str] = ALLOWED) -> DataFrame:
    """The events of requests as they are stored; works on a stream and on a batch.

    ``requests`` has user_key (blank or null: not signed in), received (the server's
    time) and events: structs of name, detail, anon_key, session_id and ms.  The first
    40 events of a request are read, those of unknown names dropped.  The time is the
    server's; blanks in texts are closed up and texts cut; a session's length counts at
    its end only, between nothing and four hours; a signed-in user's device id is dropped.
    """
    rows = requests.select(F.lower(F.trim(F.coalesce("user_key", F.lit("")))).alias("user_key"), "received", F.posexplode(F.slice("events", 1, MOST_EVENTS)).alias("nth", "e")).where(F.col("e.name").isin(allowed))
    tidy = lambda c, most: F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, most)
    length = F.least(F.greatest(F.round(F.coalesce("e.ms", F.lit(0))), F.lit(0)), F.lit(MOST_MS)).cast("long")
    return rows.select(
        "user_key",
        F.when(F.col("user_key") == "", tidy(F.col("e.anon_key"), MOST_KEY)).otherwise("").alias("anon_key"),
        tidy(F.col("e.session_id"), MOST_KEY).alias("session_id"),
        F.col("e.name").alias("name"),
        tidy(F.col("e.detail"), MOST_DETAIL).alias("detail"),
        F.col("received").alias("at"),
        F.to_date("received").alias("day"),
        F.when(F.col("e.name") == "session_end", length).otherwise(F.lit(0)).cast("long").alias("ms"),
        "nth",
    )


def weekly_users(events: DataFrame, allowed: list[str], late: str = "7 days") -> DataFrame:
    """Events and distinct users per Monday week, exactly; works on a batch, and on a stream in append mode.

    Events are first counted by week and user, then by week, so no week's users are
    ever held together.  A week of a stream is told, once, when the watermark has passed its
    end; the state holds the weeks that are still open.  Events without a user count as events only.
    """
    rows = clean_events(events, allowed).withWatermark("at", late)
    week = F.window("at", "7 days", startTime="4 days")  # epoch day 0 was a Thursday
    by_user = rows.groupBy(week.alias("week"), "user_key").agg(F.count(F.lit(1)).alias("n"))
    return by_user.groupBy("week").agg(F.sum("n").alias("events"), F.count("user_key").alias("users")).select(F.col("week.start").cast("date").alias("week"), "events", "users")


# --------------------------------------------------------------- keyed archive

FEED = "job_key string, title string, salary string, url string, posted string, day date, ordinal int"
CHANGES = "job_key string, title string, salary string, url string, posted string, first_seen date, last_seen date, seen_count int, version long"
_STATE = "title string, salary string, url string, posted string, first int, last int, seen int, days string, version long"
_FILLED = ("salary", "url", "posted")
#: Days before the last one on which a row is known to have been counted already.
KNOWN_DAYS = 30


def _number(day: date) -> int:
    return day.toordinal()


class KeptListing(StatefulProcessor):
    """One listing's row of the archive, as its sightings come in."""

    def __init__(self, ttl_days: int | None = None):
        self.ttl_days = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {} if self.ttl_days is None else {"ttl_duration_ms": self.ttl_days * 86_400_000}
        self.state = handle.getValueState("listing", _STATE, **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        now = list(old) if old is not None else None
        sightings = sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.day, r.ordinal))
        seen_now = set()
        for r in sightings:
            day = _number(r.day)
            if day in seen_now or not str(r.title or "").strip():
                continue
            seen_now.add(day)
            if now is None:
                now = [r.title, None, None, None, day, day, 0, "", 0]
            days = {int(d) for d in now[7].split(",") if d}
            if day not in days and day > now[5] - KNOWN_DAYS:
                now[6] += 1
                days.add(day)
            now[4], now[5] = min(now[4], day), max(now[5], day)
            now[7] = ",".join(str(d) for d in sorted(days) if d > now[5] - KNOWN_DAYS)
            for i, name in enumerate(_FILLED, 1):
                now[i] = now[i] or getattr(r, name) or None
        if now is None or (old is not None and tuple(now) == tuple(old)):
            return
        now[8] += 1
        self.state.update(tuple(now))
        yield pd.DataFrame({"job_key": [key[0]], "title": [now[0]], **{c: [now[i]] for i, c in enumerate(_FILLED, 1)}, "first_seen": [date.fromordinal(now[4])], "last_seen": [date.fromordinal(now[5])], "seen_count": [now[6]], "version": [now[8]]})

    def close(self) -> None:
        pass


def archive_changes(feed: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """A stream of archive rows that changed, from a stream of sightings (columns of FEED).

    A listing's row lives in keyed state (the session needs the RocksDB state store): only
    keys that came in are touched.  Of one key's rows of one day in one batch the first, by
    ordinal, counts; a day counts once, in whichever batches and order its rows come.  Rows
    more than 30 days older than the latest move first_seen and fill what was missing, but
    are not counted.  Rows without a title are dropped.  With ``ttl_days`` a listing's
    state goes that long after its last change, and a later sighting begins a new row.
    """
    return feed.groupBy("job_key").transformWithStateInPandas(KeptListing(ttl_days), CHANGES, "append", "none" if ttl_days is None else "processingTime")


def archive_stream(feed: DataFrame, path: str, checkpoint: str, ttl_days: int | None = None):
    """A running query that appends the changed rows of the archive to a log, each once, whatever restarts."""
    return archive_changes(feed, ttl_days).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive_of(log: DataFrame) -> DataFrame:
    """The archive as its log of changes leaves it: each key's latest row."""
    columns = [c for c in log.columns if c not in ("job_key", "version")]
    return log.groupBy("job_key").agg(F.max_by(F.struct(*columns), "version").alias("r")).select("job_key", "r.*")
