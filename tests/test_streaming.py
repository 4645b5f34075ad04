"""Streams: the keyed archive with restarts, late and repeated rows, exact weekly users, and accepted events."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from joblattice.streaming import ingest

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def sightings(seed, n):
    rng = random.Random(seed)
    start = date(2024, 1, 1)
    return [(f"k{rng.randrange(12)}", rng.choice(["T", "T", "", None]), rng.choice([None, "", "9"]), rng.choice(["", "u"]), None, start + timedelta(rng.randrange(60)), i) for i in range(n)]


def plain_archive(batches):
    """The same rules, one key after the other."""
    kept = {}
    for batch in batches:
        seen = set()
        for key, title, *more, day, _ in sorted(batch, key=lambda r: (r[5], r[6])):
            if not (title or "").strip() or (key, day) in seen:
                continue
            seen.add((key, day))
            row = kept.setdefault(key, {"title": title, "salary": None, "url": None, "posted": None, "first": day, "last": day, "n": 0, "days": set()})
            if day not in row["days"] and (row["last"] - day).days < ingest.KNOWN_DAYS:
                row["n"] += 1
                row["days"].add(day)
            row["first"], row["last"] = min(row["first"], day), max(row["last"], day)
            row["days"] = {d for d in row["days"] if (row["last"] - d).days < ingest.KNOWN_DAYS}
            for name, value in zip(("salary", "url", "posted"), more, strict=True):
                row[name] = row[name] or value or None
    return {k: (r["title"], r["salary"], r["url"], r["posted"], r["first"], r["last"], r["n"]) for k, r in kept.items()}


def test_archive_over_restarts_late_and_repeated_rows(rocks, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("feed", "log", "checkpoint"))
    (tmp_path / "feed").mkdir()
    batches = [sightings(1, 40), sightings(2, 60), sightings(2, 60)[:30]]
    stream = rocks.readStream.schema(ingest.FEED).parquet(source)
    done = []
    for batch in batches:
        rocks.createDataFrame(batch, ingest.FEED).coalesce(1).write.mode("append").parquet(source)
        ingest.archive_stream(stream, log, checkpoint).awaitTermination()
        done.append(batch)
        got = {r.job_key: (r.title, r.salary, r.url, r.posted, r.first_seen, r.last_seen, r.seen_count) for r in ingest.archive_of(rocks.read.parquet(log)).collect()}
        assert got == plain_archive(done)
    before = rocks.read.parquet(log).count()
    ingest.archive_stream(stream, log, checkpoint).awaitTermination()
    assert rocks.read.parquet(log).count() == before


def test_weekly_users_are_exact_on_a_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("events", "weeks", "checkpoint"))
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["view", "view", "bad"]), start + timedelta(hours=rng.randrange(24 * 28))) for _ in range(900)]
    want = {}
    for user, name, at in rows:
        if name == "view":
            events, users = want.setdefault((at - timedelta(at.weekday())).date(), [0, set()])
            want[(at - timedelta(at.weekday())).date()][0] = events + 1
            users |= {user} - {None}
    weeks = {w: (n, len(u)) for w, (n, u) in want.items()}
    schema = "user_key long, name string, at timestamp"
    assert {r.week: (r.events, r.users) for r in ingest.weekly_users(spark.createDataFrame(rows, schema), ["view"]).collect()} == weeks
    (tmp_path / "events").mkdir()
    stream = spark.readStream.schema(schema).parquet(source)
    for part in (rows[:400], rows[400:], [(1, "view", start + timedelta(days=70))], [(1, "view", start + timedelta(days=71))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = ingest.weekly_users(stream, ["view"], late="28 days").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    told = {r.week: (r.events, r.users) for r in spark.read.parquet(out).collect()}
    assert told == weeks


def test_accepted_events(spark):
    event = "struct<name: string, detail: string, anon_key: string, session_id: string, ms: double>"
    many = [("search", f"d{i}", "a", "s", 1.0) for i in range(50)]
    rows = [
        (" A@B.c ", datetime(2024, 1, 1, 23, 59), [("session_end", " x \n y ", "device", "s" * 50, 9e9), ("nothing", "", "", "", 0.0), ("search", None, None, None, None)]),
        (None, datetime(2024, 1, 2), [("session_end", "z" * 99, " dev  ice ", None, -5.0), ("session_end", "", "d", "", 12.6)]),
        ("", datetime(2024, 1, 3), many),
        ("u", datetime(2024, 1, 4), None),
    ]
    got = ingest.accepted_events(spark.createDataFrame(rows, f"user_key string, received timestamp, events array<{event}>")).collect()
    assert len(got) == 2 + 2 + 40
    first = [r for r in got if r.user_key == "a@b.c"]
    assert [(r.name, r.detail, r.anon_key, len(r.session_id), r.ms, str(r.day)) for r in first] == [("session_end", "x y", "", 40, ingest.MOST_MS, "2024-01-01"), ("search", "", "", 0, 0, "2024-01-01")]
    assert [(r.anon_key, len(r.detail), r.ms) for r in got if str(r.day) == "2024-01-02"] == [("dev ice", 64, 0), ("d", 0, 13)]
    assert {r.ms for r in got if r.name == "search"} == {0}
    assert ingest.accepted_events(spark.createDataFrame(rows, f"user_key string, received timestamp, events array<{event}>").where("false")).select(F.count("*")).first()[0] == 0
