"""Hand-computed cases: change, coverage, money, dates, names, skills, upserts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from joblattice.functions import dates, money, text
from joblattice.operators import archive, coverage, search, series, stats
from joblattice.plans import quality


def day(n):
    return date(2026, 8, n)


def ads(spark, *spans):
    return spark.createDataFrame([(day(a), day(b)) for a, b in spans], "first_seen date, last_seen date")


def change(spark, *spans):
    daily = series.live_days(ads(spark, *spans), day(1), day(10)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    full = series.calendar(spark, day(1), day(10)).join(daily, "day", "left").select(F.lit(0).alias("k"), "day", F.coalesce("n", F.lit(0)).alias("n"))
    return series.half_window_change(full, ["k"], "day", "n").first()["pct"]


@pytest.mark.parametrize("spans, pct", [(((1, 10), (4, 10), (6, 10), (8, 10)), 157.1), (((1, 10), (1, 10), (1, 5), (1, 5)), -50.0), (((1, 10), (1, 10), (1, 10), (10, 10)), 6.7)])
def test_half_window_change(spark, spans, pct):
    assert change(spark, *spans) == pct


def test_half_window_change_needs_five_points(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(4)], "k string, i int, v int")
    assert series.half_window_change(df, ["k"], "i", "v").first()["pct"] is None


@pytest.mark.parametrize(
    "feeds, want",
    [
        ([(12, 172), (11, 645), (10, 65), (1, 41)], day(10)),
        ([(11, 10)], day(11)),
        ([(11, 0)], None),
        ([(11, 50), (8, 50)], day(8)),
        ([(11, 990), (8, 10)], day(11)),
        ([(11, 95), (8, 5)], day(11)),
    ],
)
def test_coverage_day(spark, feeds, want):
    df = spark.createDataFrame([(day(d), n) for d, n in feeds], "mx date, n long")
    assert coverage.coverage_day(df).first()[0] == want


@pytest.mark.parametrize(
    "salary, country, want",
    [("₱25,000 per month", "ph", 6959), ("S$3,000–S$5,000/mo", "sg", 53208), ("72,038", "us", 102317), ("21,280–22,800", "gb", 42198), ("$110k - $149k", "au", 129500), ("$50k - $69k, $70k - $89k", "au", 69500), ("1.5-2.5万", "cn", 50479), ("$32.02 - $37.35 an hour", "au", 60629), ("14–18", "gb", None), ("Negotiable", "au", None), ("100000", None, None), (None, "au", None)],
)
def test_annual_aud(spark, salary, country, want):
    df = spark.createDataFrame([(salary, country)], "s string, c string")
    assert df.select(money.annual_aud(F.col("s"), F.col("c"), F.lit(None).cast("string"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [("2.5-4.5万", (420000.0, "CNY")), ("S$2,600–S$4,600/mo", (43200.0, "SGD")), ("$50k - $69k", (59500.0, "AUD")), ("80,000 - 95,000", (87500.0, "AUD")), ("35.50", None), ("Competitive", None)])
def test_parsed_pay(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(money.parsed_pay(F.col("s"), F.lit("AUD"))).first()[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw", ["2026-08-09T14:22:00Z", "09/08/2026", "9-8-2026", "9/8/26", "09 Aug 2026", "Aug 9, 2026", "Date 09 Aug 2026", "Closing Date: 09/08/2026"])
def test_loose_date(spark, raw):
    assert spark.createDataFrame([(raw,)], "s string").select(dates.loose_date(F.col("s"))).first()[0] == day(9)


@pytest.mark.parametrize("raw", ["", None, "Ongoing", "31/13/2026", "09/08/1200", "31/02/2026"])
def test_loose_date_refuses(spark, raw):
    assert spark.createDataFrame([(raw,)], "s string").select(dates.loose_date(F.col("s"))).first()[0] is None


@pytest.mark.parametrize("a, b, same", [("Indigo Shire Council", "IGO", False), ("Wiley", "EY", False), ("Deloitte", "Deloitte Touche Tohmatsu", True), ("The University of Queensland", "University of Queensland", True), ("", "IGO", False)])
def test_advertiser_matches(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(text.advertiser_matches(F.col("a"), F.col("b")) | text.advertiser_matches(F.col("b"), F.col("a")) | (text.same_company(F.col("a"), F.col("b")))).first()[0]
    assert bool(got) is same


def test_skills_at_word_starts_and_gates(spark):
    taxonomy = [{"skill": "ERP", "terms": ["erp"]}, {"skill": "Education", "terms": [], "gated": ["principal"], "evidence": ["school", "college"]}]
    df = spark.createDataFrame([("Enterprise lead",), ("ERP lead",), ("School Principal",), ("Principal engineer",)], "t string")
    got = [r[0] for r in df.select(text.matched_skills(F.col("t"), taxonomy)).collect()]
    assert got == [None, ["ERP"], ["Education"], None]


def test_stored_skills_tolerate_garbage(spark):
    df = spark.createDataFrame([('["a","b","a","x"]',), ("bad",), (None,), ("[]",)], "s string")
    got = [r[0] for r in df.select(text.stored_skills(F.col("s"), {"b": "c"}, ["a", "c"])).collect()]
    assert got == [["a", "c"], [], [], []]


def test_search_tokens_and_intent(spark):
    df = spark.createDataFrame([("Repairing engines and the pumps",)], "s string")
    got = df.select(text.search_tokens(F.col("s"))).first()[0]
    assert {"repairing", "repair", "engines", "engine", "pumps", "pump", "repairing engines"} <= set(got) and "engines and" not in got
    df = spark.createDataFrame([("how many applicants",), ("salary?",), ("hiring trend",), (None,)], "s string")
    assert [r[0] for r in df.select(text.intent(F.col("s"))).collect()] == ["unknown", "pay", "volume", "unknown"]


def test_upsert_fills_and_counts(spark):
    archive_rows = spark.createDataFrame([("k1", "T", "", day(1), day(2), 1), ("k2", "T", "9", day(1), day(2), 1)], "job_key string, title string, salary string, first_seen date, last_seen date, seen_count int")
    batch = spark.createDataFrame([("k1", "T", "5", 0), ("k1", "T", "6", 1), ("k3", "N", None, 2), ("k4", " ", "1", 3)], "job_key string, title string, salary string, ordinal int")
    got = {r.job_key: (r.salary, r.first_seen.day, r.last_seen.day, r.seen_count) for r in archive.upsert(archive_rows, batch, day(5)).collect()}
    assert got == {"k1": ("5", 1, 5, 2), "k2": ("9", 1, 2, 1), "k3": (None, 5, 5, 1)}


def test_four_medians(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    row = df.agg(F.percentile("x", 0.5), stats.lower_median("x"), stats.upper_median("x"), stats.floored_median(F.col("x"), 4), stats.floored_median(F.col("x"))).first()
    assert tuple(row) == (2.5, 2, 3, 3, None)


def test_mentions_of_names_of_several_words(spark):
    heads = spark.createDataFrame([(1, "New York: Port Authority, York"), (2, "york new"), (3, None), (4, "new new york")], "item_id long, text string")
    names = spark.createDataFrame([("New York",), ("york",), ("Port-Authority",), (None,), ("",), ("York Port Authority Hall",)], "name string")
    got = {tuple(r) for r in quality.mentions(heads, names).collect()}
    assert got == {(1, "New York"), (1, "york"), (1, "Port-Authority"), (2, "york"), (4, "New York"), (4, "york")}


def test_described_skills_send_the_index_not_the_words_of_the_queries(spark):
    """Finding 1: a table of exploded words is estimated as no larger than its texts, and went through the driver."""
    index = spark.createDataFrame([("weld", "welding", 1.0, 0.5), ("pipe", "plumbing", 0.4, 1.0)], "token string, skill string, share double, w double")
    asked = spark.createDataFrame([(1, "weld the pipe"), (2, "ab")], "query_id long, text string")
    found = search.described_skills(asked, index)
    assert sorted(tuple(r) for r in found.select("query_id", "skill", "score", "place").collect()) == [(1, "plumbing", 0.4, 2), (1, "welding", 0.5, 1)]
    assert "rightHint=(strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString() or "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()
