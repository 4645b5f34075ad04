"""The priced market and the ticker on small hand-made archives."""

import random
from datetime import date, timedelta

from conftest import DATA
from pyspark.sql import functions as F

from joblattice.operators import priced
from joblattice.plans import QUERIES

AS_OF = date(2024, 3, 31)
SCHEMA = "skills array<string>, source string, country string, salary double, first_seen date, last_seen date"


def day(back):
    return AS_OF - timedelta(back)


def canonical(spark, *names):
    return spark.createDataFrame([(n, n[:1]) for n in names], "skill string, category string")


def test_window_follows_the_feeds(spark):
    feeds = lambda *rows: spark.createDataFrame(rows, "mn date, n long")
    span = lambda df: priced.market_window(df, AS_OF).first().span
    assert span(feeds((day(100), 50), (day(3), 50))) == 30  # half of all rows is enough
    assert span(feeds((day(100), 49), (day(9), 51))) == 10
    assert span(feeds((day(2), 10))) is None


def test_prices_changes_and_places(spark):
    rows = [(["sql", "sql"], "f", c, 100.0 + i, day(40), day(0)) for c in ("au", "nz") for i in range(8)]
    rows += [(["java"], "f", "au", None, day(i), day(0)) for i in range(20)] + [(["odd"], "f", None, 5.0, day(1), day(0)), (["rust"], "f", "au", 9.0, day(40), day(0)), ([], "f", "au", 1.0, day(1), day(0))]
    known = canonical(spark, "sql", "java", "rust")
    market = priced.priced_skills(spark.createDataFrame(rows, SCHEMA), AS_OF, known)
    got = {r.skill: r for r in market.collect()}
    assert set(got) == {"sql", "java", "rust"}
    assert (got["sql"].pay, got["sql"].pay_markets, got["sql"].now_n, got["sql"].value, got["sql"].place, got["sql"].spark, got["sql"].dir) == (104, 2, 16, 104 * 16, 1, None, "flat")
    assert (got["java"].pay, got["java"].value, got["java"].place, got["java"].dir) == (None, None, 2, "up") and len(got["java"].spark) == 30
    assert got["rust"].pct is None and got["rust"].place == 3  # never three on a day
    series = {r.day: r.value for r in priced.value_series(market).collect()}
    assert len(series) == 30 and set(series.values()) == {104 * 16}
    assert {r.category: (r.skills, r.priced, r.value, r.pct) for r in priced.category_market(market).collect()} == {"s": (1, 1, 1664, 0.0), "j": (1, 0, None, None), "r": (1, 0, None, None)}
    assert priced.priced_skills(spark.createDataFrame(rows, SCHEMA).where("false"), AS_OF, known).count() == 0


def test_windows_before_collecting_stay_empty_and_few_movers_are_filled_up(spark):
    rows = [(["a"], "f", "au", None, day(20), day(0))] * 30 + [(["b"], "f", "au", None, day(20), day(3))] * 6 + [(["c"], "f", "au", None, day(k), day(0)) for k in range(20) for _ in range(2)]
    rows += [(["early"], "f", "au", None, day(55), day(50))]
    rows += [([f"s{i}"], "f", "au", None, day(20), day(0)) for i in range(12)]
    names = canonical(spark, "a", "b", "c", "early", *[f"s{i}" for i in range(12)])
    got = priced.ticker(spark.createDataFrame(rows, SCHEMA), AS_OF, names).collect()
    by = {w: sorted((r.place, r.skill, r.v, r.sig, r.filled) for r in got if r.window == w) for w in priced.WINDOWS}
    assert by["30d"] == []  # 60 days ago nothing was collected yet
    assert by["7d"][:2] == [(1, "c", 24.0, 14, False), (2, "a", 12.0, 30, True)]
    assert len(by["7d"]) == 12 and [p for p, *_ in by["7d"]] == list(range(1, 13)) and {s for _, s, *_ in by["7d"]} >= {"b"}
    assert all(r.spark is None or len(r.spark) == 30 for r in got)
    moved = next(r for r in got if r.skill == "c" and r.window == "7d")
    assert moved.spark[-1] == 40 and moved.spark[0] == 0 and moved.pay is None
    assert priced.ticker(spark.createDataFrame(rows, SCHEMA).where("false"), AS_OF, names).select(F.count("*")).first()[0] == 0


def test_lines_count_every_advertisement_of_the_covered_days(spark):
    some = random.Random(3)
    rows = []
    for _ in range(600):
        first = some.randrange(-3, 70)
        rows.append((some.choice([["a"], ["b", "a"], ["c"]]), some.choice(["f", "f", "f", None]), "au", 1.0, day(first), day(first - some.randrange(40))))
    rows += [(["a"], "late", "au", 1.0, day(12), day(2))] * 60 + [(["a"], "f", "au", 1.0, None, day(0)), (["b"], "f", "au", 1.0, day(4), None)]
    began = {f: min(r[4] for r in rows if r[1] == f and r[4]) for f in ("f", None, "late")}
    assert began["late"] == day(12)
    dated = [r for r in rows if r[4] and r[5]]
    lines = {r.skill: (r.begin, r.line) for r in priced.daily_lines(spark.createDataFrame(rows, SCHEMA), AS_OF).collect()}
    begin = day(12)  # the late feed has more than 5 % of the window's rows
    days = [begin + timedelta(i) for i in range(13)]
    assert lines == {s: (begin, [sum(s in r[0] and r[4] <= d <= r[5] for r in dated) for d in days]) for s in "abc"}


def test_unplaced_advertisements_count_but_have_no_vote(spark):
    rows = [(["a", "odd"], "f", c, pay, day(40), day(0)) for c, pay, n in (("au", 10.0, 8), ("nz", 90.0, 7), (None, 50.0, 9)) for _ in range(n)] + [(["odd"], "f", "au", 1.0, day(90), day(80)), (None, "f", "au", 1.0, day(40), day(0)), ([None], "f", "au", 1.0, day(40), day(0))]
    market = priced.priced_skills(spark.createDataFrame(rows, SCHEMA), AS_OF, canonical(spark, "a", "b"))
    assert [(r.skill, r.now_n, r.pay, r.pay_markets, r.value) for r in market.collect()] == [("a", 24, 10, 1, 240)]
    assert [(r.category, r.skills, r.priced, r.now_n, r.value, r.pct) for r in priced.category_market(market).collect()] == [("a", 1, 1, 24, 240, 0.0)]


def test_categories_read_the_archive_four_times(spark):
    """Once each for names, feeds, lines and prices; it was nine times, each with all joins."""
    found = QUERIES["market_categories"](spark, DATA)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("sf0.001/lineitem.parquet") == 4
