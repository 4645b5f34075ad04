"""Hand-computed cases of functions and operators that no query of its own reaches."""

from datetime import date

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from joblattice.functions import dates, money, text
from joblattice.operators import archive, builders, news, roster, search, series, stats
from joblattice.plans import fixture, newsroom, quality
from joblattice.sources import paged, pages


s = F.lit


def cases():
    return [
        (text.title_head(s("Senior Policy Officer, Reform")), "policy officer"),
        (text.title_head(s("Chief Executive Officer (Perth)")), "chief executive officer"),
        (text.title_head(s("Lead R&amp;D Engineer – Trainee")), "r d engineer"),
        (text.advertiser_matches(s("Acme Services Sdn Bhd"), s("Acme")), True),
        (text.advertiser_matches(s("Acme Widgets"), s("Acme")), False),
        (text.near_miss(s("Acme Widgets"), s("Acme")), True),
        (text.attribution_verdict(s("Indigo Shire Council"), s("IGO")), "substr"),
        (text.attribution_verdict(s("x"), s(" ")), "no-employer"),
        (text.attribution_verdict(s("Other"), s("Acme")), "unrelated"),
        (text.attribution_verdict(s("Acme Widgets"), s("Acme")), "loose"),
        (text.mentions(s("Profit at BHP-Group up"), s("BHP")), True),
        (text.mentions(s("An EY report"), s("EY")), False),
        (text.longest_contained(s("python data science"), ["data", "data science", "python"]), "data science"),
        (text.blank_to_null(s("  ")), None),
        (text.slug(s("A & B Pty. Ltd.")), "a-b-pty-ltd"),
        (text.url_host(s("https://www.Example.com:8080/x")), "example.com"),
        (text.unwrapped_url(s("https://l.example/?url=https%3A%2F%2Fa.b%2Fc")), "https://a.b/c"),
        (text.search_phrases(s("SGH"), F.array(s("Boral"), s("sgh"))), ["SGH", "Boral"]),
        (text.contained_skills(s("Rebolting"), [{"skill": "Bolts", "terms": ["bolt"]}]), ["Bolts"]),
        (text.contained_skills(s("Nurse"), [{"skill": "Bolts", "terms": ["bolt"]}]), None),
        (text.hiring_area(s("Engineering jobs"), {"engineering": "Engineering", "unknown": None}), "Engineering"),
        (text.place_to_hub(s("Level 1, Perth WA"), [("perth", "perth")], "australia", ["australia"]), "perth"),
        (text.place_to_hub(s(""), [("perth", "perth")], "australia", ["australia"]), "australia"),
        (dates.days_between(s(date(2026, 8, 5)), s(date(2026, 8, 1))), 0),
        (dates.days_advertised(s(date(2026, 8, 1)), s(date(2026, 8, 5))), 4),
        (dates.days_since_posted(s("2026-08-01T00:00"), s(date(2026, 8, 5))), 4),
        (dates.days_since_posted(s("soon"), s(date(2026, 8, 5))), None),
        (dates.relative_date(s("Posted 5 Days Ago"), s(date(2026, 8, 9))), date(2026, 8, 4)),
        (dates.relative_date(s("Just posted"), s(date(2026, 8, 9))), date(2026, 8, 9)),
        (dates.stamp_day(s("/Date(1786233600000)/")), date(2026, 8, 9)),
        (dates.stamp_day(s("20260809")), date(2026, 8, 9)),
        (dates.quarter_of(s(date(2026, 8, 1))), date(2026, 7, 1)),
        (dates.quarter_of(s(date(2026, 8, 1)), True), date(2026, 9, 1)),
        (dates.lag_months(s(date(2026, 5, 1)), s(date(2026, 8, 1))), 3),
        (money.board_salary(s(5000.0), s(7000.0), s("Monthly")), 72000.0),
        (money.board_salary(s(20.0), s(None).cast("double"), s("hourly")), 41600.0),
        (money.openings(s(900.0), s(0.1)), 100.0),
        (money.openings(s(900.0), s(1.0)), None),
        (money.heat_position(s(25.0), s(0.0), s(100.0)), 0.5),
        (money.heat_position(s(5.0), s(5.0), s(5.0)), 0.5),
        (stats.per_head(s(3.5), s(2000)), 1750.0),
        (stats.per_head(s(3.5), s(0)), None),
    ]


def test_columns(spark):
    every = cases()
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(every)]).first()
    for i, (_, want) in enumerate(every):
        assert got[i] == pytest.approx(want) if isinstance(want, float) else got[i] == want, i


def test_scope_and_release(spark):
    rows = spark.createDataFrame([(1, "Perth", "feed"), (2, "manila", "wayback"), (3, None, "feed")], "company_id int, hub string, source string")
    ids = lambda c: sorted(r.company_id for r in rows.where(c).collect())
    assert ids(archive.in_scope("company", "1")) == [1] and ids(archive.in_scope("market")) == [1, 3]
    assert ids(archive.in_scope("place", hubs=["perth"])) == [1] and ids(archive.in_scope("place", hubs=[])) == []
    hubs, companies = rows.where("hub = 'Perth'").select("hub"), rows.where("company_id = 3").select("company_id")
    assert sorted(r.company_id for r in roster.for_role(rows, False, hubs, companies).collect()) == [1, 3]
    assert roster.for_role(rows, True, hubs, companies).count() == 3
    assert [roster.window_days(7), roster.window_days(8), roster.window_days(None, roster.RETENTION_DAYS, 7)] == [7, 30, 7]


def test_archive_writes(spark):
    stored = spark.createDataFrame([("k", date(2026, 8, 1), 2.5, "old")], "key string, day date, v double, t string")
    fresh = spark.createDataFrame([("k", None, 3.25, " "), ("n", date(2026, 8, 2), None, "new")], "key string, day date, v double, t string")
    got = {r.key: tuple(r)[1:] for r in archive.filled_from(fresh, stored, "key").collect()}
    assert got == {"k": (date(2026, 8, 1), 3.25, "old"), "n": (date(2026, 8, 2), None, "new")}
    kept = spark.createDataFrame([("a", "t", "2020-01-05", date(2020, 1, 5), date(2020, 2, 1), 3)], "job_key string, title string, posted string, first_seen date, last_seen date, seen_count int")
    batch = spark.createDataFrame([("a", "t", "2020-01-01"), ("b", "u", "no date")], "job_key string, title string, posted string")
    out = {r.job_key: (r.first_seen, r.last_seen, r.seen_count) for r in archive.back_catalogue(kept, batch, date(2021, 1, 1)).collect()}
    assert out == {"a": (date(2020, 1, 1), date(2020, 2, 1), 4), "b": (date(2021, 1, 1), date(2021, 1, 1), 1)}


def test_prices_and_axis(spark):
    days = spark.createDataFrame([("x", date(2026, 8, d)) for d in (1, 2, 3, 4)] + [("y", date(2026, 8, 1))], "k string, day date")
    prices = spark.createDataFrame([("x", date(2026, 8, 2), 5.0), ("x", date(2026, 8, 4), 6.0), ("y", date(2026, 8, 1), 1.0)], "k string, day date, price double")
    assert [r.filled for r in series.priced_days(prices, days, ["k"]).orderBy("day").collect()] == [5.0, 5.0, 5.0, 6.0]
    points = spark.createDataFrame([("a", date(2026, 1, 1), 2), ("a", date(2026, 4, 1), 4), ("b", date(2026, 2, 1), 1)], "k string, month date, v int")
    full = series.on_month_axis(points, ["k"], "v").orderBy("k", "month").collect()
    assert [r.v for r in full] == [2, 0, 0, 4, 0, 1, 0, 0]
    change = series.on_month_axis(points, ["k"], "v").select("k", "month", series.trailing_change(F.col("v"), ["k"], "month", 2).alias("c")).orderBy("k", "month").collect()
    assert [r.c for r in change] == [0.0, -100.0, -100.0, 0.0, 0.0, 0.0, 0.0, -100.0]


def test_page_readers(spark):
    rss = "<rss><item><title><![CDATA[A & B]]></title><link>https://l.x/?url=https%3A%2F%2Fa.b</link><pubDate>Mon</pubDate></item><item><title>C</title></item></rss>"
    items = pages.rss_items(spark.createDataFrame([("f", rss)], "feed string, xml string")).collect()
    assert [(r.title, r.link) for r in items] == [("A & B", "https://a.b"), ("C", "")]
    cube = spark.createDataFrame([(0, 1.0), (3, 2.0), (5, 3.0)], "index long, value double")
    assert sorted(tuple(r) for r in pages.json_stat(cube, [("geo", ["DE", "FR"]), ("time", ["1", "2", "3"])]).collect()) == [("DE", "1", 1.0), ("FR", "1", 2.0), ("FR", "3", 3.0)]
    a, b = (spark.createDataFrame([(k, v)], "k string, v int") for k, v in (("x", 1), ("x", 2)))
    assert pages.feeds_by_priority([a, b], ["k"]).first()["v"] == 1


def fetch_page(page):
    """Seven full pages of two rows, a short one, and nothing behind it."""
    return [(f"Job {page}-{i}", "Acme", "Perth", f"u{page}-{i}", "") for i in range(2 if page < 7 else 1 if page == 7 else 0)]


def fetch_nothing(page):
    return []


def test_paged_source_plans_windows_up_to_the_short_page():
    reader = lambda **options: paged.PagedReader({"fetch": "tests.test_functions:fetch_page", "pagesize": "2", **options})
    assert [(p.first, p.last) for p in reader().partitions()] == [(0, 6), (6, 12)]
    assert [(p.first, p.last) for p in reader(pages="4").partitions()] == [(0, 4)]
    assert [(p.first, p.last) for p in reader(fetch="tests.test_functions:fetch_nothing").partitions()] == [(0, 6)]


def test_paged_source_and_portal_rows(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").option("fetch", "tests.test_functions:fetch_page").option("pagesize", 2).load()
    assert rows.count() == 15
    ads = paged.portal_rows(rows.union(rows.limit(3)).unionByName(rows.limit(1).withColumn("title", F.lit(" "))), "acme")
    assert ads.count() == 15 and {r.source for r in ads.collect()} == {"portal-acme"}
    (tmp_path / "r.csv").write_text("REF DATE,VALUE\n2026-01, 5 \n2026-02,x\n")
    assert [tuple(r) for r in paged.release_rows(spark, str(tmp_path / "r.csv"), {"REF DATE": "month", "VALUE": "v"}).collect()] == [("2026-01", "5"), ("2026-02", None)]
    data = spark.createDataFrame([("au", "a", 1, 2), ("au", "b", 1, 9), ("nz", "a", 1, 1)], "dataset string, skill string, month int, v int")
    paged.write_datasets(data, str(tmp_path / "out"))
    assert [r.skill for r in spark.read.parquet(str(tmp_path / "out/dataset=au")).collect()] == ["b", "a"]


def test_health_levels(spark):
    day = lambda n: date(2026, 8, n)
    counts = {"good": {d: 40 for d in range(1, 11)}, "drop": {d: 40 for d in range(1, 10)} | {10: 20}, "collapse": {d: 40 for d in range(1, 10)} | {10: 9}, "thin": {d: 10 for d in range(1, 10)} | {10: 1}, "edge": {d: 40 for d in range(1, 8)}, "stale": {d: 40 for d in range(1, 5)}}
    rows = spark.createDataFrame([(k, day(d)) for k, v in counts.items() for d, n in v.items() for _ in range(n)], "source string, first_seen date")
    expected = spark.createDataFrame([(k,) for k in [*counts, "none"]], "source string")
    got = {r.source: (r.finding, r.level) for r in quality.feed_health(rows, expected, day(10), 3).collect()}
    assert got == {"good": ("ok", ""), "drop": ("VOLUME DROP", "WARN"), "collapse": ("VOLUME COLLAPSE", "CRITICAL"), "thin": ("ok", ""), "edge": ("STALE", "WARN"), "stale": ("STALE", "CRITICAL"), "none": ("NO ROWS", "CRITICAL")}


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert roster.same_name_pairs(none("a string"), none("b string")).count() == 0
    assert news.mention_index(none("article string, title string, own string, published date"), none("name string"), date(2026, 8, 1)).count() == 0
    assert search.skill_words(none("skill string, text string, weight double"), none("text string, weight double, skills array<string>")).count() == 0
    assert builders.held_flat(none("skill string, geo string, year int, thousands double"), none("month date")).count() == 0


def test_rules_of_a_pay_text_run_once(spark):
    """They ran for every figure and every mention of the result, which made pay_texts slow."""
    rows = spark.createDataFrame([("ZAR 100,000 - 120,000", "za")], "s string, c string")
    plan = rows.select(money.annual_aud(F.col("s"), F.col("c"), F.lit("x")).alias("aud"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bZAR\b") == 1 and plan.count("annum") == 1
    assert rows.select(money.annual_aud(F.col("s"), F.col("c"), F.lit("x"))).first()[0] == round(110_000 * money.FX_TO_AUD["ZAR"])


def test_names_that_no_headline_holds_are_not_gathered(spark):
    """All pairs of words of all documents went through a shuffle and a join on their first word."""
    plan = quality.headline_mentions(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


def test_order_lines_are_joined_without_a_sort(spark):
    """Lines and orders were sorted by order: the largest task of mention_index held 555 MB of 36 million lines."""
    plan = fixture.ads(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_orderkey" in plan and "BuildRight" in plan


def test_names_of_headlines_are_read_once(spark):
    """The archive was read once for skills and once for titles, and each row's name was cut into words."""
    plan = newsroom.mention_index(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Location: InMemoryFileIndex(1 paths)[file:/root/testdata/sf0.001/lineitem.parquet") == 2


def test_a_name_given_twice_counts_once(spark):
    heads = spark.createDataFrame([("a1", "Red Bolt sold", "x", date(2026, 8, 1)), ("a2", "a red nail", "red", None)], "article string, title string, own string, published date")
    names = spark.createDataFrame([("red",), ("red",), ("Red",), (None,), ("  ",), ("ed",), ("red bolt",)], "name string")
    got = {(r.name, r.article, r.place) for r in news.mention_index(heads, names, date(2026, 8, 1)).collect()}
    assert got == {("red", "a1", 1), ("Red", "a1", 1), ("Red", "a2", 2), ("red bolt", "a1", 1)}
