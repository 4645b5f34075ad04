"""Single fields read back from texts that are written from the tables: dates, pay, names, places, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import text as tx
from ..operators import archive, roster, series
from ..sources import paged, pages
from .fixture import ADS, AS_OF, ads, table
from .registry import query


def _one_of(k: Column, shapes: list[Column]) -> Column:
    return F.get(F.array(*shapes), (k % len(shapes)).cast("int"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 AND o_orderdate > DATE '2001-07-31' THEN NULL WHEN o_orderkey % 8 = 6 AND o_orderdate < DATE '2001-09-09' THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day,
  CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE) AS quarter_end,
  greatest(0, DATE '2001-07-31' - CAST(o_orderdate AS DATE)) AS age, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '2001-07-31' THEN DATE '2001-07-31' - CAST(o_orderdate AS DATE) END AS since_posted,
  CASE WHEN o_orderdate <= DATE '2001-07-31' THEN date_diff('month', date_trunc('month', o_orderdate), DATE '2001-07-01') END AS lag FROM orders""", days="day quarter quarter_end")
def date_texts(spark, sf_dir):
    """Days read back from eight ways of writing them, with quarters, ages and lags."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    stamp = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    shapes = [
        F.date_format(day, "yyyy-MM-dd'T'00:00"),
        F.concat(F.lit("Closing Date "), F.date_format(day, "d/M/yyyy")),
        F.concat(F.lit("Posted: "), F.date_format(day, "d MMMM yyyy")),
        F.date_format(day, "MMM d, yyyy"),
        F.concat(F.lit("/Date("), (stamp * 1000).cast("string"), F.lit(")/")),
        F.date_format(day, "yyyyMMdd'T'000000"),
        F.date_format(day, "dd.MM.yy"),
        F.when(day <= F.lit(AS_OF), F.concat(F.lit("Posted "), F.datediff(F.lit(AS_OF), day).cast("string"), F.lit("+ Days Ago"))).otherwise("soon"),
    ]
    text = _one_of(k, shapes)
    read = F.when((k % 8).isin(4, 5), dates.stamp_day(text)).when(k % 8 == 7, dates.relative_date(text, F.lit(AS_OF))).otherwise(dates.loose_date(text))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", read.alias("day"), day.alias("d"))
    since = dates.days_since_posted(F.col("d").cast("string"), F.lit(AS_OF))
    lag = F.when(F.col("d") <= F.lit(AS_OF), dates.lag_months(F.trunc("d", "month"), F.trunc(F.lit(AS_OF), "month")))
    return rows.select("o_orderkey", "day", dates.quarter_of(F.col("d")).alias("quarter"), dates.quarter_of(F.col("d"), end_labelled=True).alias("quarter_end"), dates.days_between(F.col("d"), F.lit(AS_OF)).alias("age"), since.alias("since_posted"), lag.alias("lag"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS s, 40 + p_size AS n FROM part)
SELECT k, CASE s WHEN 0 THEN floor((n * 1000.0 + (n + 10) * 1000.0) / 2 + 0.5) WHEN 1 THEN floor((n * 1000.0 * 0.837048 + (n + 10) * 1000.0 * 0.837048) / 2 + 0.5) WHEN 2 THEN floor(n * 1748.0 * 1.420319 + 0.5) WHEN 3 THEN floor(n * 100.0 * 12 * 1.108501 + 0.5) WHEN 5 THEN floor(n * 1000.0 * 1.91459 + 0.5) END::BIGINT AS aud,
  CASE s WHEN 0 THEN n * 1000.0 + 5000 WHEN 1 THEN n * 1000.0 + 5000 WHEN 2 THEN n * 12.0 WHEN 3 THEN n * 100.0 * 12 WHEN 5 THEN n * 1000.0 END::DOUBLE AS annual, CASE s WHEN 0 THEN 'AUD' WHEN 1 THEN 'AUD' WHEN 2 THEN 'SGD' WHEN 3 THEN 'SGD' WHEN 5 THEN 'AUD' END AS currency,
  (n + n + 2) / 2.0 * CASE s % 3 WHEN 0 THEN 12 WHEN 1 THEN 2080 ELSE 1 END AS board,
  round((sqrt(n) - sqrt(min(n) OVER ())) / (sqrt(max(n) OVER ()) - sqrt(min(n) OVER ())), 9) AS heat FROM p""")
def pay_texts(spark, sf_dir):
    """Pay read from six ways of stating it, a board's own ranges, and the place on a square-root scale."""
    n, k = F.col("n"), F.col("k")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.lit(40) + F.col("p_size")).cast("int").alias("n"))
    shapes = [F.format_string("A$%d,000 - A$%d,000 per annum", n, n + 10), F.format_string("%dk to %dk", n, n + 10), F.format_string("US$%d per hour", n), F.format_string("S$%d per month", n * 100), F.lit("competitive, plus car"), F.format_string("£%d,000", n)]
    rows = rows.repartition("k").withColumn("text", _one_of(k, shapes))  # much work for each row of a small file
    country, text = F.when(k % 6 == 1, "nz"), F.col("text")
    edges = rows.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    period = _one_of(k, [F.lit("Monthly"), F.lit("hourly"), F.lit("yearly")])
    wide = rows.join(F.broadcast(edges)).withColumn("pay", money.parsed_pay(text, F.lit("AUD")))  # one row
    pay = F.col("pay")
    return wide.select("k", money.annual_aud(text, country, F.lit("no-such")).alias("aud"), pay["annual"].alias("annual"), pay["currency"].alias("currency"), money.board_salary(n.cast("double"), (n + 2).cast("double"), period).alias("board"), F.round(money.heat_position(n, F.col("least"), F.col("most")), 9).alias("heat"))


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 2 THEN 'loose' WHEN 3 THEN 'substr' WHEN 4 THEN 'unrelated' WHEN 6 THEN 'no-employer' ELSE 'ok' END AS verdict, c_custkey % 7 = 2 AS near, c_custkey % 7 = 3 AS inside, c_custkey % 7 IN (0, 1, 2, 5) AS mentioned,
  CASE WHEN c_custkey % 7 IN (0, 3) THEN 'home' ELSE 'hub ' || (c_custkey % 7) END AS hub, CASE c_mktsegment WHEN 'BUILDING' THEN 'Trades' WHEN 'MACHINERY' THEN NULL ELSE 'Retail' END AS area,
  'https://' || lower(c_mktsegment) || '.example/job?id=' || c_custkey AS link, lower(c_mktsegment) || '.example' AS host, [c_mktsegment, 'Brand ' || (c_custkey % 3)] AS phrases,
  CASE c_custkey % 3 WHEN 0 THEN ['sql', 'java'] WHEN 1 THEN [] ELSE ['sql'] END AS skills, CASE WHEN c_custkey % 2 = 0 THEN 'data science' ELSE 'data' END AS longest, lower(c_mktsegment) || ' cook' AS head FROM customer""")
def name_fields(spark, sf_dir):
    """Advertisers judged against employers, places as hubs, categories as areas, links, phrases, stored skills and title heads."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    shapes = [F.concat(seg, F.lit(" Pty Ltd")), F.concat(F.lit("The "), seg), F.concat(seg, F.lit(" Widgets")), F.concat(F.lit("In"), F.lower(seg), F.lit("go")), F.lit("Quite other"), F.upper(seg), F.concat(seg, F.lit(" Group"))]
    advertiser = _one_of(k, shapes)
    employer = F.when(k % 7 == 6, " ").otherwise(seg)
    spot = _one_of(k, [F.lit(""), *[F.format_string("Level %s, Place%s (CBD)", F.lit(str(i)), F.lit(str(i))) for i in (1, 2)], F.lit("Homeland"), *[F.format_string("Place%s", F.lit(str(i))) for i in (4, 5, 6)]])
    needles = [(f"place{i}", f"hub {i}") for i in range(1, 7)]
    areas = {"building": "Trades", "machinery": None, "automobile": "Retail", "furniture": "Retail", "household": "Retail"}
    link = F.concat(F.lit("https://"), F.lower(seg), F.lit(".example/job?id="), k)
    wrapped = F.concat(F.lit("https://click.example/go?u=1&url="), F.url_encode(link))
    stored = _one_of(k, [F.lit('["structured query", "java", "gone", "java"]'), F.lit("not json"), F.lit('["sql"]')])
    title = F.concat(F.lit("Senior "), seg, F.lit(" Cook - night shift (casual)"))
    asked = F.when(k % 2 == 0, "who needs Data Science now").otherwise("data entry")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        tx.attribution_verdict(advertiser, employer).alias("verdict"),
        (tx.near_miss(advertiser, employer) & ~tx.advertiser_matches(advertiser, employer)).alias("near"),
        tx.substring_only(seg, advertiser).alias("inside"),
        (tx.mentions(F.concat(F.lit("News: "), advertiser, F.lit("!")), seg) & (k % 7 != 6)).alias("mentioned"),
        tx.place_to_hub(spot, needles, "home", ["homeland"]).alias("hub"),
        tx.hiring_area(F.concat(seg, F.lit(" Jobs")), areas).alias("area"),
        tx.unwrapped_url(wrapped).alias("link"),
        tx.url_host(tx.unwrapped_url(wrapped)).alias("host"),
        tx.search_phrases(seg, F.array(F.lower(seg), F.format_string("Brand %s", (k % 3).cast("string")), F.lit(" "))).alias("phrases"),
        tx.stored_skills(stored, {"structured query": "sql"}, ["sql", "java"]).alias("skills"),
        tx.longest_contained(asked, ["data", "data science"]).alias("longest"),
        tx.title_head(title).alias("head"),
    )


@query(f"""WITH {ADS}, old AS (SELECT * FROM ads WHERE hash(1) IS NOT NULL AND first_seen < DATE '2001-01-01'), b AS (SELECT *, CASE WHEN length(title) % 2 = 0 THEN first_seen ELSE DATE '2001-07-31' END AS d FROM ads WHERE first_seen >= DATE '2000-12-01')
SELECT job_key, min(f) AS first_seen, max(l) AS last_seen, sum(n)::INT AS seen_count FROM (SELECT job_key, first_seen AS f, last_seen AS l, 1 AS n FROM old UNION ALL SELECT job_key, d, d, 1 FROM b) GROUP BY job_key""", days="first_seen last_seen")
def back_catalogue(spark, sf_dir):
    """A back catalogue merged in: rows begin and end on their posting day, or today where none is stated."""
    rows = ads(spark, sf_dir).select("job_key", "title", "first_seen", "last_seen").withColumn("posted", F.when(F.length("title") % 2 == 0, F.concat(F.col("first_seen").cast("string"), F.lit("T08:00"))).otherwise("recently"))
    old = rows.where("first_seen < DATE '2001-01-01'").withColumn("seen_count", F.lit(1))
    merged = archive.back_catalogue(old, rows.where("first_seen >= DATE '2000-12-01'").drop("first_seen", "last_seen"), AS_OF)
    return merged.select("job_key", "first_seen", "last_seen", F.col("seen_count").cast("int").alias("seen_count"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS source FROM supplier""")
def kept_fields(spark, sf_dir):
    """Fresh fields that aren't empty replace stored ones; of two feeds the later one wins a key."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    fresh = s.select("k", F.when(F.col("k") % 3 == 0, F.concat(F.lit("new "), "name")).otherwise(" ").alias("name"), F.when(F.col("k") % 4 == 0, F.col("balance") + 1).alias("balance"))
    first, second = s.select("k", F.lit(1).alias("source")), s.where("k % 5 = 0").select("k", F.lit(2).alias("source"))
    return archive.filled_from(fresh, s, "k").join(pages.feeds_by_priority([second, first], ["k"]), "k")


@query(f"""WITH {ADS} SELECT 'company' AS scope, count(*) AS n FROM ads WHERE company_id = 7 UNION ALL SELECT 'hubs', count(*) FROM ads WHERE hub IN ('NATION_1', 'NATION_2') UNION ALL SELECT 'none', 0 UNION ALL SELECT 'world', count(*) FROM ads
UNION ALL SELECT 'sector', count(*) FROM ads WHERE company_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 50)
UNION ALL SELECT 'recent', count(*) FROM ads WHERE last_seen >= DATE '2001-07-31' - 30""")
def scope_counts(spark, sf_dir):
    """Rows in the scope of a company, of hubs, of no hub, of the world, and of a sector's companies; and of a window asked for in vain."""
    rows = ads(spark, sf_dir)
    sector = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey < 50").select(F.col("c_custkey").alias("company_id"))
    window = roster.window_days(31)  # not on offer, so 30
    kinds = {
        "company": rows.where(archive.in_scope("company", "7")),
        "hubs": rows.where(archive.in_scope("city", hubs=["nation_1", "NATION_2"])),
        "none": rows.where(archive.in_scope("city", hubs=[])),
        "world": rows.where(archive.in_scope("world")),
        "sector": rows.where(archive.in_scope("world")).join(sector, "company_id", "left_semi"),
        "recent": rows.where(F.col("last_seen") >= F.date_sub(F.lit(AS_OF), window)),
    }
    whole = None
    for name, df in kinds.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("scope"), "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole


@query("""SELECT r_name AS feed, n_name || ' & more' AS title, 'https://' || lower(n_name) || '.example/?a=1' AS link, CASE WHEN n_nationkey % 2 = 0 THEN 'Mon' ELSE '' END AS published FROM nation JOIN region ON n_regionkey = r_regionkey""")
def rss_feeds(spark, sf_dir):
    """Items of feeds: wrapped links opened, references and CDATA read."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows by the data model
    target = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/?a=1"))
    link = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("https://wrap.example/r?url="), F.url_encode(target))).otherwise(target)
    title = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<![CDATA["), "n_name", F.lit(" & more]]>"))).otherwise(F.concat("n_name", F.lit(" &amp; <i>more</i>")))
    date = F.when(F.col("n_nationkey") % 2 == 0, "<pubDate>Mon</pubDate>").otherwise("")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link>"), date, F.lit("</item>"))
    feeds = n.groupBy(F.col("r_name").alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("xml"))
    return pages.rss_items(feeds)


@query("""SELECT 'R' || (p_partkey // 20 % 5) AS geo, 'T' || (p_partkey % 20 // 4) AS time, 'O' || (p_partkey % 4) AS job, p_retailprice AS value FROM part WHERE p_partkey < 100 OR p_partkey >= 100""")
def flat_cubes(spark, sf_dir):
    """Cells of flat cubes by their codes: a cube of 5 by 5 by 4 per hundred parts."""
    values = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("index"), F.col("p_retailprice").alias("value"))
    return pages.json_stat(values, [("geo", [f"R{i}" for i in range(5)]), ("time", [f"T{i}" for i in range(5)]), ("job", [f"O{i}" for i in range(4)])])


@query("""WITH p AS (SELECT c_custkey AS k, 'Role ' || (c_custkey % 50) AS title, c_mktsegment AS company, 'Place ' || (c_custkey % 3) AS location FROM customer WHERE c_custkey % 7 > 1)
SELECT DISTINCT 'portal-acme|' || lower(title) || '|' || lower(company) || '|' || lower(location) AS job_key, 'portal-acme' AS source, title FROM p""")
def portal_feed(spark, sf_dir):
    """A portal's rows as advertisements; rows without a title or a link are dropped, each key once."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("Role "), k % 50)).alias("title"), F.col("c_mktsegment").alias("company"), F.concat(F.lit("Place "), k % 3).alias("location"), F.when(k % 7 == 1, "").otherwise("/j").alias("url"), F.lit(None).cast("string").alias("posted"))
    return paged.portal_rows(rows, "acme").select("job_key", "source", "title")


@query("""WITH d AS (SELECT s_nationkey AS k, s_suppkey AS i, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS price FROM supplier), f AS (
  SELECT k, i, price, count(price) OVER (PARTITION BY k) AS exact, last_value(price IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS back, first_value(price IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM d)
SELECT k, i, coalesce(back, ahead) AS filled FROM f WHERE exact >= 2""")
def carried_prices(spark, sf_dir):
    """Days with the last price at or before them; groups with fewer than two priced days are left out."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("day"), F.col("s_acctbal").alias("price"))
    return series.priced_days(s.where("day % 3 = 0"), s.drop("price"), ["k"]).select("k", F.col("day").alias("i"), "filled")
