"""Rosters: what two of them share, which advertisers are whom, which cities and rows a filter or a role leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import roster
from .fixture import ADS, LIVE, ads, exploded, table
from .registry import query

# What boards print where an employer's name should stand.
NO_EMPLOYER = r"(?i)^(job details|job alerts?|jobs?|subscribe( to job alerts?)?|apply( now)?|click here|view (all )?jobs?|see (all )?jobs?|more jobs?|load more|read more|search jobs?|next page|previous page|back to (search|results)|all jobs|vacancies|position details)$"


@query("""WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_nationkey < 20), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 > 0)
SELECT k, 'missing' AS side FROM (SELECT k FROM e EXCEPT SELECT k FROM f) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM f EXCEPT SELECT k FROM e)""")
def roster_difference(spark, sf_dir):
    """Employers of a roster that the feed lacks, and the feed's that the roster lacks."""
    expected = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"))
    found = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("k"))
    return roster.roster_difference(expected, found, "k")


@query("""SELECT n_name AS city FROM nation WHERE n_nationkey = 5 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500 AND c_nationkey <> 5)""")
def cities_shown(spark, sf_dir):
    """Cities with an employer that passes; the one without a roster stays."""
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("city"))
    employers = table(spark, sf_dir, "customer").where("c_nationkey <> 5").join(F.broadcast(places), F.col("c_nationkey") == F.col("key"))  # 25 rows by the data model
    return roster.cities_shown(places.select("city"), employers.select("city", "c_acctbal"), F.col("c_acctbal") > 9500)


@query("""WITH c AS (SELECT c_custkey, count(*) OVER () AS n FROM customer) SELECT c_custkey, c_custkey % 4 = 1 AS in_slice, (c_custkey + 5) % n < 10 AS at_cursor FROM c WHERE c_custkey % 4 = 1 OR (c_custkey + 5) % n < 10""")
def turns(spark, sf_dir):
    """A quarter of the roster in turn, and ten places from a cursor that goes round at the end."""
    all_of = table(spark, sf_dir, "customer").select("c_custkey")
    n = all_of.count()
    part = roster.in_turn(all_of, "c_custkey", 4, 1).withColumn("in_slice", F.lit(True))
    here = roster.from_cursor(all_of, "c_custkey", n, n - 5, 10)[0].withColumn("at_cursor", F.lit(True))
    return part.join(here, "c_custkey", "full_outer").select("c_custkey", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_slice", "at_cursor")])


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SAME = "({0} = {1} OR starts_with({0}, {1} || ' ') OR starts_with({1}, {0} || ' ')) AND {0} <> '' AND {1} <> ''"


@query(rf"""WITH c AS (SELECT c_custkey AS row_id, c_mktsegment AS target_id, c_mktsegment AS target_name, CASE WHEN c_custkey % 16 IN (4, 11) THEN 'Boral' END AS searched_as,
    CASE c_custkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'Job Alerts' WHEN 2 THEN '!!!' WHEN 3 THEN 'Brand 3' WHEN 4 THEN c_mktsegment || ' Group' WHEN 5 THEN 'In' || lower(c_mktsegment) || 'go' WHEN 6 THEN 'MACHINERY Parts' ELSE c_mktsegment END AS advertiser FROM customer),
n AS (SELECT *, {_NORM.format("advertiser")} AS a, {_NORM.format("coalesce(searched_as, target_name)")} AS x, {_NORM.format("target_name")} AS t FROM c), r AS (SELECT DISTINCT c_mktsegment AS id, {_NORM.format("c_mktsegment")} AS b FROM customer)
SELECT row_id, advertiser, CASE WHEN trim(advertiser) = '' THEN 'keep' WHEN lower(advertiser) = 'job alerts' THEN 'no employer' WHEN a = '' THEN 'empty' WHEN target_id = 'AUTOMOBILE' AND a = 'brand 3' THEN 'denied'
  WHEN NOT contains(' ' || a || ' ', ' ' || x || ' ') AND contains(a, x) AND len(x) >= 2 THEN 'inside a word'
  WHEN NOT ({_SAME.format("a", "x")}) AND EXISTS (SELECT 1 FROM r WHERE r.id <> target_id AND {_SAME.format("a", "r.b")}) THEN 'another company'
  WHEN x <> t AND NOT ({_SAME.format("a", "x")}) AND NOT contains(' ' || a || ' ', ' ' || x || ' ') AND NOT ({_SAME.format("a", "t")}) THEN 'unlike the search' ELSE 'keep' END AS verdict FROM n""")
def advertiser_verdicts(spark, sf_dir):
    """Each rule of the advertiser check on names made to meet it."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    names = [" ", "Job Alerts", "!!!", "Brand 3", F.concat(segment, F.lit(" Group")), F.concat(F.lit("In"), F.lower(segment), F.lit("go")), "MACHINERY Parts", segment]
    made = F.get(F.array(*[F.lit(n) if isinstance(n, str) else n for n in names]), (k % 8).cast("int"))
    customers = table(spark, sf_dir, "customer")
    rows = customers.select(k.alias("row_id"), segment.alias("target_id"), segment.alias("target_name"), F.when((k % 16).isin(4, 11), "Boral").alias("searched_as"), made.alias("advertiser"))
    known = customers.select(segment.alias("id"), segment.alias("name")).distinct()
    denied = spark.createDataFrame([("AUTOMOBILE", "Brand 3")], "id string, advertiser string")
    return roster.checked_advertisers(rows, known, denied, NO_EMPLOYER).select("row_id", "advertiser", "verdict")


@query("""WITH e AS (SELECT p_partkey AS ordinal, string_split(p_name, ' ')[2] AS skill, p_type AS cat, string_split(p_name, ' ')[1] AS term, CASE WHEN p_size > 40 THEN p_brand END AS ex FROM part),
t AS (SELECT skill, term, min(ordinal) AS o FROM e GROUP BY ALL), x AS (SELECT skill, ex, min(ordinal) AS o FROM e WHERE ex IS NOT NULL GROUP BY ALL)
SELECT e.skill, arg_min(cat, ordinal) AS cat, any_value(tt.terms) AS terms, coalesce(any_value(xx.excepts), '') AS excepts, count(DISTINCT cat) > 1 AS conflict FROM e
JOIN (SELECT skill, string_agg(term, ',' ORDER BY o) AS terms FROM t GROUP BY skill) tt USING (skill) LEFT JOIN (SELECT skill, string_agg(ex, ',' ORDER BY o) AS excepts FROM x GROUP BY skill) xx USING (skill) GROUP BY e.skill""")
def merged_taxonomy(spark, sf_dir):
    """Skills declared more than once: first category, united terms and exceptions, conflicts marked."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    excepts = F.when(F.col("p_size") > 40, F.array("p_brand"))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), word(2).alias("skill"), F.col("p_type").alias("cat"), F.array(word(1)).alias("terms"), excepts.alias("excepts"))
    return roster.merged_taxonomy(entries).select("skill", "cat", F.array_join("terms", ",").alias("terms"), F.array_join("excepts", ",").alias("excepts"), "conflict")


@query(f"WITH {ADS} SELECT job_key FROM ads WHERE hub IN (SELECT n_name FROM nation WHERE n_regionkey = 2) OR company_id % 10 = 0")
def released_rows(spark, sf_dir):
    """What a caller who doesn't see every market sees: rows of released hubs, or of companies plotted in one."""
    rows = ads(spark, sf_dir)
    hubs = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("hub"))
    companies = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("company_id"))
    return roster.for_role(rows, False, hubs, companies).select("job_key")


@query(f"""{LIVE}, ex AS (SELECT unnest(list_distinct(skills)) AS skill, hub FROM live WHERE company_id % 5 = 0), n AS (SELECT skill, nullif(hub, (SELECT min(n_name) FROM nation)) AS hub FROM ex)
SELECT skill, count(*) AS n, count(*) FILTER (hub IS NULL) AS hubless, count(DISTINCT hub) AS hubs FROM n GROUP BY skill""")
def hubless_remainder(spark, sf_dir):
    """A skill's live advertisements, those without a hub counted apart and never as a hub."""
    from .market import _live

    blank = table(spark, sf_dir, "nation").agg(F.min("n_name").alias("none"))
    rows = exploded(_live(spark, sf_dir).where("company_id % 5 = 0")).join(F.broadcast(blank)).withColumn("hub", F.nullif("hub", F.col("none")))  # one row
    return rows.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hub").isNull()).alias("hubless"), F.countDistinct("hub").alias("hubs"))


@query("""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer WHERE contains(lower(c_name), '00000001') OR contains(lower(c_mktsegment), '00000001')""")
def employers_by_text(spark, sf_dir):
    """Employers whose name or tags hold the query."""
    from ..operators.search import matches_text

    c = table(spark, sf_dir, "customer")
    return c.where(matches_text(F.lit(" 00000001 "), [F.col("c_name")], [F.array("c_mktsegment")])).select("c_custkey", tx.slug(F.col("c_name")).alias("slug"))
