"""Queries over pages and over JSON bodies made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as js
from ..sources import embedded
from ..sources.pages import extract_jobs
from .fixture import ADS, ads, table
from .registry import query


def _told(shape: str, *args: Column) -> Column:
    return F.format_string(shape, *args)


def _card(j: Column) -> Column:
    """A vacancy as links with what screen readers are told, the third one of a page as text far from all else."""
    link = _told("/job/role-%d", j["p_partkey"] + 1000)
    aria = F.concat(
        _told('<a href="%s" aria-label="Organization: %s for %s">x</a>', link, j["p_brand"], j["p_name"]),
        _told('<a class="c" href="%s" aria-label="Location: %s for %s">y</a><a href="%s">%s &amp; more</a>', link, j["p_type"], j["p_name"], link, j["p_name"]),
    )
    bare = _told('<div><a href="%s"><b>%s</b> opening</a><p>Organisation: %s | Salary: $%d | Location: %s | Posted: 3 March 2020 | </p></div>', link, j["p_name"], j["p_brand"], j["p_size"], j["p_type"])
    return F.when(j["k"] == 2, F.concat(F.lit("<p>" + "." * 1300 + "</p>"), bare, F.lit("<p>" + "." * 1300 + "</p>"))).otherwise(aria)


def _item(j: Column) -> Column:
    return F.struct(j["p_name"].alias("jobTitle"), F.struct(j["p_type"].alias("label")).alias("location"), j["p_brand"].alias("Agency__c"), F.lit("2020-03-03T00:00").alias("postedDate"), F.concat(F.lit("J"), j["p_partkey"] % 2).alias("id"))


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each followed by up to three vacancies, as cards, as state, as streamed chunks, or as both with more cards.

    Only vacancies of a page that is there are gathered, as fields; they become html beside their page.
    """
    pages = table(spark, sf_dir, "pages")
    fields = ["k", "p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    part = table(spark, sf_dir, "part").withColumn("page_id", F.floor(F.col("p_partkey") / 3)).withColumn("k", F.col("p_partkey") % 3).select("page_id", *fields)
    shown_parts = part.join(pages.select("page_id"), "page_id", "left_semi")
    by_page = shown_parts.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("jobs"))  # three at most
    cards = F.array_join(F.transform("jobs", _card), "")
    state = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("id"), F.lit("Sydney Region").alias("name"))).alias("facets"), F.struct(F.transform("jobs", _item).alias("list")).alias("results")))
    one = F.to_json(F.struct(F.transform(F.slice("jobs", 1, 1), _item).alias("list")))
    script = lambda body: F.concat(F.lit('<script type="application/json">'), body, F.lit("</script>"))
    chunk = F.concat(F.lit('<script>self.__next_f.push([1,"'), F.regexp_replace(F.concat(F.lit("7:"), state, F.lit("\n")), r'(["\\])', r"\\$1"), F.lit('"])</script>'))
    chunk = F.replace(chunk, F.lit("\n"), F.lit("\\n"))
    shown = F.when(F.col("page_id") % 4 == 0, cards).when(F.col("page_id") % 4 == 1, script(state)).when(F.col("page_id") % 4 == 2, chunk).otherwise(F.concat(script(one), cards))
    return pages.join(by_page.hint("shuffle_hash"), "page_id", "left").select("page_id", F.concat("html", F.when(F.col("jobs").isNull(), "").otherwise(shown)).alias("html"))


@query("""WITH j AS (
  SELECT p_partkey // 3 AS page_id, p_partkey % 3 AS k, p_partkey AS pk, p_name AS n, p_brand AS b, p_type AS t, p_size AS z FROM part JOIN pages ON page_id = p_partkey // 3
), s AS (
  SELECT *, CASE WHEN page_id % 4 IN (1, 2) OR page_id % 4 = 3 AND count(*) OVER (PARTITION BY page_id) = 1 THEN 'embedded-json' ELSE 'job-cards' END AS strategy FROM j
), state AS (
  SELECT * FROM s WHERE strategy = 'embedded-json' QUALIFY row_number() OVER (PARTITION BY page_id, lower(n), pk % 2, lower(t) ORDER BY k) = 1
)
SELECT page_id, n AS title, b AS agency, t AS loc, '' AS url, '' AS salary, '' AS close, '2020-03-03' AS posted, 'J' || (pk % 2) AS id, strategy FROM state
UNION ALL
SELECT page_id, CASE WHEN k = 2 THEN n || ' opening' ELSE n END, b, t, 'https://board.example/job/role-' || (pk + 1000), CASE WHEN k = 2 THEN '$' || z ELSE '' END, '', CASE WHEN k = 2 THEN '2020-03-03' END, (pk + 1000)::VARCHAR, strategy FROM s WHERE strategy = 'job-cards'""", days="posted")
def page_extract(spark, sf_dir):
    """The vacancies that pages show: embedded JSON or grouped cards, whichever finds more."""
    return extract_jobs(_boards(spark, sf_dir), site="https://board.example/")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON body per order: its lines as vacancies among other records, plain, guarded and double-encoded, wrapped in a call, or in bare lists."""
    rows = ads(spark, sf_dir).select(F.split("job_key", "-").alias("key"), "title", "company", "hub", "category", F.col("salary").cast("int").alias("pay"))
    line = rows.select(F.col("key")[0].cast("long").alias("doc_id"), F.transform(F.slice("key", 2, 3), lambda x: x.cast("int")).alias("n"), F.struct(F.col("title").alias("Job Title"), F.struct(F.col("company").alias("displayValue")).alias("employer"), F.array("hub").alias("work_location"), F.format_string("$%d", "pay").alias("salary"), (F.col("key")[2].cast("int") % 2).alias("Vacancy_Id__c")).alias("job"))
    by_order = line.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", F.to_json("job").alias("job")))).alias("jobs"))  # seven lines at most
    jobs = F.concat(F.lit("["), F.array_join(F.transform("jobs", lambda j: j["job"]), ","), F.lit("]"))
    state = F.concat(F.lit('{"facets":[{"id":1,"name":"Sydney Region"},{"id":2,"name":"Job alerts"}],"page":{"deep":{"er":{"results":'), jobs, F.lit('}},"title":"Search results","href":"/x"}}'))
    twice = F.concat(F.lit('while(1);{"actions":[{"state":"OK","returnValue":'), F.to_json(F.struct(state.alias("s"))).substr(F.lit(6), F.lit(1 << 30)), F.lit("]}"))
    twice = F.regexp_replace(twice, r"\}\]\}$", "}]}")
    kinds = [state, twice, F.concat(F.lit('say("{ hello");callback('), state, F.lit(') {"open": "')), F.concat(F.lit(")]}',[["), jobs, F.lit(",[]],3]"))]
    text = F.when(F.col("doc_id") % 4 == 0, kinds[0])  # of the four only the one that is shown is written
    for i, kind in enumerate(kinds[1:], 1):
        text = text.when(F.col("doc_id") % 4 == i, kind)
    return by_order.select("doc_id", text.alias("text"))


@query(f"""WITH {ADS}, j AS (SELECT split_part(job_key, '-', 1)::BIGINT AS doc_id, [split_part(job_key, '-', k)::INT for k in [2, 3, 4]] AS n, title, company AS agency, hub AS loc, '$' || trunc(salary)::INT AS salary, (split_part(job_key, '-', 3)::INT % 2)::VARCHAR AS id FROM ads)
SELECT doc_id, title, agency, loc, salary, id FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title), id, lower(loc) ORDER BY n) = 1""")
def body_vacancies(spark, sf_dir):
    """Vacancies out of JSON bodies of unknown shape: nested, double-encoded, guarded, or in the middle of other text."""
    found = embedded.vacancies(_bodies(spark, sf_dir))
    return found.select("doc_id", "title", "agency", "loc", "salary", "id")


@query("""SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, count(loose) AS loose_numbers, sum(loose)::BIGINT AS loose_total, count(*) FILTER (shown <> '') AS shown FROM (
  SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_id % 4 = 1 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS loose, CASE WHEN event_id % 4 IN (1, 2) THEN 'x' ELSE '' END AS shown FROM events) GROUP BY event_type""")
def event_fields(spark, sf_dir):
    """Numbers and texts out of the events' properties, one of them of four different types."""
    k = F.get_json_object("props", "$.k")
    odd = F.get(F.array(F.lit("null"), F.concat(F.lit('" '), k, F.lit('"')), F.lit('{"a":[1]}'), F.lit('""')), (F.col("event_id") % 4).cast("int"))
    body = js.record(js.parsed(F.concat(F.lit('{"props":'), "props", F.lit(',"odd":'), odd, F.lit("}"))))
    rows = table(spark, sf_dir, "events").select("event_type", js.number(F.try_element_at(js.record(F.try_element_at(body, F.lit("props"))), F.lit("k"))).alias("k"), F.try_element_at(body, F.lit("odd")).alias("odd"))
    loose = js.number(F.col("odd"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("total"), F.count(loose).alias("loose_numbers"), F.sum(loose).cast("long").alias("loose_total"), F.count_if(js.text(F.col("odd")) != "").alias("shown"))
