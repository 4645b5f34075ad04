"""Employers in the news: pages stand for articles, documents for posts, advertisements' titles for headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news
from .fixture import ADS, AS_OF, EVENTS_AS_OF, ads, table
from .registry import query

_HOSTS, _LABELS = ["example.net"], ["blog"]
_ITEMS = r"""items AS (
  SELECT page_id, page_id % 7 AS company_id, CASE WHEN page_id % 7 IN (1, 2) THEN 1 + page_id % 2 ELSE page_id % 3 END AS kind, url, CASE WHEN page_id % 13 > 0 THEN DATE '2024-01-29' - (page_id % 45)::INT END AS published,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, lower(split_part(url, '/', 3)) AS publisher FROM pages
), judged AS (SELECT *, host = 'example.net' OR ends_with(host, '.example.net') OR contains(publisher, 'blog') AS blocked FROM items)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    kind = F.when((n % 7).isin(1, 2), 1 + n % 2).otherwise(n % 3)
    published = F.when(n % 13 > 0, F.date_sub(F.lit(EVENTS_AS_OF), (n % 45).cast("int")))
    return p.select("page_id", (n % 7).alias("company_id"), kind.alias("kind"), "url", published.alias("published"), news.blocked(F.col("url"), F.split_part("url", F.lit("/"), F.lit(3)), _HOSTS, _LABELS).alias("blocked"))


@query(f"WITH {_ITEMS} SELECT page_id, blocked FROM judged")
def blocked_articles(spark, sf_dir):
    return _items(spark, sf_dir).select("page_id", "blocked")


@query(
    f"""WITH {_ITEMS}, ok AS (SELECT * FROM judged WHERE NOT blocked), own AS (SELECT company_id, url, published, 0 AS side FROM ok QUALIFY kind = min(kind) OVER (PARTITION BY company_id)),
x AS (SELECT (page_id + 1) % 7 AS company_id, url, published, 1 AS side FROM ok WHERE page_id % 11 = 0), u AS (SELECT * FROM own UNION ALL SELECT * FROM x),
one AS (SELECT company_id, url, published FROM u QUALIFY row_number() OVER (PARTITION BY company_id, url ORDER BY side, published DESC NULLS LAST) = 1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published DESC NULLS LAST, url) AS place FROM one) WHERE place <= 6""",
    days="published",
)
def news_feed(spark, sf_dir):
    """Each company's articles of its best kind and those elsewhere that name it, without blocked publishers, six at most."""
    ok = _items(spark, sf_dir).where("NOT blocked")
    cross = ok.where("page_id % 11 = 0").select(((F.col("page_id") + 1) % 7).alias("company_id"), "url", "published")
    return news.company_feed(ok, cross, 6)


@query(
    f"""WITH {ADS}, a AS (SELECT job_key AS article, title, string_split(title, ' ')[1] AS own, first_seen AS published FROM ads WHERE first_seen <= DATE '2001-07-31' AND first_seen >= DATE '2001-07-24'),
r AS (SELECT DISTINCT unnest(skills) AS name FROM ads UNION SELECT title FROM ads), h AS (SELECT DISTINCT name, article, published FROM a JOIN r ON contains(' ' || title || ' ', ' ' || name || ' ') WHERE name <> own AND len(name) >= 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY published DESC, article) AS place FROM h) WHERE place <= 6""",
    days="published",
)
def mention_index(spark, sf_dir):
    """The newest six headlines of a week for every name of one or two words that they hold."""
    rows = ads(spark, sf_dir)
    articles = rows.where(F.col("first_seen") <= F.lit(AS_OF)).select(F.col("job_key").alias("article"), "title", F.get("skills", F.lit(0)).alias("own"), F.col("first_seen").alias("published"))
    told = rows.select("title", "skills").distinct()  # titles repeat, so words are cut from each once and the archive is read once
    names = told.select(F.explode(F.concat("skills", F.array("title"))).alias("name"))
    return news.mention_index(articles, names, AS_OF)


@query(
    """WITH p AS (SELECT doc_id % 5 AS company_id, CASE WHEN doc_id % 4 > 0 THEN lang ELSE ' ' END AS title, CASE WHEN doc_id % 9 > 0 THEN 'u' || doc_id END AS url, DATE '2024-01-29' - (doc_id % 200)::INT AS published FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published DESC, url NULLS FIRST) AS place FROM p WHERE published >= DATE '2024-01-29' - 120)
SELECT * FROM k WHERE place <= 10 AND trim(title) <> '' AND url IS NOT NULL""",
    days="published",
)
def recent_posts(spark, sf_dir):
    """A company's newest posts of 120 days; the asked limit of 12 is held at ten."""
    n = F.col("doc_id")
    posts = table(spark, sf_dir, "documents").select((n % 5).alias("company_id"), F.when(n % 4 > 0, F.col("lang")).otherwise(" ").alias("title"), F.when(n % 9 > 0, F.concat(F.lit("u"), n.cast("string"))).alias("url"), F.date_sub(F.lit(EVENTS_AS_OF), (n % 200).cast("int")).alias("published"))
    return news.recent_posts(posts, EVENTS_AS_OF, limit=12)
