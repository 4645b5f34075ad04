"""News of employers: blocked publishers, feeds by preference, articles that name other employers, posts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def blocked(url: Column, publisher: Column, hosts: list[str], labels: list[str]) -> Column:
    """The article's host is one of the hosts or below it, or its publisher's label holds one of the labels.

    A missing url is judged by the label alone, and the other way round.
    """
    host = F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))
    label = F.lower(F.coalesce(publisher, F.lit("")))
    found = F.lit(False)
    for h in hosts:
        found = found | (host == h) | host.endswith("." + h)
    for text in labels:
        found = found | label.contains(text)
    return found


def newest(items: DataFrame, key: str, cap: int) -> DataFrame:
    """The newest ``cap`` items (published, url) per key; undated ones last."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("published"), "url")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def company_feed(items: DataFrame, cross: DataFrame, cap: int) -> DataFrame:
    """(company_id, url, published, place): a company's own items of the first kind it has any of, with the
    articles elsewhere that name it, each url once, newest first.

    ``items`` has company_id, kind (a number, less is preferred), url and published;
    ``cross`` the same without kind.  Of items that share a url the company's own counts,
    and of several own ones the newest.
    """
    best = Window.partitionBy("company_id")
    own = items.withColumn("first", F.min("kind").over(best)).where(F.col("kind") == F.col("first")).select("company_id", "url", "published", F.lit(0).alias("side"))
    every = own.unionByName(cross.select("company_id", "url", "published", F.lit(1).alias("side")))
    once = every.groupBy("company_id", "url").agg(F.min_by("published", F.struct("side", F.negative(F.unix_date("published")))).alias("published"))
    return newest(once, "company_id", cap)


def mention_index(articles: DataFrame, roster: DataFrame, as_of: date, days: int = 7, cap: int = 6) -> DataFrame:
    """(name, article, published, place): per roster name its newest articles of some days whose title holds
    the name as whole words, articles about the name's own company left out.

    ``articles`` has article, title, own and published; ``roster`` name.  Titles are
    joined on a name's first word and then held against its other words; names of
    fewer than three characters never count.  An undated article stays.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    fresh = articles.where(F.col("published").isNull() | (F.datediff(F.lit(as_of), "published") <= days))
    names = roster.where(F.length(F.trim("name")) >= 3).select("name").distinct().withColumn("nw", words("name")).where(F.size("nw") > 0).withColumn("w", F.get("nw", F.lit(0)))
    placed = fresh.select("article", "own", "published", words("title").alias("ws")).select("*", F.posexplode("ws").alias("at", "w"))
    hits = placed.join(names, "w").where((F.slice("ws", F.col("at") + 1, F.size("nw")) == F.col("nw")) & ~F.col("own").eqNullSafe(F.col("name")))
    found = hits.select("name", F.col("article").alias("url"), "published").distinct()
    return newest(found, "name", cap).withColumnRenamed("url", "article")


def recent_posts(posts: DataFrame, as_of: date, limit: int = 4, days: int = 120) -> DataFrame:
    """A company's newest posts of some days; of these only ones with a title and a url.

    ``limit`` is held between 1 and 10, and counts before posts without title or url go.
    """
    cap = min(max(limit, 1), 10)
    fresh = posts.where((F.datediff(F.lit(as_of), "published") <= days) & F.col("company_id").isNotNull())
    return newest(fresh, "company_id", cap).where(tx.blank_to_null(F.col("title")).isNotNull() & tx.blank_to_null(F.col("url")).isNotNull())
