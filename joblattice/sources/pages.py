"""Readers: vacancies out of pages, RSS items, JSON-stat cubes, feeds with priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import loose_date
from ..operators.cutting import cut
from .embedded import MAX_TITLE, MIN_TITLE, vacancies

REACH = 1200
# What screen readers are told about a card's links, and what labels stand before a field's value.
ARIA = r"(?s)^\s*([A-Za-z ]{3,20})\s*:\s*(.+?)\s+for\s+(.+?)\s*$"
ARIA_FIELDS = {
    "agency": ["organization", "organisation", "agency", "department", "employer", "cluster"],
    "loc": ["location", "region"],
    "salary": ["salary", "remuneration"],
    "close": ["closing date", "closes"],
    "posted": ["posted date", "posting date", "date posted", "published date"],
}
LABELS = {
    "agency": ["organisation", "organization", "agency", "department", "cluster", "employer"],
    "loc": ["location", "region"],
    "salary": ["salary", "remuneration"],
    "close": [r"closing(?:\s+date)?", r"closes(?:\s+on)?"],
    "posted": [r"posted(?:\s+date)?", r"posting\s+date", r"date\s+posted", r"published(?:\s+date)?", r"advertised(?:\s+date)?"],
}
NAME_INITIAL = ["department"]
COLUMNS = ["title", "agency", "loc", "url", "salary", "close", "posted", "id"]


def embedded_json(pages: DataFrame) -> DataFrame:
    """(doc_id, part, text): the texts in a page (page_id, html) that should be JSON: streamed chunks, state and posting scripts, assignments."""
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    chunks = F.transform(every(r'__next_f\.push\(\s*\[\s*\d+\s*,\s*"((?:[^"\\]|\\.)*+)"'), lambda x: F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string"))
    scripts = [every(rf'(?is)<script[^>]+{mark}[^>]*>(.*?)</script>') for mark in ('id="__NEXT_DATA__"', 'type="application/json"', r'type="application/ld\+json"')]
    assigned = every(r"(?s)=\s*(\{.{200,}?\})\s*;?\s*</script>")
    return pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.concat(chunks, *scripts, assigned)).alias("part", "text"))


def labelled(block: Column, labels: list[str]) -> Column:
    """The first labelled value in a block's text, else ''.

    Without a mark between them, a label that begins many employers' names is part of the value.
    """
    rule = []
    for label in labels:
        pattern = rf"(?i)({label})(\s*[:\-–—]\s*|\s+)([^|\n]{{2,70}})"
        value = F.trim(F.regexp_extract(block, pattern, 3))
        if label in NAME_INITIAL:
            apart = F.regexp_extract(block, pattern, 2).rlike(r"[:\-–—]")
            value = F.when(apart | (value == ""), value).otherwise(F.concat_ws(" ", F.regexp_extract(block, pattern, 1), value))
        rule.append(F.nullif(value, F.lit("")))
    return F.coalesce(*rule, F.lit(""))


def job_links(pages: DataFrame, href: str) -> DataFrame:
    """(page_id, start, stop, href, marks, inner): a page's links to vacancies, by their places in the html, from 0.

    A link's row holds the link and the length of what stands before it; the rest of the html is sorted nowhere.
    """
    link = rf'<a\b[^>]*?href="[^"]*{href}[^"]*"[^>]*>.*?</a>'
    between = F.transform(F.split("html", rf"(?is){link}"), lambda s: F.length(s))
    pieces = F.transform(F.regexp_extract_all("html", F.lit(rf"(?is){link}"), F.lit(0)), lambda s, i: F.struct(F.get(between, i).alias("gap"), s.alias("piece")))
    rows = pages.select("page_id", F.posexplode(pieces).alias("i", "p")).select("page_id", "i", "p.gap", "p.piece")
    by = Window.partitionBy("page_id").orderBy("i")
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.length("piece")).over(by))
    inside = rf'(?is)^<a\b([^>]*?)href="([^"]*{href}[^"]*)"([^>]*)>(.*?)</a>$'
    part = lambda k: F.regexp_extract("piece", inside, k)
    return placed.where(F.col("piece").rlike(inside)).select("page_id", (F.col("stop") - F.length("piece")).alias("start"), "stop", part(2).alias("href"), F.concat(part(1), part(3)).alias("marks"), part(4).alias("inner"))


def _absolute(href: str, site: str) -> Column:
    """A link's address on a site."""
    return F.when(F.col(href).startswith("/"), F.concat(F.lit(site.rstrip("/")), href)).otherwise(F.col(href))


def _block(start: str, stop: str) -> Column:
    """The text of a page's html around a stretch."""
    first = F.greatest(F.lit(0), F.col(start) - REACH)
    return tx.strip_html(F.substring("html", first + 1, F.col(stop) + REACH - first))


def job_cards(pages: DataFrame, href: str = r"/job/[\w-]+", site: str = "") -> DataFrame:
    """One row per page and vacancy link, put together from all links that lead there.

    A link read out as "Organization: X for Y" gives a field and the title; another
    one gives the title by its label or text.  What the links don't say is looked for
    in the text within 1,200 characters of them.
    """
    links = job_links(pages, href)
    said = F.regexp_extract("marks", r'aria-label="([^"]*)"', 1)
    rows = links.withColumn("label", tx.strip_html(said)).withColumn("field", F.lower(F.trim(F.regexp_extract("label", ARIA, 1)))).withColumn("text", tx.strip_html(F.col("inner")))
    fits = lambda c: F.length(c).between(MIN_TITLE, MAX_TITLE)
    told = F.col("field") != ""
    plain = F.when(~F.col("label").contains(":") & fits("label"), F.col("label"))
    title = F.when(told, F.trim(F.regexp_extract("label", ARIA, 3))).otherwise(F.coalesce(plain, F.when(fits("text"), F.col("text"))))
    value = F.nullif(F.trim(F.regexp_extract("label", ARIA, 2)), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("start")))
    fields = [first(F.when(F.col("field").isin(names), value)).alias(f) for f, names in ARIA_FIELDS.items()]
    cards = rows.groupBy("page_id", "href").agg(first(title).alias("title"), *fields, F.min("start").alias("place"), F.min(F.when(~told, F.col("start"))).alias("start"), F.max(F.when(~told, F.col("stop"))).alias("stop"))
    poor = F.col("start").isNotNull() & (F.col("agency").isNull() | F.col("loc").isNull())
    near = pages.select("page_id", "html").join(cards.hint("shuffle_hash"), "page_id").withColumn("block", F.when(poor, _block("start", "stop"))).drop("html")
    filled = {f: F.coalesce(F.col(f), labelled(F.col("block"), names), F.lit("")) for f, names in LABELS.items()}
    posted = loose_date(filled.pop("posted"))
    number = F.regexp_extract("href", r"-(\d{3,})(?:[/?#]|$)", 1)
    return near.where(fits("title")).select("page_id", "place", "title", *[c.alias(f) for f, c in filled.items()], _absolute("href", site).alias("url"), posted.alias("posted"), number.alias("id"))


def job_anchors(pages: DataFrame, href: str = r"/job/[\w-]+", site: str = "") -> DataFrame:
    """One row per page and link text, with what the text around the link says: the last resort."""
    links = job_links(pages, href).withColumn("title", tx.strip_html(F.col("inner"))).where(F.length("title").between(MIN_TITLE, MAX_TITLE))
    once = links.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", F.lower("title")).orderBy("start"))).where("nth = 1")
    near = once.join(pages.select("page_id", "html"), "page_id").withColumn("block", _block("start", "stop")).drop("html")
    found = {f: labelled(F.col("block"), names) for f, names in LABELS.items()}
    posted = loose_date(found.pop("posted"))
    return near.select("page_id", F.col("start").alias("place"), "title", *[c.alias(f) for f, c in found.items()], _absolute("href", site).alias("url"), posted.alias("posted"), F.lit("").alias("id"))


def extract_jobs(pages: DataFrame, href: str = r"/job/[\w-]+", site: str = "") -> DataFrame:
    """The vacancies of pages (page_id, html) and the strategy that found a page's: embedded JSON or job cards,
    whichever finds more (JSON if equal), and single links only where neither finds any.

    ``page_id`` is unique; null pages give no rows.
    """
    cards = cut(job_cards(pages, href, site).withColumn("strategy", F.lit("job-cards")))
    json = cut(vacancies(embedded_json(pages), double_encoded=False).withColumnRenamed("doc_id", "page_id").withColumn("strategy", F.lit("embedded-json")))
    n = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    both = n(json, "n_json").join(n(cards, "n_cards"), "page_id", "full_outer")
    winner = both.select("page_id", F.when(F.coalesce("n_json", F.lit(0)) >= F.coalesce("n_cards", F.lit(0)), "embedded-json").otherwise("job-cards").alias("strategy"))
    best = json.select("page_id", *COLUMNS, "strategy").unionByName(cards.select("page_id", *COLUMNS, "strategy")).join(winner, ["page_id", "strategy"], "left_semi")
    rest = job_anchors(pages.join(winner.hint("shuffle_hash"), "page_id", "left_anti"), href, site).withColumn("strategy", F.lit("dom-anchors"))
    return best.unionByName(rest.select("page_id", *COLUMNS, "strategy"))


def rss_items(feeds: DataFrame) -> DataFrame:
    """(feed, title, link, published) of RSS texts; wrapped links are unwrapped."""
    item = feeds.select("feed", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("i"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    return item.select("feed", tx.strip_html(tag("title")).alias("title"), tx.unwrapped_url(tag("link")).alias("link"), tag("pubDate").alias("published"))


def json_stat(values: DataFrame, sizes: list[tuple[str, list[str]]]) -> DataFrame:
    """(index, value) of a flat cube with a column per dimension, given each dimension's codes in order."""
    stride, out = 1, []
    for name, codes in reversed(sizes):
        at = (F.floor(F.col("index") / stride) % len(codes)).cast("int")
        out.append(F.element_at(F.array(*[F.lit(c) for c in codes]), at + 1).alias(name))
        stride *= len(codes)
    return values.select(*reversed(out), "value")


def feeds_by_priority(feeds: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several feeds, each key once, from the first feed that has it."""
    whole = feeds[0].withColumn("priority", F.lit(0))
    for i, feed in enumerate(feeds[1:], 1):
        whole = whole.unionByName(feed.withColumn("priority", F.lit(i)))
    first = Window.partitionBy(*key).orderBy("priority")
    return whole.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "priority")
