"""The feeds' health: freshness, faults, overlap between sources, titles without a skill."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import archive, roster
from .fixture import ADS, AS_OF, LIVE, ads
from .registry import query


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads(spark, sf_dir).where(archive.live_feeds() & archive.live_on(AS_OF))


@query(f"""WITH {ADS} SELECT source, count(*) AS n_rows, min(first_seen) AS first_row, max(last_seen) AS last_pull, count(DISTINCT company_id) AS companies, CASE WHEN source LIKE '1%' THEN 'portal' WHEN source LIKE '2%' THEN 'board' ELSE 'feed' END AS kind FROM ads WHERE first_seen <= DATE '2001-07-31' GROUP BY source""", days="first_row last_pull")
def source_freshness(spark, sf_dir):
    kind = F.when(F.col("source").startswith("1"), "portal").when(F.col("source").startswith("2"), "board").otherwise("feed")
    g = ads(spark, sf_dir).where(F.col("first_seen") <= F.lit(AS_OF)).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("first_seen").alias("first_row"), F.max("last_seen").alias("last_pull"), F.countDistinct("company_id").alias("companies"))
    return g.withColumn("kind", kind)


_TAXONOMY = [
    {"skill": "Bolts", "terms": ["bolt"]},
    {"skill": "Widgets", "terms": ["widget"], "except": ["old widget"]},
    {"skill": "Gears", "terms": ["gear"], "gated": ["rod"], "evidence": ["red", "large"]},
]
_MAPPED = r"""CASE WHEN regexp_matches(t, '(^|[^a-z0-9])bolt') THEN ['Bolts'] ELSE [] END || CASE WHEN regexp_matches(t, '(^|[^a-z0-9])widget') AND NOT contains(t, 'old widget') THEN ['Widgets'] ELSE [] END ||
CASE WHEN regexp_matches(t, '(^|[^a-z0-9])gear') OR (regexp_matches(t, '(^|[^a-z0-9])rod') AND regexp_matches(t, '(^|[^a-z0-9])(red|large)')) THEN ['Gears'] ELSE [] END"""


@query(f"""WITH {ADS}, u AS (SELECT title, ' ' || lower(title) || ' ' AS t FROM ads WHERE last_seen >= DATE '2001-07-01' AND first_seen <= DATE '2001-07-31'), m AS (SELECT title FROM u WHERE len({_MAPPED}) = 0)
SELECT title, count(*) AS n, (SELECT count(*) FROM m) AS total FROM m GROUP BY title ORDER BY n DESC, title LIMIT 40""")
def unmapped_titles(spark, sf_dir):
    """Titles of thirty days without a skill, the forty most frequent, beside the count of all.

    Distinct titles are matched, not rows.
    """
    recent = ads(spark, sf_dir).where((F.col("last_seen") >= F.lit(AS_OF - timedelta(days=30))) & (F.col("first_seen") <= F.lit(AS_OF)))
    titles = recent.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    none = titles.where(tx.matched_skills(F.col("title"), _TAXONOMY).isNull())
    return none.orderBy(F.desc("n"), "title").limit(40).join(F.broadcast(none.agg(F.sum("n").alias("total"))))  # one row


@query(f"""WITH {ADS}, d AS (SELECT DISTINCT title, ' ' || lower(title) || ' ' AS t FROM ads), m AS (SELECT title, list_sort({_MAPPED}) AS new FROM d)
SELECT job_key, CASE WHEN len(new) > 0 THEN array_to_string(new, ',') END AS skills FROM ads JOIN m USING (title) WHERE coalesce(array_to_string(new, ','), '') <> CASE WHEN contains(title, 'bolt') THEN 'Bolts' ELSE '' END""")
def skill_remap(spark, sf_dir):
    """Rows whose recomputed skills differ from the stored ones; an empty set is written as null."""
    rows = ads(spark, sf_dir).select("job_key", "title", F.when(F.col("title").contains("bolt"), F.array(F.lit("Bolts"))).alias("stored"))
    titles = rows.select("title").distinct().withColumn("found", F.sort_array(tx.matched_skills(F.col("title"), _TAXONOMY)))
    joined = rows.join(titles, "title")
    return joined.where(~F.col("found").eqNullSafe(F.sort_array("stored"))).select("job_key", F.array_join("found", ",").alias("skills"))


@query(f"""{LIVE}, n AS (SELECT DISTINCT title, company, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS c, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS s FROM live),
r AS (SELECT DISTINCT s_name AS roster, string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS rt FROM supplier), a AS (SELECT DISTINCT replace(company, 'Customer', 'Supplier') AS advertiser, string_split(replace(c, 'customer', 'supplier'), ' ') AS wt FROM n)
SELECT advertiser, roster FROM a JOIN r ON wt[1] = rt[1] WHERE wt[1:least(len(wt), len(rt))] = rt[1:least(len(wt), len(rt))]""")
def attribution_token_prefix(spark, sf_dir):
    """Advertisers and roster names where one's words begin the other: joined on the words a name begins with."""
    a = _live(spark, sf_dir).select(F.regexp_replace("company", "Customer", "Supplier").alias("a"))
    r = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("b"))
    return roster.same_name_pairs(a, r).select(F.col("a").alias("advertiser"), F.col("b").alias("roster"))


@query(f"""WITH {ADS}, d AS (SELECT source, first_seen AS day, count(*) AS n, avg((company_id % 3 = 0)::INT) AS filled FROM ads WHERE first_seen <= DATE '2001-07-31' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS i FROM d),
b AS (SELECT source, median(filled) AS usual FROM p WHERE i BETWEEN 2 AND 15 GROUP BY source) SELECT p.source, day, floor(filled * 1000 + 0.5) / 1000 AS filled, floor(usual * 1000 + 0.5) / 1000 AS usual, CASE WHEN filled < 0.5 * usual THEN 'FIELD REGRESSION' ELSE 'ok' END AS finding FROM p JOIN b USING (source) WHERE i = 1""", days="day")
def field_regression(spark, sf_dir):
    """The share of rows with a field on the latest day against its median of fourteen days before."""
    d = ads(spark, sf_dir).where(F.col("first_seen") <= F.lit(AS_OF)).groupBy("source", F.col("first_seen").alias("day")).agg(F.avg((F.col("company_id") % 3 == 0).cast("int")).alias("filled"))
    p = d.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("day")))).where("i <= 15")
    b = p.where("i > 1").groupBy("source").agg(F.median("filled").alias("usual"))
    r = lambda c: F.floor(F.col(c) * 1000 + 0.5) / 1000
    return p.where("i = 1").join(b, "source").select("source", "day", r("filled").alias("filled"), r("usual").alias("usual"), F.when(F.col("filled") < 0.5 * F.col("usual"), "FIELD REGRESSION").otherwise("ok").alias("finding"))


# When a latest day's volume is critical or worth a warning, the least usual volume and days of history.
CRITICAL, WARN, LEAST_USUAL, LEAST_DAYS = 0.25, 0.55, 20, 5


@query(f"""WITH {ADS}, e AS (SELECT source || '/' || hub AS source, company_id, first_seen FROM ads WHERE first_seen <= DATE '2001-07-31'), d AS (SELECT source, first_seen AS day, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS i, count(*) OVER (PARTITION BY source) AS days FROM d), b AS (SELECT source, median(n) AS usual FROM p WHERE i BETWEEN 2 AND 15 GROUP BY source),
x AS (SELECT source || '/' || hub AS source FROM ads UNION SELECT 'expected/none')
SELECT x.source, p.day, p.n, b.usual, CASE WHEN p.day IS NULL THEN 'NO ROWS' WHEN datediff('day', p.day, DATE '2001-07-31') >= 3 THEN 'STALE' WHEN days >= 5 AND usual >= {LEAST_USUAL / 10} AND p.n / usual < 0.25 THEN 'VOLUME COLLAPSE' WHEN days >= 5 AND usual >= {LEAST_USUAL / 10} AND p.n / usual < 0.55 THEN 'VOLUME DROP' ELSE 'ok' END AS finding,
  CASE WHEN p.day IS NULL OR datediff('day', p.day, DATE '2001-07-31') > 3 THEN 'CRITICAL' WHEN datediff('day', p.day, DATE '2001-07-31') = 3 THEN 'WARN' WHEN days >= 5 AND usual >= {LEAST_USUAL / 10} AND p.n / usual < 0.25 THEN 'CRITICAL' WHEN days >= 5 AND usual >= {LEAST_USUAL / 10} AND p.n / usual < 0.55 THEN 'WARN' ELSE '' END AS level
FROM x LEFT JOIN (SELECT * FROM p WHERE i = 1) p USING (source) LEFT JOIN b USING (source)""", days="day")
def source_health(spark, sf_dir):
    """Each feed of a place: without rows, stale, or with a latest day far under its usual volume, with levels.

    The test tables' feeds are small, so a tenth of the least usual volume is asked of them.
    """
    rows = ads(spark, sf_dir).withColumn("source", F.concat_ws("/", "source", "hub"))
    expected = rows.select("source").union(spark.createDataFrame([("expected/none",)], "source string")).distinct()
    return feed_health(rows.where(F.col("first_seen") <= F.lit(AS_OF)), expected, AS_OF, 3, LEAST_USUAL / 10)


def feed_health(rows: DataFrame, expected: DataFrame, as_of, allowed_days: int, least_usual: float = LEAST_USUAL) -> DataFrame:
    """(source, day, n, usual, finding, level) per expected source, from rows of source and first_seen."""
    d = rows.groupBy("source", F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source")
    p = d.withColumn("i", F.row_number().over(by.orderBy(F.desc("day")))).withColumn("days", F.count(F.lit(1)).over(by)).where("i <= 15")
    latest = p.groupBy("source").agg(F.max(F.when(F.col("i") == 1, F.col("day"))).alias("day"), F.max(F.when(F.col("i") == 1, F.col("n"))).alias("n"), F.median(F.when(F.col("i") > 1, F.col("n"))).alias("usual"), F.max("days").alias("days"))
    age = F.datediff(F.lit(as_of), "day")
    judged = (F.col("days") >= LEAST_DAYS) & (F.col("usual") >= least_usual)
    share = F.col("n") / F.col("usual")
    finding = F.when(F.col("day").isNull(), "NO ROWS").when(age >= allowed_days, "STALE").when(judged & (share < CRITICAL), "VOLUME COLLAPSE").when(judged & (share < WARN), "VOLUME DROP").otherwise("ok")
    level = F.when(F.col("day").isNull() | (age > allowed_days), "CRITICAL").when(age == allowed_days, "WARN").when(judged & (share < CRITICAL), "CRITICAL").when(judged & (share < WARN), "WARN").otherwise("")
    return expected.join(latest, "source", "left").select("source", "day", "n", "usual", finding.alias("finding"), level.alias("level"))


@query(f"""WITH {ADS}, d AS (SELECT source, first_seen AS day, count(*) AS n FROM ads WHERE first_seen <= DATE '2001-07-31' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS i FROM d), b AS (SELECT source, median(n) AS usual FROM p WHERE i BETWEEN 2 AND 15 GROUP BY source)
SELECT source, day, n, usual, CASE WHEN day < DATE '2001-07-28' THEN 'STALE' WHEN n < 0.25 * usual THEN 'VOLUME COLLAPSE' WHEN n < 0.55 * usual THEN 'VOLUME DROP' ELSE 'ok' END AS finding FROM p JOIN b USING (source) WHERE i = 1""", days="day")
def volume_collapse(spark, sf_dir):
    """Stale sources, and sources whose latest day falls under 25 or 55 percent of its usual volume."""
    d = ads(spark, sf_dir).where(F.col("first_seen") <= F.lit(AS_OF)).groupBy("source", F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    p = d.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("day")))).where("i <= 15")
    b = p.where("i > 1").groupBy("source").agg(F.median("n").alias("usual"))
    finding = F.when(F.col("day") < F.lit(AS_OF - timedelta(days=3)), "STALE").when(F.col("n") < CRITICAL * F.col("usual"), "VOLUME COLLAPSE").when(F.col("n") < WARN * F.col("usual"), "VOLUME DROP").otherwise("ok")
    return p.where("i = 1").join(b, "source").select("source", "day", "n", "usual", finding.alias("finding"))


_ROLES = f"{LIVE}, roles AS (SELECT DISTINCT source, hub || '|' || title AS role FROM live)"


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("source", F.concat_ws("|", "hub", "title").alias("role")).distinct()


@query(f"{_ROLES}, k AS (SELECT role, count(*) AS c FROM roles GROUP BY role) SELECT source, count(*) AS roles, count(*) FILTER (c = 1) AS only_here, count(*) FILTER (c > 1) AS shared FROM roles JOIN k USING (role) GROUP BY source")
def source_unique(spark, sf_dir):
    """What each source alone contributes: roles are grouped once, with the set of their sources."""
    k = _roles(spark, sf_dir).groupBy("role").agg(F.collect_set("source").alias("sources"))
    e = k.select(F.explode("sources").alias("source"), (F.size("sources") == 1).alias("alone"))
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("roles"), F.count_if("alone").alias("only_here"), F.count_if(~F.col("alone")).alias("shared"))


@query(f"{_ROLES} SELECT role FROM roles WHERE source = '1-URGENT' EXCEPT SELECT role FROM roles WHERE source = '2-HIGH'")
def source_except(spark, sf_dir):
    r = _roles(spark, sf_dir)
    return r.where("source = '1-URGENT'").select("role").subtract(r.where("source = '2-HIGH'").select("role"))


@query(f"{_ROLES} SELECT role FROM roles WHERE source = '1-URGENT' INTERSECT SELECT role FROM roles WHERE source = '2-HIGH'")
def source_intersect(spark, sf_dir):
    r = _roles(spark, sf_dir)
    return r.where("source = '1-URGENT'").select("role").intersect(r.where("source = '2-HIGH'").select("role"))


@query(f"{_ROLES} SELECT role FROM roles WHERE source IN ('1-URGENT', '2-HIGH') EXCEPT SELECT role FROM roles WHERE source NOT IN ('1-URGENT', '2-HIGH')")
def exclusive_to_pair(spark, sf_dir):
    """Roles that a pair of sources holds and no other source does."""
    r = _roles(spark, sf_dir)
    pair = F.col("source").isin("1-URGENT", "2-HIGH")
    return r.where(pair).select("role").subtract(r.where(~pair).select("role"))


@query(f"""WITH {ADS}, x AS (SELECT string_split(title, ' ')[2] AS head, source, job_key FROM ads WHERE first_seen > DATE '2001-06-16' AND first_seen <= DATE '2001-07-31' AND NOT contains(title, 'bolt') ORDER BY first_seen DESC, job_key LIMIT 2000), g AS (SELECT head, source, count(*) AS n FROM x GROUP BY ALL)
SELECT head, sum(n)::BIGINT AS n, array_to_string(list_sort(list(source || '=' || n)), ';') AS by_source FROM g GROUP BY head ORDER BY n DESC, head LIMIT 60""")
def skill_gaps(spark, sf_dir):
    """Heads of the newest titles without a skill, with their counts by source."""
    fresh = ads(spark, sf_dir).where((F.col("first_seen") > F.lit(AS_OF - timedelta(days=45))) & (F.col("first_seen") <= F.lit(AS_OF)) & ~F.col("title").contains("bolt"))
    newest = fresh.orderBy(F.desc("first_seen"), "job_key").limit(2000).withColumn("head", F.split_part("title", F.lit(" "), F.lit(2)))
    g = newest.groupBy("head", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("head").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "source", "n"))), ";").alias("by_source")).orderBy(F.desc("n"), "head").limit(60)


_LOW = "lower(text)"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join("contains(lower(text), '" + w + "')" for w in words) + ")"


@query("SELECT conv_id, turn, CASE WHEN " + _any(tx.NOT_HELD) + " THEN 'unknown' " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in tx.INTENTS) + " ELSE 'unknown' END AS intent FROM conversations")
def intent_routing(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.intent(F.col("text")).alias("intent"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ing') THEN 'ing' WHEN contains(lower(text), 'der') THEN 'der' END AS scope FROM conversations)
SELECT conv_id, turn, last_value(scope IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, scope ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM t""")
def turn_carry_forward(spark, sf_dir):
    """A turn that names no scope keeps that of the turn before."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.first_contained(F.col("text"), ["ing", "der"]).alias("scope"))
    past = Window.partitionBy("conv_id").orderBy("turn", F.asc_nulls_last("scope")).rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "turn", F.last("scope", True).over(past).alias("scope"))


@query(r"""WITH h AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM benchmark), d AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents),
n AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS name FROM d, unnest(range(1, len(ws))) AS r(i)), g AS (SELECT DISTINCT item_id, ws[i] || ' ' || ws[i + 1] AS name FROM (SELECT item_id, string_split(trim(t), ' ') AS ws FROM h), unnest(range(1, len(ws))) AS r(i))
SELECT item_id, name FROM g JOIN n USING (name)""")
def headline_mentions(spark, sf_dir):
    """Names of two words, taken from all documents and whole texts, that stand in headlines."""
    heads = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # Of the documents' names only those that a headline holds are gathered, as their number grows with all texts.
    held = _word_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(_word_pairs(heads).distinct(), "name", "left_semi")
    return mentions(heads, held.distinct())


def _word_pairs(texts):
    """(name): every two consecutive words of the texts."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size("ws") - 2), lambda i: F.concat_ws(" ", F.get("ws", i), F.get("ws", i + 1)))
    return texts.select(words.alias("ws")).where(F.size("ws") > 1).select(F.explode(pairs).alias("name"))


def mentions(heads, names):
    """(item_id, name): the names that stand in a headline as consecutive words, however many words a name has.

    Names and headlines are cut into lower-case words; a name is joined on its
    first word and then held against the words that follow.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    roster = names.select("name", words("name").alias("nw")).where(F.size("nw") > 0).distinct().withColumn("w", F.get("nw", F.lit(0)))
    placed = heads.select("item_id", words("text").alias("ws")).select("item_id", "ws", F.posexplode("ws").alias("at", "w"))
    found = placed.join(roster, "w").where(F.slice("ws", F.col("at") + 1, F.size("nw")) == F.col("nw"))
    return found.select("item_id", "name").distinct()


@query(r"""WITH h AS (SELECT item_id, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS ws FROM benchmark), n AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) AS name FROM documents) WHERE regexp_matches(name, '^[a-z]{3,}$'))
SELECT DISTINCT item_id, name FROM (SELECT item_id, unnest(ws) AS w FROM h) JOIN n ON w = name""")
def document_mentions(spark, sf_dir):
    """Words of any document, wherever they stand in its text, that stand in headlines."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = texts.select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " ")).alias("name"))
    return mentions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words.where(F.col("name").rlike("^[a-z]{3,}$")).distinct())


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tx.strip_html(F.col("html")).alias("text"))
