"""Finding skills, employers and places by free text; the index of words that describe skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.money import half_up

# Fixed values of the index: weights and least top shares of its two tiers, the least share and number of a
# word's skills, how often a descriptive word must occur, and how many words the index holds.
SEED_BASE, SEED_SHARE = 1.0, 0.30
TEXT_BASE, TEXT_SHARE = 0.85, 0.28
LEAST_SHARE, MOST_SKILLS, LEAST_TEXTS, MOST_WORDS = 0.08, 4, 3, 12_000


def matches_text(query: Column, fields: list[Column], lists: list[Column]) -> Column:
    """The query, trimmed and in lower case, stands in a field or in an element of a list; a blank query matches all."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    found = q == ""
    for c in fields:
        found = found | F.coalesce(F.lower(c).contains(q), F.lit(False))
    for c in lists:
        found = found | F.coalesce(F.exists(c, lambda x: F.lower(x).contains(q)), F.lit(False))
    return found


def _entries(scores: DataFrame, base: float, least: float) -> DataFrame:
    """(token, skill, share, w) from (token, skill, v): words whose first skill has enough of their weight."""
    by = Window.partitionBy("token")
    shares = scores.withColumn("s", F.col("v") / F.sum("v").over(by)).withColumn("top", F.max("s").over(by))
    placed = shares.withColumn("place", F.row_number().over(by.orderBy(F.desc("v"), "skill")))
    kept = placed.where((F.col("top") >= least) & (F.col("place") <= MOST_SKILLS) & (F.col("s") >= LEAST_SHARE))
    return kept.select("token", "skill", half_up(F.col("s"), 3).alias("share"), half_up(base * F.col("top"), 3).alias("w"))


def skill_words(seeds: DataFrame, texts: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The index (token, skill, share, w) of words that describe skills.

    ``seeds`` has skill, text and weight: a skill's name counts 2, each of its terms 1.
    ``texts`` has text, weight and skills: a text's weight is divided among its skills.
    Words of the seeds come first; of the texts' words those in enough texts fill the
    index up, the most concentrated and common ones first.
    """
    words = lambda df: df.withColumn("token", F.explode(F.array_distinct(tx.search_tokens(F.col("text")))))
    sown = words(seeds).groupBy("token", "skill").agg(F.sum("weight").alias("v"))
    first = _entries(sown, SEED_BASE, SEED_SHARE)
    told = words(texts.where(F.size("skills") > 0))
    often = told.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    scores = told.select("token", F.explode("skills").alias("skill"), (F.col("weight") / F.size("skills")).alias("part")).groupBy("token", "skill").agg(F.sum("part").alias("v"))
    rest = _entries(scores, TEXT_BASE, TEXT_SHARE).join(often, "token").join(first.select("token").distinct(), "token", "left_anti")
    use = F.col("w") * F.least(F.lit(1.0), F.log10(F.col("n") + 1) / 1.3)
    ranked = rest.groupBy("token").agg(F.max(use).alias("use")).orderBy(F.desc("use"), "token").limit(most_words)
    return first.unionByName(rest.join(ranked.select("token"), "token", "left_semi").drop("n"))


def described_skills(queries: DataFrame, index: DataFrame, top: int = 6) -> DataFrame:
    """(query_id, skill, score, place): skills ranked by the weights of a query's distinct words; queries of fewer than three characters have none.

    The index is sent to the queries: it holds the taxonomy's words and at most MOST_WORDS others, with MOST_SKILLS
    skills each.  Left open, Spark sends the queries' words, whose table it takes for no larger than the queries'.
    """
    asked = queries.where(F.length(F.trim("text")) >= 3).select("query_id", F.explode(F.array_distinct(tx.search_tokens(F.col("text")))).alias("token"))
    scores = asked.join(F.broadcast(index), "token").groupBy("query_id", "skill").agg(half_up(F.sum(F.col("w") * F.col("share")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "skill")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def global_search(query: str, skills: DataFrame, described: DataFrame, companies: DataFrame, cities: DataFrame) -> DataFrame:
    """(kind, label, place): up to seven skills (those that hold the query, then described ones), six companies, six cities.

    ``skills``, ``cities`` have label; ``companies`` label and ticker; ``described``
    skill and place for this query.  A blank query finds nothing.
    """
    q = query.strip().lower()
    holds = lambda c: F.lower(F.col(c)).contains(q)
    direct = skills.where(holds("label")).select("label", F.lit(0).alias("tier"), F.lit(0).alias("at"))
    more = described.select(F.col("skill").alias("label"), F.lit(1).alias("tier"), F.col("place").alias("at")).join(direct.select("label"), "label", "left_anti")

    def ranked(rows: DataFrame, kind: str, cap: int) -> DataFrame:
        order = Window.orderBy("tier", "at", "label")
        few = rows.distinct().orderBy("tier", "at", "label").limit(cap)
        return few.select(F.lit(kind).alias("kind"), "label", F.row_number().over(order).alias("place"))

    plain = lambda rows: rows.select("label", F.lit(0).alias("tier"), F.lit(0).alias("at"))
    found = ranked(direct.unionByName(more), "skill", 7).unionByName(ranked(plain(companies.where(holds("label") | holds("ticker"))), "company", 6)).unionByName(ranked(plain(cities.where(holds("label"))), "city", 6))
    return found if q else found.where(F.lit(False))
