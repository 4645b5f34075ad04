"""Rosters of employers: comparing two, matching advertisers by name, filtering cities, taking turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .archive import released

# The windows a caller may ask for.
TREND_DAYS = (7, 14, 30, 60)
MARKET_DAYS = (7, 14, 30)
RETENTION_DAYS = (1, 7, 30)


def window_days(asked: int | None, allowed: tuple[int, ...] = TREND_DAYS, default: int = 30) -> int:
    """The asked window if it is one of those allowed, else the default."""
    return asked if asked in allowed else default


def for_role(rows: DataFrame, sees_all: bool, hubs: DataFrame, companies: DataFrame) -> DataFrame:
    """All rows for those who see every market, released ones for the rest."""
    return rows if sees_all else released(rows, hubs, companies)


def roster_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of the first roster that the second lacks are missing, the other way round extra."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def cities_shown(cities: DataFrame, roster: DataFrame, passes: Column) -> DataFrame:
    """Cities (city) where an employer of the roster (city, ...) passes; a city without a roster makes no claim and stays."""
    some = cities.join(roster.where(passes).select("city").distinct(), "city", "left_semi")
    return some.unionByName(cities.join(roster.select("city").distinct(), "city", "left_anti"))


def in_turn(rows: DataFrame, place: str, parts: int, part: int) -> DataFrame:
    """Every ``parts``-th row by its place, beginning with ``part``."""
    return rows.where(F.pmod(F.col(place), F.lit(parts)) == part)


def from_cursor(rows: DataFrame, place: str, n: int, cursor: int, size: int) -> tuple[DataFrame, int]:
    """``size`` of ``n`` places from a cursor on, going round at the end, and where the next turn begins."""
    return rows.where(F.pmod(F.col(place) - cursor, F.lit(n)) < size), (cursor + size) % n


def _words(name: str) -> Column:
    return F.filter(F.split(tx.norm(F.col(name)), " "), lambda w: w != "")


def _openings(name: str) -> Column:
    """All word sequences that a name begins with, itself last."""
    words = _words(name)
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def same_name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): names of ``left`` (a) and ``right`` (b) of which one's words begin the other.

    Each name is joined with the openings of the other side's names, by equality,
    so names that share a first word only are never compared.
    """
    a = left.select("a").distinct().where(F.size(_words("a")) > 0)
    b = right.select("b").distinct().where(F.size(_words("b")) > 0)
    longer = a.withColumn("k", F.explode(_openings("a"))).join(b.withColumn("k", tx.norm(F.col("b"))), "k")
    shorter = a.withColumn("k", tx.norm(F.col("a"))).join(b.withColumn("k", F.explode(_openings("b"))), "k")
    return longer.select("a", "b").union(shorter.select("a", "b")).distinct()


def checked_advertisers(rows: DataFrame, roster: DataFrame, denied: DataFrame, never: str) -> DataFrame:
    """``rows`` with ``verdict``: keep, or why the advertiser isn't the employer that was searched for.

    ``rows`` has advertiser, target_id, target_name and searched_as (null: the
    target's name); ``roster`` id and name; ``denied`` id and advertiser; ``never`` is
    a pattern of names that are no employer's.  A blank advertiser is kept.  In
    order: no employer, empty, denied, the searched name only inside a word,
    another roster company, and, if a name of its own was searched, unlike it.
    """
    searched = F.coalesce(tx.blank_to_null(F.col("searched_as")), F.col("target_name"))
    own = rows.withColumn("_expected", F.trim(searched)).withColumn("_a", tx.norm(F.col("advertiser"))).withColumn("_n", tx.norm(F.col("_expected")))
    others = same_name_pairs(own.select(F.col("advertiser").alias("a")), roster.select(F.col("name").alias("b")))
    ids = others.join(roster.select(F.col("name").alias("b"), "id"), "b").groupBy("a").agg(F.collect_set("id").alias("_ids"))
    bad = denied.select(F.col("id").alias("target_id"), tx.norm(F.col("advertiser")).alias("_a")).distinct().withColumn("_denied", F.lit(True))
    joined = own.join(ids.withColumnRenamed("a", "advertiser"), "advertiser", "left").join(bad, ["target_id", "_a"], "left")
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    whole = spaced("_a").contains(spaced("_n"))
    like = tx.same_company(F.col("advertiser"), F.col("_expected"))
    elsewhere = F.size(F.array_except(F.coalesce("_ids", F.array().cast(joined.schema["_ids"].dataType)), F.array("target_id"))) > 0
    apart = tx.norm(F.col("_expected")) != tx.norm(F.col("target_name"))
    verdict = (
        F.when(F.coalesce(F.trim("advertiser"), F.lit("")) == "", "keep")
        .when(F.trim("advertiser").rlike(never), "no employer")
        .when(F.col("_a") == "", "empty")
        .when(F.col("_denied"), "denied")
        .when(~whole & F.col("_a").contains(F.col("_n")) & (F.length("_n") >= 2), "inside a word")
        .when(~like & elsewhere, "another company")
        .when(apart & ~like & ~whole & ~tx.same_company(F.col("advertiser"), F.col("target_name")), "unlike the search")
        .otherwise("keep")
    )
    return joined.select(*rows.columns, verdict.alias("verdict"))


def merged_taxonomy(entries: DataFrame) -> DataFrame:
    """One row per skill of entries (ordinal, skill, cat, terms, excepts): the first category wins, terms and
    excepts are united in order of appearance; ``conflict`` marks skills declared in several categories."""
    by_turn = lambda c: F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v"))))
    united = lambda c: F.array_distinct(F.flatten(F.transform(by_turn(c), lambda x: x["v"])))
    return entries.groupBy("skill").agg(F.min_by("cat", "ordinal").alias("cat"), united("terms").alias("terms"), united("excepts").alias("excepts"), (F.countDistinct("cat") > 1).alias("conflict"))
