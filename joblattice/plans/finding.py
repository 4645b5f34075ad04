"""Free text to skills: the index of describing words, ranked skills, and the search over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search
from .fixture import table
from .registry import query

_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + ")"


def _tokens(source: str, name: str) -> str:
    """SQL: the distinct search words (id, token) of a relation (id, text)."""
    return f"""{name}_w AS (SELECT id, i, ws[i] AS w FROM (SELECT id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$')) AS ws FROM {source}), unnest(range(1, len(ws) + 1)) AS r(i)),
{name} AS (SELECT id, w AS token FROM {name}_w WHERE w NOT IN {_STOP}
  UNION SELECT id, s FROM (SELECT id, w, CASE WHEN len(w) > 5 AND ends_with(w, 'ing') THEN w[:-4] WHEN len(w) > 4 AND ends_with(w, 'ed') THEN w[:-3] WHEN len(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END AS s FROM {name}_w WHERE w NOT IN {_STOP}) WHERE s <> w AND len(s) >= 4
  UNION SELECT a.id, a.w || ' ' || b.w FROM {name}_w a JOIN {name}_w b ON a.id = b.id AND b.i = a.i + 1 WHERE a.w NOT IN {_STOP} AND b.w NOT IN {_STOP})"""


def _entries(scores: str, name: str, base: float, least: float) -> str:
    return f"""{name} AS (SELECT token, skill, floor(s * 1000 + 0.5) / 1000 AS share, floor({base} * top * 1000 + 0.5) / 1000 AS w FROM (
  SELECT *, max(s) OVER (PARTITION BY token) AS top, row_number() OVER (PARTITION BY token ORDER BY v DESC, skill) AS place FROM (SELECT *, v / sum(v) OVER (PARTITION BY token) AS s FROM {scores})) WHERE top >= {least} AND place <= 4 AND s >= 0.08)"""


_INDEX = f"""WITH seeds AS (SELECT row_number() OVER () AS id, skill, text, weight FROM (SELECT DISTINCT p_type AS skill, p_type || ' parts' AS text, 2.0::DOUBLE AS weight FROM part UNION ALL SELECT p_type, p_name, 1.0::DOUBLE FROM part WHERE p_size = 1)),
texts AS (SELECT p_partkey AS id, p_name || ' ' || CASE WHEN p_size > 25 THEN 'fittings' ELSE 'handling' END AS text, CASE WHEN p_size % 2 = 0 THEN [p_type, 'SPARES'] ELSE [p_type] END AS skills FROM part WHERE p_size > 1),
{_tokens("seeds", "st")}, {_tokens("texts", "tt")},
sv AS (SELECT token, skill, sum(weight) AS v FROM st JOIN seeds USING (id) GROUP BY ALL), {_entries("sv", "f", 1.0, 0.3)},
often AS (SELECT token, count(*) AS n FROM tt GROUP BY token HAVING count(*) >= 3),
tv AS (SELECT token, skill, sum(part) AS v FROM (SELECT token, unnest(skills) AS skill, 3.0::DOUBLE / len(skills) AS part FROM tt JOIN texts USING (id)) GROUP BY ALL), {_entries("tv", "d", 0.85, 0.28)},
idx AS (SELECT * FROM f UNION ALL SELECT d.* FROM d JOIN often USING (token) WHERE token NOT IN (SELECT token FROM f))"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("skill"), F.concat("p_type", F.lit(" parts")).alias("text"), F.lit(2.0).alias("weight")).distinct()
    seeds = names.unionByName(p.where("p_size = 1").select(F.col("p_type").alias("skill"), F.col("p_name").alias("text"), F.lit(1.0).alias("weight")))
    kind = F.when(F.col("p_size") > 25, "fittings").otherwise("handling")
    skills = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_type"), F.lit("SPARES"))).otherwise(F.array("p_type"))
    texts = p.where("p_size > 1").select(F.concat_ws(" ", "p_name", kind).alias("text"), F.lit(3.0).alias("weight"), skills.alias("skills"))
    return search.skill_words(seeds, texts)


@query(f"{_INDEX} SELECT token, skill, share, w FROM idx")
def skill_words(spark, sf_dir):
    """The words that describe skills, with the skills' shares."""
    return _index(spark, sf_dir)


_ASKED = f"""{_INDEX}, asked AS (SELECT p_partkey AS id, p_type || ' parts, fitting and ' || p_name AS text FROM part), {_tokens("asked", "qt")},
sc AS (SELECT id AS query_id, skill, floor(sum(w * share) * 1000000 + 0.5) / 1000000 AS score FROM qt JOIN idx USING (token) GROUP BY ALL)"""


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat("p_type", F.lit(" parts, fitting and "), "p_name").alias("text"))
    return search.described_skills(asked, _index(spark, sf_dir))


@query(f"{_ASKED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill) AS place FROM sc) WHERE place <= 6")
def described_skills(spark, sf_dir):
    """Descriptions in free text to ranked skills."""
    return _described(spark, sf_dir)


@query(f"""{_ASKED}, ds AS (SELECT skill, row_number() OVER (ORDER BY score DESC, skill) AS nth FROM sc WHERE query_id = 1 QUALIFY nth <= 6), direct AS (SELECT DISTINCT p_type AS label FROM part WHERE contains(lower(p_type), 'ar')),
sk AS (SELECT label, 0 AS tier, 0 AS nth FROM direct UNION ALL SELECT skill, 1, nth FROM ds WHERE skill NOT IN (SELECT label FROM direct))
SELECT 'skill' AS kind, label, row_number() OVER (ORDER BY tier, nth, label) AS place FROM sk QUALIFY place <= 7
UNION ALL SELECT 'company', label, row_number() OVER (ORDER BY label) AS place FROM (SELECT DISTINCT c_name AS label FROM customer WHERE contains(lower(c_name), 'ar') OR contains(lower(c_mktsegment), 'ar')) QUALIFY place <= 6
UNION ALL SELECT 'city', label, row_number() OVER (ORDER BY label) AS place FROM (SELECT DISTINCT n_name AS label FROM nation WHERE contains(lower(n_name), 'ar')) QUALIFY place <= 6""")
def global_search(spark, sf_dir):
    """One query over skills (by name, then by description), companies and cities."""
    skills = table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()
    companies = table(spark, sf_dir, "customer").select(F.col("c_name").alias("label"), F.col("c_mktsegment").alias("ticker"))
    cities = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"))
    return search.global_search(" AR ", skills, _described(spark, sf_dir).where("query_id = 1"), companies, cities)
