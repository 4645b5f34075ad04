"""Queries over what people ask: the scope of a question, the state of a thread, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scope
from .fixture import table
from .registry import query


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies (customers, and the words of part names: short ones, some of them acronyms), cities, regions."""
    part = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    short = F.when(F.length("w") % 2 == 0, F.upper("w")).otherwise(F.initcap("w"))
    rows = [
        table(spark, sf_dir, "customer").select(F.lit("company").alias("kind"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")),
        part.select(F.lit("company").alias("kind"), F.col("w").alias("id"), short.alias("name")),
        table(spark, sf_dir, "nation").select(F.lit("city").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")),
        table(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name")),
    ]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole.withColumn("ordinal", F.col("name"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the conversations, followed by words that name a place, an employer, both, the world or neither."""
    t = table(spark, sf_dir, "conversations")
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by the data model
    wide = t.join(customer, F.col("conv_id") == F.col("c_custkey"), "left").join(F.broadcast(places), F.col("conv_id") % 25 == F.col("n_nationkey"), "left")
    tails = [
        F.concat(F.lit(" What about "), "n_name", F.lit("?")),
        F.concat(F.lit(" How is "), F.coalesce("c_name", F.lit("it")), F.lit(" hiring in "), "n_name", F.lit("?")),
        F.concat(F.lit(" And the pay in "), F.lower("r_name"), F.lit(" for a small ring?")),
        F.lit(" Is there demand worldwide?"),
        F.lit(" Would Red or ring sponsor a visa, across cities?"),
        F.lit(" And then?"),
        F.lit(" how about red, please"),
    ]
    tail = F.get(F.array(*tails), ((F.col("conv_id") + F.col("turn") * 3) % len(tails)).cast("int"))
    return wide.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


_ASKED = """asked AS (
  SELECT conv_id, turn, coalesce(text, '') || CASE (conv_id + turn * 3) % 7 WHEN 0 THEN ' What about ' || n_name || '?' WHEN 1 THEN ' How is ' || coalesce(c_name, 'it') || ' hiring in ' || n_name || '?'
    WHEN 2 THEN ' And the pay in ' || lower(r_name) || ' for a small ring?' WHEN 3 THEN ' Is there demand worldwide?' WHEN 4 THEN ' Would Red or ring sponsor a visa, across cities?' WHEN 5 THEN ' And then?' ELSE ' how about red, please' END AS text
  FROM conversations LEFT JOIN customer ON conv_id = c_custkey LEFT JOIN nation ON conv_id % 25 = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), spaced AS (
  SELECT conv_id, turn, text, ' ' || trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) || ' ' AS s FROM asked
), w AS (
  SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part
), names AS (
  SELECT 'company' AS kind, c_custkey::VARCHAR AS id, c_name AS name, 1 AS k FROM customer
  UNION ALL SELECT 'company', w, CASE WHEN len(w) % 2 = 0 THEN upper(w) ELSE upper(w[1]) || w[2:] END, 1 FROM w
  UNION ALL SELECT 'city', n_nationkey::VARCHAR, n_name, 2 FROM nation
  UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_name, 4 FROM region
), keyed AS (
  SELECT *, ' ' || trim(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) || ' ' AS s FROM names
), hit AS (
  SELECT conv_id, turn, kind, id, name, k FROM spaced JOIN keyed ON contains(lower(spaced.s), lower(keyed.s))
  WHERE NOT (kind = 'company' AND len(name) < 5 AND NOT regexp_matches(name, '^[A-Z0-9&.-]+$')) OR contains(spaced.s, keyed.s)
  UNION ALL SELECT conv_id, turn, 'world', '', 'Worldwide', 5 FROM asked WHERE regexp_matches(lower(text), '\\b(worldwide|globally|global|everywhere|all countries|world)\\b')
), best AS (
  SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, len(name) DESC, name) = 1
)"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir).select(F.struct("conv_id", "turn").alias("question_id"), "text")
    return scope.detect_scope(asked, _names(spark, sf_dir)).select("question_id.conv_id", "question_id.turn", "kind", "id", "name")


@query(f"WITH {_ASKED} SELECT conv_id, turn, kind, id, name FROM best")
def question_scope(spark, sf_dir):
    """The scope that each turn names: the narrowest kind, then the longest name."""
    return _scoped(spark, sf_dir)


@query(f"""WITH {_ASKED}, m AS (
  SELECT conv_id, turn, kind, name, s.i AS start, len(kw) AS n, ks FROM (SELECT *, list_filter(string_split(trim(s), ' '), lambda x: x <> '') AS ws FROM spaced) q
  JOIN (SELECT *, s AS ks, string_split(lower(trim(s)), ' ') AS kw FROM keyed) k ON contains(lower(q.s), lower(k.s)), unnest(range(1, len(ws) + 1)) AS s(i)
  WHERE list_transform(ws[s.i:s.i + len(kw) - 1], lambda x: lower(x)) = kw AND (NOT (kind = 'company' AND len(name) < 5 AND NOT regexp_matches(name, '^[A-Z0-9&.-]+$')) OR ws[s.i] = trim(ks))
) SELECT name, kind, count(*) AS said, count(DISTINCT conv_id) AS threads FROM m a
WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.conv_id = b.conv_id AND a.turn = b.turn AND a.kind = b.kind AND a.name <> b.name AND b.start <= a.start AND b.start + b.n >= a.start + a.n AND (b.n > a.n OR b.name < a.name)) GROUP BY ALL""")
def named_places(spark, sf_dir):
    """How often each name is said, names inside longer ones of their kind left out."""
    asked = _questions(spark, sf_dir).select(F.struct("conv_id", "turn").alias("question_id"), "text")
    found = scope.outermost(scope.mentions(asked, _names(spark, sf_dir)))
    return found.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("said"), F.countDistinct("question_id.conv_id").alias("threads"))


_INTENTS = "CASE " + "WHEN " + " OR ".join(f"contains(low, '{w}')" for w in tx.NOT_HELD) + " THEN NULL " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in tx.INTENTS) + " END"
_SKILLS = ["widget", "ring", "cog", "bolt", "gear", "tin"]
_THREADS = f"""WITH RECURSIVE {_ASKED}, t AS (
  SELECT a.conv_id, a.turn, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS nth, a.text, {_INTENTS} AS own,
         CASE {" ".join(f"WHEN contains(low, '{w}') THEN '{w}'" for w in sorted(_SKILLS, key=lambda w: (-len(w), w)))} END AS sk, kind || ':' || id AS sc
  FROM (SELECT *, lower(text) AS low FROM asked) a LEFT JOIN best USING (conv_id, turn)
), fold AS (
  SELECT conv_id, turn, nth, text, coalesce(own, 'unknown') AS intent, sk AS skill, coalesce(sc, 'region:0') AS scope, own IS NOT NULL AS is_new, []::VARCHAR[] AS inherited FROM t WHERE nth = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.nth, t.text, coalesce(own, intent), CASE WHEN sk IS NULL AND own IS NULL THEN skill ELSE sk END, coalesce(sc, scope), own IS NOT NULL,
    list_filter([CASE WHEN own IS NULL THEN 'intent' END, CASE WHEN sk IS NULL AND own IS NULL AND skill IS NOT NULL THEN 'skill' END, CASE WHEN sc IS NULL THEN 'scope' END], lambda x: x IS NOT NULL)
  FROM fold JOIN t ON t.conv_id = fold.conv_id AND t.nth = fold.nth + 1
)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir)
    named = _scoped(spark, sf_dir).select("conv_id", "turn", F.concat_ws(":", "kind", "id").alias("scope"))
    turns = asked.join(named, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("thread"), "turn", "text", tx.longest_contained(F.col("text"), _SKILLS).alias("skill"), "scope")
    return scope.merge_turns(turns, F.lit("region:0"))


@query(f"{_THREADS} SELECT conv_id AS thread, turn, intent, skill, scope, regexp_matches(lower(text), '\\b(across|compare|between|by (city|cities|region|state)|where)\\b') AS wants_areas, is_new, inherited FROM fold")
def thread_state(spark, sf_dir):
    """What holds in each turn of a thread: intent, skill and scope, with what was taken over."""
    return _state(spark, sf_dir)


@query(f"""{_THREADS}, alt AS (SELECT n_nationkey::VARCHAR AS id, n_name AS label, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey % 2 = 1),
offers AS (
  SELECT conv_id, turn, k, label, 'What about ' || label || '?' AS question FROM fold, alt WHERE scope <> 'city:' || alt.id
  UNION ALL SELECT conv_id, turn, 1000, 'Across cities', 'How does ' || skill || ' compare across cities?' FROM fold WHERE skill IS NOT NULL AND NOT regexp_matches(lower(text), '\\b(across|compare|between|by (city|cities|region|state)|where)\\b')
)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS place, label, question FROM offers QUALIFY place <= 4""")
def follow_ups(spark, sf_dir):
    """Suggestions after each turn; what reads as something else is never offered."""
    state = _state(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1")
    cities = nation.select(F.lit("city").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ordinal"))
    lost = cities.select(F.lit("region").alias("kind"), "id", "label", (F.col("ordinal") - 1).alias("ordinal"))  # reads as a city, so it never comes back
    current = state.select(F.struct("thread", "turn").alias("turn_id"), "skill", F.substring_index("scope", ":", 1).alias("kind"), F.substring_index("scope", ":", -1).alias("id"), "wants_areas")
    offered = scope.follow_ups(current, cities.unionByName(lost), _names(spark, sf_dir))
    return offered.select(F.col("turn_id.thread").alias("conv_id"), "turn_id.turn", "place", "label", "question")
