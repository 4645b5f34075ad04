"""What a question is about: the scope it names, and what a turn takes over from the turns before it.

Names are matched on whole words.  The dictionary is read as a trie one level deep:
the first words of its names, each with the lengths of the names that begin so.  A
word of a question that begins no name goes no further; of the others the runs of
those lengths are joined with the names by equality.  So a question is never
compared with names it shares no word with, and both joins are on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The kinds, narrowest first; names below this length need the user's own casing unless they
# are acronyms; acronyms that are also noise; words for the whole world; words for a split by areas.
KINDS = ("company", "city", "country", "region", "world")
SHORT_NAME = 5
ACRONYM = "^[A-Z0-9&.-]+$"
NOISE = ["hmm"]
WORLD = r"(?i)\b(worldwide|globally|global|everywhere|all countries|world)\b"
AREAS = r"(?i)\b(across|compare|between|by (city|cities|region|state)|where)\b"


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits; null has none."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")


def _dictionary(names: DataFrame) -> DataFrame:
    """Names with their words, and with their words as the user must write them where casing counts."""
    cased = (F.col("kind") == "company") & (F.length("name") < SHORT_NAME) & (~F.col("name").rlike(ACRONYM) | F.lower("name").isin(NOISE))
    spelled = words(F.col("name"))
    rows = names.select("kind", "id", "name", "ordinal", F.transform(spelled, F.lower).alias("_w"), F.when(cased, F.array_join(spelled, " ")).alias("written"))
    return rows.where(F.size("_w") > 0).select("kind", "id", "name", "ordinal", "written", F.size("_w").alias("n"), F.col("_w")[0].alias("first"), F.array_join("_w", " ").alias("key"))


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, start, n, kind, id, name, ordinal): where a question's words are a name's, in any casing
    (short ordinary company names: in their own).

    ``questions`` has question_id and text, ``names`` kind, id, name and ordinal.  Null
    texts and names without a letter or digit match nothing.
    """
    known = _dictionary(names)
    longest = known.agg(F.max("n")).first()[0] or 1
    ahead = tx.let(words(F.col("text")), lambda ws: F.transform(ws, lambda _, i: F.slice(ws, i + 1, F.lit(longest))))  # cut once a text, not once a word
    at = questions.select("question_id", F.posexplode(ahead).alias("start", "ahead"))
    heads = known.select("first", "n").distinct()
    runs = at.withColumn("first", F.lower(F.col("ahead")[0])).join(heads, "first").where(F.size("ahead") >= F.col("n"))
    said = runs.select("question_id", "start", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("said")).withColumn("key", F.lower("said"))
    found = said.join(known.drop("first"), "key").where(F.col("written").isNull() | (F.col("written") == F.col("said")))
    return found.select("question_id", "start", "n", "kind", "id", "name", "ordinal")


def outermost(found: DataFrame) -> DataFrame:
    """Mentions that lie inside no other mention of their kind; of those on the same words the first by ordinal."""
    by = Window.partitionBy("question_id", "kind").orderBy("start", F.desc("n"), "ordinal")
    reach = F.max(F.col("start") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("start") + F.col("n") > F.col("_reach"))).drop("_reach")


def detect_scope(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, kind, id, name): the narrowest kind a question names, of these the longest name, then the first by ordinal.

    Questions that name nothing have no row.  Words for the whole world are a scope of their own, of id ''.
    """
    world = questions.where(F.col("text").rlike(WORLD)).select("question_id", F.lit("world").alias("kind"), F.lit("").alias("id"), F.lit("Worldwide").alias("name"), F.lit(None).cast(names.schema["ordinal"].dataType).alias("ordinal"))
    every = mentions(questions, names).select("question_id", "kind", F.col("id").cast("string").alias("id"), "name", "ordinal").unionByName(world)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = F.min_by(F.struct("kind", "id", "name"), F.struct(rank, -F.length("name"), F.col("ordinal"), F.col("id")))
    return every.groupBy("question_id").agg(best.alias("b")).select("question_id", "b.kind", "b.id", "b.name")


def wants_areas(question: Column) -> Column:
    """Does a sentence ask for a split by area?"""
    return F.coalesce(question, F.lit("")).rlike(AREAS)


def merge_turns(turns: DataFrame, fallback: Column) -> DataFrame:
    """Each turn with the intent, skill and scope that hold in it, and the names of those it took over.

    ``turns`` has thread, turn, text, skill and scope: what the sentence itself names, or
    null.  A sentence with an intent begins a new question.  Without one it is a pivot,
    which keeps the intent and, unless it names one, the skill.  The scope stays until
    a sentence names another; ``fallback`` holds before the first.  The fold is three
    running values over the thread: no thread is gathered into a list.
    """
    by = Window.partitionBy("thread").orderBy("turn")
    own = F.nullif(tx.intent(F.col("text")), F.lit("unknown"))
    rows = turns.withColumn("_own", own).withColumn("_nth", F.row_number().over(by)).withColumn("_question", F.count("_own").over(by))
    within = Window.partitionBy("thread", "_question").orderBy("turn")
    held = rows.withColumn("_intent", F.last("_own", ignorenulls=True).over(by)).withColumn("_skill", F.last("skill", ignorenulls=True).over(within)).withColumn("_scope", F.last("scope", ignorenulls=True).over(by))
    later = F.col("_nth") > 1
    taken = F.array_compact(
        F.array(
            F.when(later & F.col("_own").isNull(), "intent"),
            F.when(F.col("_own").isNull() & F.col("skill").isNull() & F.col("_skill").isNotNull(), "skill"),
            F.when(later & F.col("scope").isNull(), "scope"),
        )
    )
    return held.select(
        "thread",
        "turn",
        F.coalesce("_intent", F.lit("unknown")).alias("intent"),
        F.col("_skill").alias("skill"),
        F.coalesce("_scope", fallback).alias("scope"),
        wants_areas(F.col("text")).alias("wants_areas"),
        F.col("_own").isNotNull().alias("is_new"),
        taken.alias("inherited"),
    )


def follow_ups(current: DataFrame, alternatives: DataFrame, names: DataFrame, most: int = 4) -> DataFrame:
    """(turn_id, place, label, question): up to ``most`` questions worth asking next.

    ``current`` has turn_id, skill, kind, id and wants_areas; ``alternatives`` kind, id, label
    and ordinal.  An alternative is offered only where its own question leads back to
    it, and never the scope in play; a skill not yet split by area is offered as such, last.
    """
    asked = alternatives.select(F.col("ordinal").alias("question_id"), F.concat(F.lit("What about "), "label", F.lit("?")).alias("text"))
    landed = detect_scope(asked, names).select(F.col("question_id").alias("ordinal"), F.col("kind").alias("_kind"), F.col("id").alias("_id"))
    good = alternatives.join(landed, "ordinal").where((F.col("kind") == F.col("_kind")) & (F.col("id").cast("string") == F.col("_id")))
    # Of the good ones a turn can lose the scope in play alone, so the first few and one more are enough.
    few = good.orderBy("ordinal").limit(most + 1).select(F.struct("ordinal", "kind", F.col("id").cast("string").alias("id"), "label").alias("a"))
    listed = few.agg(F.sort_array(F.collect_list("a")).alias("_all"))
    offered = F.transform(
        F.filter("_all", lambda a: ~((a["kind"] == F.col("kind")) & (a["id"] == F.col("id").cast("string")))),
        lambda a: F.struct(a["label"].alias("label"), F.concat(F.lit("What about "), a["label"], F.lit("?")).alias("question")),
    )
    split = F.array(F.struct(F.lit("Across cities").alias("label"), F.concat(F.lit("How does "), "skill", F.lit(" compare across cities?")).alias("question")))
    several = F.concat(offered, F.when(F.col("skill").isNotNull() & ~F.col("wants_areas"), split).otherwise(F.slice(split, 1, 0)))
    rows = current.crossJoin(F.broadcast(listed)).select("turn_id", F.posexplode(F.slice(several, 1, most)).alias("place", "f"))  # one row of a few alternatives
    return rows.select("turn_id", (F.col("place") + 1).alias("place"), "f.label", "f.question")
