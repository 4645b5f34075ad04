"""Scope detection, turn merging and suggestions on hand-made questions, and against a plain fold."""

import random
import time

from pyspark.sql import functions as F

from joblattice.operators import scope

NAMES = [
    ("company", "c1", "BHP"), ("company", "c2", "EY"), ("company", "c3", "Visa"), ("company", "c4", "HMM"), ("company", "c5", "Zip"), ("company", "c6", "Rio Tinto"), ("company", "c7", "!!!"),
    ("city", "syd", "Sydney"), ("city", "per", "Perth"), ("country", "nz", "New Zealand"), ("country", "zl", "Zealand"), ("country", "au", "Australia"), ("region", "au-nz", "australia"),
]
CASES = {
    "What about Sydney?": ("city", "syd"),
    "how is bhp hiring in Perth": ("company", "c1"),
    "which roles offer visa sponsorship": None,
    "does Visa hire": ("company", "c3"),
    "hmm, what about perth": ("city", "per"),
    "HMM in perth": ("company", "c4"),
    "zip it": None,
    "rio-tinto in new   zealand": ("company", "c6"),
    "the pay in new zealand": ("country", "nz"),
    "Australia?": ("country", "au"),
    "all countries please": ("world", ""),
    "worldwidely": None,
    "": None,
    None: None,
    "?!": None,
}


def names(spark):
    return spark.createDataFrame([(k, i, n, o) for o, (k, i, n) in enumerate(NAMES)], "kind string, id string, name string, ordinal long")


def test_scope_of_questions(spark):
    texts = list(CASES)
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id long, text string")
    got = {texts[r.question_id]: (r.kind, r.id) for r in scope.detect_scope(asked, names(spark)).collect()}
    assert got == {t: v for t, v in CASES.items() if v}
    assert scope.detect_scope(asked, names(spark).where("false")).count() == 1  # the world needs no dictionary


def test_names_inside_longer_ones_are_left_out(spark):
    asked = spark.createDataFrame([(1, "from New Zealand to Zealand and Sydney")], "question_id long, text string")
    kept = scope.outermost(scope.mentions(asked, names(spark)))
    assert sorted((r.start, r.name) for r in kept.collect()) == [(1, "New Zealand"), (4, "Zealand"), (6, "Sydney")]


def test_a_long_text_is_cut_into_words_once(spark):
    """Findings 3 to 6: cutting the text again for each of its words took the square of its length."""
    asked = spark.range(1).select(F.col("id").alias("question_id"), F.repeat(F.lit("so new zealand "), 30_000).alias("text"))
    begun = time.monotonic()
    assert scope.mentions(asked, names(spark)).count() == 60_000  # each place, and the part of its name that is one
    assert time.monotonic() - begun < 60


def fold(turns, fallback):
    state, out = None, []
    for text, own, skill, place in turns:
        taken, new = [], own != "unknown"
        intent = own
        if not new and state:
            intent = state[0]
            taken.append("intent")
        held = skill
        if not skill and not new and state and state[1]:
            held = state[1]
            taken.append("skill")
        where = place
        if not place:
            where = state[2] if state else fallback
            if state:
                taken.append("scope")
        state = (intent, held, where)
        out.append((*state, new, taken))
    return out


def test_turns_are_folded_like_a_plain_loop(spark):
    rng = random.Random(3)
    wording = {"unknown": "and there", "pay": "the salary", "volume": "how many"}
    threads = {k: [(wording[own := rng.choice(list(wording))], own, rng.choice([None, "sql", "java"]), rng.choice([None, None, "x", "y"])) for _ in range(rng.randint(1, 9))] for k in range(60)}
    rows = [(k, i, t, s, p) for k, turns in threads.items() for i, (t, _, s, p) in enumerate(turns)]
    out = scope.merge_turns(spark.createDataFrame(rows, "thread long, turn long, text string, skill string, scope string"), F.lit("home"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.thread, r.turn)):
        got.setdefault(r.thread, []).append((r.intent, r.skill, r.scope, r.is_new, r.inherited))
    assert got == {k: fold(turns, "home") for k, turns in threads.items()}


def test_suggestions_lead_where_they_say(spark):
    alternatives = spark.createDataFrame([("country", "au", "Australia", 1), ("region", "au-nz", "Australia", 2), ("city", "syd", "Sydney", 3), ("company", "c3", "Visa", 4), ("city", "per", "Perth", 5), ("company", "c1", "BHP", 6)], "kind string, id string, label string, ordinal long")
    current = spark.createDataFrame([(1, "sql", "city", "syd", False), (2, None, "world", "", False), (3, "sql", "world", "", True)], "turn_id long, skill string, kind string, id string, wants_areas boolean")
    got = {}
    for r in sorted(scope.follow_ups(current, alternatives, names(spark)).collect(), key=lambda r: (r.turn_id, r.place)):
        got.setdefault(r.turn_id, []).append(r.label)
    assert got == {1: ["Australia", "Visa", "Perth", "BHP"], 2: ["Australia", "Sydney", "Visa", "Perth"], 3: ["Australia", "Sydney", "Visa", "Perth"]}
    few = scope.follow_ups(current, alternatives.where("ordinal < 4"), names(spark))
    assert [r.label for r in few.where("turn_id = 1").orderBy("place").collect()] == ["Australia", "Across cities"]
