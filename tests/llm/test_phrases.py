"""Decontamination: the positional index against brute force, proximity, packed lists, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joblattice.llm import phrase_index as pi

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(docs, items, width=10):
    asked = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            asked.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in asked}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in asked:
                    hit |= set(range(i, i + n))
                    found |= {x for x in asked[g] if x is not None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for name in ("block", "terms", "window", "words", "items", "n_words"):
        d, i = d.withColumn(name, F.lit("own")), i.withColumn(name, F.lit("own"))
    return d, i


def check(spark, docs, items, **options):
    got = [tuple(r) for r in pi.contamination(*tables(spark, docs, items), **options).collect()]
    assert sorted(got, key=repr) == brute_force(docs, items, options.get("width", 10))


def some_texts(seed, n, vocabulary=6, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choices("abcdefghijklmnop"[:vocabulary], k=rng.randint(0, most))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    texts = ["Don't STOP-here_9", None, "", "é漢字 x\x00y\x7fz", "[]`{}~/:@ a", "ÀB c"]
    got = pi.plain_words(pa.array(texts))
    spelled = got.vocab.to_pylist()
    assert [[spelled[i] for i in got.ids[a:b]] for a, b in zip(got.bounds[:-1], got.bounds[1:], strict=True)] == [words(t) for t in texts]


@pytest.mark.parametrize("top", [1, 127, 128, 40_000, 1 << 34])
def test_packed_steps(top):
    steps = np.random.default_rng(top).integers(0, top + 1, 5000)
    assert pi.unpack_steps(pi.pack_steps(steps)).tolist() == steps.tolist()
    assert pi.unpack_steps(b"").tolist() == []


@pytest.mark.parametrize("block_bytes", [1, 400, 1 << 20])
def test_hits_by_brute_force(spark, block_bytes):
    docs = list(enumerate(some_texts(1, 150)))
    items = list(enumerate(some_texts(2, 12, most=14))) + [(50, " ".join(docs[7][1].split()[3:20])), (51, docs[8][1])]
    check(spark, docs, items, block_bytes=block_bytes)


def test_wide_windows_over_a_small_vocabulary(spark):
    docs = list(enumerate(some_texts(3, 80, vocabulary=2, most=200)))
    check(spark, docs, list(enumerate(some_texts(4, 6, vocabulary=2, most=12))), width=6, block_bytes=3000)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    docs = [(None, "a b c"), (1, None), (2, ""), (3, "A, b; C!"), (3, "a b c"), (3, "a b c"), (4, long), (5, "only here"), (None, None)]
    items = [(0, "b c"), (None, "a"), (7, None), (8, ""), (9, "b c"), (10, " ".join(f"w{i % 977}" for i in range(900, 1100))), (11, "absent word"), (12, "only")]
    check(spark, docs, items, block_bytes=100)


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a b")], [(1, "a")])
    assert pi.contamination(d.where("false"), i).collect() == []
    assert [r.n_hit for r in pi.contamination(d, i.where("false")).collect()] == [0]


def test_a_passage_in_a_third_of_all_documents(spark):
    passage = "one common passage of more than ten words that stands in very many documents"
    docs = [(k, f"x{k} {passage} y{k}" if k % 3 == 0 else f"z{k} other text") for k in range(600)]
    check(spark, docs, [(1, passage), (2, passage), (3, "z4 other")], block_bytes=500)


def test_places_and_proximity_by_brute_force(spark):
    docs = list(enumerate(some_texts(5, 60, vocabulary=8, most=40)))
    items = [(1, "a b c"), (2, "h a"), (3, "d d e"), (4, "q")]
    d, i = tables(spark, docs, items)
    index, windows = pi.build_index(d, 700), pi.written(pi.windows_of(i), "windows")
    spelled = {r.window: r.words for r in windows.collect()}
    places = {(r.doc_id, r.window, r.position) for r in pi.phrase_places(index, windows).collect()}
    assert places == {(k, w, p) for k, t in docs for w, g in spelled.items() for p in range(len(words(t))) if words(t)[p : p + len(g)] == g}
    near = {(r.doc_id, r.window, r.position) for r in pi.proximity(index, windows, span=6).collect()}
    assert near == {(k, w, p) for k, t in docs for w, g in spelled.items() for p in range(len(words(t))) if words(t)[p] in g and set(g) <= set(words(t)[p : p + 6])}
    with pytest.raises(ValueError):
        pi.proximity(index, windows, span=65)
