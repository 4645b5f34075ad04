"""The language model of the quality rules against a plain Python one, its slices and hash ranges, and odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from joblattice.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the cat sat on the mat and then the dog sat on the cat again while all the others went home to sleep in their own beds"
TEXTS = [PROSE, PROSE, PROSE.upper() + " é漢😀", "| a | b |\n| # | $ |", None, "", "ab", "one\ttwo\n\nthree " * 9]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS)


def symbols(text):
    return "\x02" * 4 + " ".join(WORD.findall((text or "").lower()))


def gram(hi, lo):
    points = [(hi >> 42) & 0x1FFFFF, (hi >> 21) & 0x1FFFFF, hi & 0x1FFFFF, lo >> 21, lo & 0x1FFFFF]
    return "".join(map(chr, points))


def python_model(texts, order=5):
    """Log probability of each n-gram of the highest order, by the textbook recursion over dictionaries."""
    counts = Counter(s[i : i + order] for s in map(symbols, texts) for i in range(len(s) - order + 1))
    levels = {order: counts}
    for size in range(order - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    offs = {}
    for size, level in levels.items():
        n = [sum(c == k for c in level.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else None
            offs[size, k] = d if d is not None and 0 < d < k else (0.5, 1.0, 1.5)[k - 1]
    following = defaultdict(list)
    for size, level in levels.items():
        for g, c in level.items():
            following[size, g[:-1]].append(c)

    def probability(g):
        size = len(g)
        if not size:
            return 1 / (len(levels[1]) + 1)
        after = following[size, g[:-1]]
        mass = sum(offs[size, min(c, 3)] for c in after) / sum(after)
        c = levels[size][g]
        return (c - offs[size, min(c, 3)]) / sum(after) + mass * probability(g[1:])

    return {g: math.log(probability(g)) for g in counts}


def test_counts_hold_every_document(spark):
    """Short texts, tables and code count like prose."""
    want = Counter(s[i : i + 5] for s in map(symbols, TEXTS) for i in range(len(s) - 4))
    got = quality.ngram_counts(documents(spark, [(t, "en") for t in TEXTS])).collect()
    assert {gram(r.hi, r.lo): r.c for r in got} == want


def test_model_equals_plain_python(spark):
    texts = {"en": TEXTS, "fr": [PROSE[20:], "le chat dort sur le tapis", "ab ab ab"], None: ["sans langue, sans loi"]}
    docs = documents(spark, [(t, lang) for lang, ts in texts.items() for t in ts])
    got = defaultdict(dict)
    for r in quality.kneser_ney(quality.ngram_counts(docs)).collect():
        got[r.lang][gram(r.hi, r.lo)] = r.logp
    for lang, ts in texts.items():
        want = python_model(ts)
        mine = got["" if lang is None else f"={lang}"]
        assert mine.keys() == want.keys() and all(abs(mine[g] - want[g]) < 1e-9 for g in want)


@pytest.mark.parametrize("sizes", [{}, {"range_rows": 300, "slice_bytes": 20_000, "slices_at_once": 2}])
def test_verdicts_by_plain_python(spark, sizes):
    """One slice and range, and many: perplexity, bands and verdicts of whole texts."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()
    pairs = [(r.text, r.lang) for r in rows] + [(t, None) for t in TEXTS] + [("zq#7 xj$9 " * 3 + " ".join(f"{i*i%97}#{i}" for i in range(90)), "en")]
    got = {r.doc_id: r for r in quality.judge(documents(spark, pairs), low_band=0.2, high_band=0.2, noise=1.0, **sizes).collect()}
    assert len(got) == len(pairs)
    of = defaultdict(list)
    for i, (t, lang) in enumerate(pairs):
        of[lang].append(i)
    seen = set()
    for _lang, ids in of.items():
        model = python_model([pairs[i][0] for i in ids])
        values = {i: np.array([np.float32(model[s[j : j + 5]]) for s in [symbols(pairs[i][0])] for j in range(len(s) - 4)], np.float64) for i in ids}
        good = [i for i in ids if not got[i].base_failed and len(values[i])]
        bins = sorted(math.floor(values[i].mean() / 0.01) for i in good)
        centre = bins[(len(bins) + 1) // 2 - 1] * 0.01 + 0.005
        every = np.concatenate([values[i] for i in good])
        for i in ids:
            if not len(values[i]):
                assert got[i].perplexity is None
                continue
            mean, slack = values[i].mean(), every.std() / math.sqrt(len(values[i]))
            assert abs(got[i].perplexity - math.exp(-mean)) < 1e-6 * math.exp(-mean) and abs(got[i].centre - centre) < 1e-9
            kept = not got[i].base_failed and -(0.2 + slack) <= mean - centre <= 0.2 + slack
            assert got[i].kept == kept
            seen.add(kept)
    assert seen == {True, False}


def test_bands_fitted_on_labels_by_plain_python(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    docs = documents(spark, [(r.text, "en" if i % 3 else None) for i, r in enumerate(rows)])
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, len(rows), 2)] + [(0, 1), (2, 1), (2, 1), (None, 1), (10**6, 1), (4, None)], "doc_id long, quality int")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    got = quality.judge(docs, labels, margin=0.5, least_good=5, low_band=0.01, high_band=0.01, noise=0.0).collect()
    n = {r.doc_id: len(symbols(rows[r.doc_id].text)) - 4 if rows[r.doc_id].text else 0 for r in got}
    class_of = lambda r: ("en" if r.doc_id % 3 else None, min(max(int(math.log2(n[r.doc_id])), 8), 13))
    means, seen = defaultdict(list), set()
    for r in got:
        if r.doc_id in good and not r.base_failed and n[r.doc_id] > 0:
            means[class_of(r)].append(-math.log(r.perplexity))
    for r in got:
        if n[r.doc_id] <= 0 or r.base_failed:
            assert not r.kept
            continue
        known, mean = means[class_of(r)], -math.log(r.perplexity)
        if len(known) >= 5:
            wide = 0.5 * np.std(known, ddof=1)
            low, high = min(known) - wide, max(known) + wide
        else:
            low, high = r.centre - 0.01, r.centre + 0.01
        assert r.kept == (low <= mean <= high) or min(abs(mean - low), abs(mean - high)) < 1e-9
        seen.add((len(known) >= 5, r.kept))
    assert len(seen) == 4


def test_odd_rows_and_columns(spark):
    rows = [(None, PROSE, None), (1, PROSE, "en"), (1, PROSE, "en"), (2, None, "en"), (3, "é " * 30_000, ""), (4, PROSE, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("kept", "n_words", "slice", "carried_text", "salt", "c0", "part"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((r.doc_id or 0, r.lang or "", r.kept, r.part) for r in kept.collect()) == [(0, "", "own kept", "own part"), (1, "en", "own kept", "own part"), (1, "en", "own kept", "own part"), (4, "", "own kept", "own part")]
    assert quality.judge(docs).count() == len(rows)
    assert quality.judge(docs.where("false")).count() == 0 and quality.kept_documents(docs.where("false")).count() == 0


def test_many_languages_are_joined_by_shuffle(spark, monkeypatch):
    docs = documents(spark, [(PROSE + f" {i % 5}", f"l{i % 5}") for i in range(20)])
    want = sorted(map(str, quality.judge(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 2)
    assert sorted(map(str, quality.judge(docs).collect())) == want


def test_small_parts_are_read_together_and_united_rarely(monkeypatch):
    """Fifty parts of a slice are one batch, and a sorted whole is not sorted again for every run of hashes."""
    parts = []
    for i in range(50):
        batch, sink = pa.record_batch([pa.array([i]), pa.array([f"text {i}"])], names=["doc_id", "text"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        parts.append(sink.getvalue().to_pybytes())
    read = list(quality._unpacked(pa.table({"part": pa.array(parts, pa.binary())})))
    assert [b.num_rows for b in read] == [50] and read[0].column("doc_id").to_pylist() == list(range(50))
    monkeypatch.setattr(quality, "_CHARS", 10)
    runs = [np.random.default_rng(i).integers(0, 500, 40).astype(np.uint64) for i in range(30)]
    assert (quality._distinct(iter(runs)) == np.unique(np.concatenate(runs))).all() and not len(quality._distinct(iter([])))
