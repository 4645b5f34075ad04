"""Cross-tokenizer alignment: encoding, links, groups and counts against plain Python, shards, and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from joblattice.llm import token_alignment as ta
from joblattice.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  two  spaces ", "line\nbreaks \n x", "é漢字🙂 ß", "▁ sign", "<|endoftext|> </s> <s>", "\x00 null", "tab\tend ", "ﬁ ligature ①", "it's don't", "a b 　c", "é x", "word " * 3000, "x" * 3000, " ́x"]


@pytest.fixture(scope="module")
def both():
    return ta.ByteLevel(PATHS[0]), ta.Pieces(PATHS[1])


def tokens(text, both):
    """(id, bytes) of each token of both, straight from the libraries; None where the bytes differ."""
    one, two = both
    a, b = one.tokenizer.encode(" " + text, add_special_tokens=False).ids, two.model.encode(text)
    byte = ta._byte_level()
    spelled_a = [bytes(byte[c] for c in one.tokenizer.id_to_token(i)) for i in a]
    spelled_b = [bytes([int(p[3:5], 16)]) if two.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, two.model.id_to_piece(i)) for i in b)]
    same = b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode()
    return (list(zip(a, spelled_a, strict=True)), list(zip(b, spelled_b, strict=True))) if text and same else None


def ranges(side):
    at, out = 0, []
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute_force(docs, both):
    rows, held = [], Counter()
    for doc_id, text in docs:
        sides = tokens(text or "", both)
        a, b = map(ranges, sides) if sides else ([], [])
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = ["|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts)]
        held.update(set(links))
        rows.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (x, _), c in held.items():
        best[x] = max(best.get(x, 0), c)
    return sorted(((d, na, nb, g, len(p), sum(held[q] == best[q[0]] for q in p), sum(held[q] for q in p), h) for d, na, nb, g, p, h in rows), key=repr)


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "c", "a", "b", "n_links"):
        docs = docs.withColumn(name, F.lit("own"))
    return sorted((tuple(r) for r in ta.align(docs, *PATHS, **options).collect()), key=repr)


def test_odd_rows_by_brute_force(spark, both):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a"), (3, "a"), (3, "a b")]
    assert got(spark, rows, shard_pairs=50) == brute_force([(i, t if len(t or "") < 4000 else t[:0] + t) for i, t in rows], both)


def test_documents_by_brute_force(spark, both):
    docs = [(r.doc_id, (r.text or "")[:1500]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(spark, docs, shard_pairs=700) == brute_force(docs, both)


def test_whole_documents_have_the_counts_of_any_sharding(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, many = (sorted(map(tuple, ta.align(docs, *PATHS, shard_pairs=n).collect()), key=repr) for n in (10**7, 5000))
    assert one == many and sum(r[1] for r in one)


def test_an_empty_table(spark):
    assert got(spark, []) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t▁'<|>abé 漢"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_word_by_word_is_encoded_like_the_whole(both, texts):
    one, two = both
    for text, a, b in zip(texts, *ta.ids_of(texts, one, two), strict=True):
        if not text:
            continue
        assert np.frombuffer(a, "<u4").tolist() == Tokenizer.encode(one.tokenizer, " " + text, add_special_tokens=False).ids
        assert np.frombuffer(b, "<u4").tolist() == two.model.encode(text)


def test_runs_of_equal_keys_are_summed_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(50) << 32 | rng.randrange(9), rng.randrange(1, 5)) for _ in range(30_000)]
    partial = spark.createDataFrame(rows, "key long, c long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    made = ta.shards(partial, str(tmp_path), 5).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for k, c in rows:
        want[k] += c
    known = ta.Counts(made, 50)
    keys = np.array(sorted([*want, 1 << 40]))
    assert known.of(keys).tolist() == [want.get(k, 0) for k in keys.tolist()]
    assert known.best.tolist() == [max(c for k, c in want.items() if k >> 32 == a) for a in range(50)]
    assert sum(r.n for r in made) == len(want)


def test_a_partition_with_many_pairs_is_flushed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    size_a, size_b = (ta._loaded(k, p).vocabulary.size for k, p in zip((ta.ByteLevel, ta.Pieces), PATHS))
    tokens = ta.encoded(docs, *PATHS)
    one, many = (sorted(map(tuple, ta.partial_counts(tokens, size_a, size_b, n).groupBy("key").agg(F.sum("c")).collect())) for n in (10**7, 500))
    assert one == many


def test_spelled_ids():
    assert ta._spelled(2, ",|").to_pylist() == ["0,", "1,", "0|", "1|"] and ta._spelled(2, ",|").type == pa.large_string()
