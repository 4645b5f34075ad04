"""The pipeline's stages and the operators under them on odd rows, and links that are hard to find."""

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joblattice.llm import near_dedup, packing, queries, substring_dedup
from joblattice.llm import license_scan

WORDS = " ".join(f"w{i}" for i in range(60))
NAMES = ("rank", "n_words", "n_removed", "kept_text", "kept_sha256", "k", "fp", "_k", "seen", "bucket", "start", "grp", "base")


def odd(spark):
    rows = [(None, WORDS, None), (None, WORDS + " more", "en"), (3, "other " + WORDS[::-1], "en"), (3, "other " + WORDS[::-1], "en"), (4, WORDS + " more", "en"), (5, None, "en"), (6, "", "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in NAMES:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


def test_near_duplicates_stage_keeps_one_row_of_each_group(spark):
    docs = odd(spark)
    kept = cp.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.rank) for r in kept.collect()) == sorted([(4, WORDS + " more", "own rank"), (3, "other " + WORDS[::-1], "own rank"), (5, "", "own rank"), (6, "", "own rank"), (-1, "", "own rank")])


def test_substring_stage_carries_clashing_columns(spark):
    docs = odd(spark)
    out = cp.substring_duplicates(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.rank for r in out.collect()} == {"own rank"}
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {""}  # null ids come last, and smaller ones hold it all


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_take_an_empty_table(spark, stage):
    assert stage(spark, odd(spark).where("false"), "").count() == 0


def test_operators_take_clashing_columns_and_empty_tables(spark):
    docs = odd(spark)
    path = queries.tokenizer_path("word_bpe_49k.json")
    for run in (near_dedup.similar_groups, substring_dedup.deduplicate, lambda d: license_scan.summary(license_scan.scan(d))):
        assert run(docs).count() == docs.count() and run(docs.where("false")).count() == 0
    assert packing.pack(docs, path).count() == docs.count() and packing.pack(docs.where("false"), path).count() == 0


def test_borderline_links_are_found(spark):
    """2,000 pairs between 0.80 and 0.85, half of them on pages that share most of their words."""
    rng = np.random.default_rng(3)
    base, texts, want = [f"b{i}" for i in range(150)], [], []
    for k in range(2000):
        common = base if k % 2 else [f"c{k}x{i}" for i in range(150)]
        own = [f"o{k}x{j}" for j in range(40)]
        cut = int(rng.integers(1, 9))
        other = own[: len(own) - cut] + [f"p{k}x{j}" for j in range(cut)]
        texts += [" ".join(common + own), " ".join(common + other)]
        a, b = (set(zip(t.split(), t.split()[1:], strict=False)) for t in texts[-2:])
        want.append(100 * len(a & b) >= 80 * len(a | b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs, width=2).collect()}
    linked = [got[2 * k + 1] == got[2 * k] for k in range(2000)]
    assert sum(want) > 1500 and linked == want


@pytest.mark.parametrize("doc_id", [None, 7])
def test_equal_rows_are_packed_in_many_groups(spark, doc_id):
    rows = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("three words here").alias("text"))
    packed = packing.pack(rows, queries.tokenizer_path("word_bpe_49k.json"), group_docs=100)
    groups = packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).count()
    assert packed.count() == 20_000 and groups.count() > 150 and groups.agg(F.max("count")).first()[0] < 250


def test_minwise_values_are_fetched_once_for_all_nodes(spark):
    """A join of every node's members with their values made up to 60 rows for each document of a large group."""
    docs = spark.createDataFrame([(i, f"{WORDS} own{i}") for i in range(40)], "doc_id long, text string")
    classes = near_dedup.sketches(docs, 5).select("fp", "sig", "s1", "s2").cache()
    rows = classes.mapInArrow(near_dedup._children(2, [11, 12, 13]), near_dedup._ROWS)
    held = near_dedup._looked_up(rows, classes)
    assert held.count() == 40 and {r.n for r in held.select(F.size("nodes").alias("n")).collect()} == {6}
    below = held.mapInArrow(near_dedup._children(2, None), near_dedup._ROWS)
    plain = {(r.tree, r.path, bytes(r.fp)): bytes(r.sig) for r in rows.join(classes.select("fp", "sig"), "fp").collect()}
    one = [{"fp": f, "sig": s, "s1": 0, "s2": 0, "nodes": [{"tree": t, "path": p}]} for (t, p, f), s in plain.items()]
    want = [b for b in near_dedup._children(2, None)([pa.RecordBatch.from_pylist(one, pa.schema([("fp", pa.binary()), ("sig", pa.binary()), ("s1", pa.int64()), ("s2", pa.int64()), ("nodes", pa.list_(pa.struct([("tree", pa.int32()), ("path", pa.int64())])))]))])]
    paths = sorted((t, p, f) for b in want for t, p, f in zip(*[b.column(c).to_pylist() for c in ("tree", "path", "fp")], strict=True))
    assert sorted((r.tree, r.path, bytes(r.fp)) for r in below.collect()) == paths and len(paths) == 40 * 12


@pytest.mark.parametrize("copies", [60, 240])
def test_nodes_of_a_large_group_are_joined_once_a_level(spark, monkeypatch, copies):
    """Each level's nodes were joined with their sizes twice; the rows are at most 12, 24, 24 and 24 a text, however large its group."""
    joined = []
    sized = near_dedup._sized
    monkeypatch.setattr(near_dedup, "_sized", lambda rows: joined.append((rows.count(), sized(rows).count())) or sized(rows))
    docs = spark.createDataFrame([(i, f"{WORDS} own{i}") for i in range(copies)], "doc_id long, text string")
    classes = near_dedup.sketches(docs, 5).cache()
    pairs, still = near_dedup.candidates(classes)
    assert len(joined) == 4 and all(m <= n <= k * copies for (n, m), k in zip(joined, (12, 24, 24, 24), strict=True))
    assert joined[0][1] > 10 * copies and still.count() > 20 * copies and pairs.count() >= copies - 1
