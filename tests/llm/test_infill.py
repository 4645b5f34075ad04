"""Fill-in-the-middle: Elias-Fano lists, cuts by brute force, copies, colliding hashes and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblattice.llm import infill

ODD = ["", None, "a", "é漢🙂 x", "has <P> in it", "ends <", "<S", "<<M", "x" * 5000 + "é" * 3000, "漢" * 4000, "\x00 \n", "same", "same", "same"]


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(text), "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, len(text), form, a, b - a, sha(output), sha(text), output


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "part", "row", "parts", "marked", "list", "texts", "digest", "copies"):
        docs = docs.withColumn(name, F.lit("own"))
    got = [tuple(r) for r in infill.transform(docs, with_output=True, **options).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)


@pytest.mark.parametrize("low", [1, 3, 17, 1000])
def test_lists_give_back_every_number(low):
    rng = np.random.default_rng(low)
    for n in (1, 2, 511, 512, 513, 3000):
        values = np.cumsum(rng.integers(0, low + 1, n))
        blob = infill.elias_fano(values)
        assert infill.length(blob) == n
        assert [infill.select(blob, i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        infill.select(blob, n)


def test_lists_of_texts_are_small_and_cut_between_code_points():
    text = "héllo 漢字 🙂 " * 400
    raw = text.encode()
    blob = infill.elias_fano(infill.code_point_offsets(raw))
    assert [raw[: infill.select(blob, i)].decode() for i in (0, 1, 2, 700, len(text))] == [text[:i] for i in (0, 1, 2, 700, len(text))]
    assert len(blob) < len(text) * 0.6


def test_borders_that_look_like_marks_are_restored():
    for form in ("psm", "spm"):
        for parts in ((b"a<", b"P>b", b"S>"), (b"<S", b">", b"<"), (b"", b"", b"x"), (b"M>", b"<M", b"<P")):
            assert infill.restore(infill.arrange(*parts, form), form) == b"".join(parts)


def test_odd_rows_copies_and_repeated_ids(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    check(spark, rows)


def test_texts_with_one_hash_are_told_apart(spark):
    rows = [(i, "".join(random.Random(i % 7).choices("ab é", k=6))) for i in range(200)]
    check(spark, rows, key=lambda text: F.length(text))


def test_a_third_of_all_rows_with_one_text_is_dealt_in_parts(spark):
    rows = [(i, "hot text é" if i % 3 else f"text {i}") for i in range(900)] + [(5, "hot text é")] * 50
    check(spark, rows, copies=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    most = infill.dealt(docs, copies=20).groupBy("key", "part").count().agg(F.max("count")).first()[0]
    assert most <= 60
    index = infill.text_index(infill.dealt(docs, copies=20))
    assert index.agg(F.sum("copies")).first()[0] == len(rows)


def test_an_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
