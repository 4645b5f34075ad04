"""Quality rules: word and line statistics, and perplexity bands per language.

The language model is an interpolated modified Kneser-Ney model over characters
(order 5, lower-cased, white space as one blank), one per value of ``lang``.
Spark counts the character n-grams of every document: tasks count their batch
with packed symbols, a shuffle adds the counts up.  Every document counts with
weight 1, whatever its length, symbols, copies or source.  Since all documents
are counted, every n-gram that scoring meets has its entry, so one table (n-gram,
log probability) is the whole model and no back-off is needed at scoring time.

The model is a table of sorted arrays: a row holds the 64-bit n-gram hashes of one
hash range, sorted, and their log probabilities.  Documents are dealt by a hash
into slices of about ``slice_bytes`` of text, compressed.  Each slice asks for its
distinct n-grams once; the questions are dealt to the model's hash ranges, at most
``slices_at_once`` slices to a task, answered there by binary search, and come back
to the slice, whose texts are then scored.  So neither the driver nor any
broadcast holds a part of the model, a task holds one slice or one hash range, and
the texts are shuffled once, however large the model.

Bands: a language's centre is the median of its documents' mean log probability
(on a grid of 0.01), its spread ``s`` the standard deviation of the log
probability of one character.  A document of n characters is rejected if its mean
lies outside centre -/+ (band + noise * s / sqrt(n)), with separate upper and
lower bands.  Only documents that passed the base rules set the centre.

Where labels are given, the bands are fitted: for each language and each doubling of
the length (below 512 characters and from 8,192 on one class each) they reach from the lowest to the
highest mean of the documents labelled good, and ``margin`` standard deviations of
these beyond.  All labelled rows count; a class with fewer than ``least_good`` of
them keeps the bands above.

Edge cases: null and empty texts have no words and fail the base rules; a null
language is a language of its own; a document without characters is not scored
(perplexity null); rows with equal or null doc_id are separate rows; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .store import forget, written

ORDER = 5
_BITS = 12
_POINT = 21
_PAD = "\x02" * (ORDER - 1)
_CHARS = 1_000_000
_TOGETHER = 8 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "[#*$%&|<>]"
STATS = [c.split()[0] for c in BASE_SCHEMA.split(", ")]
SCORE_SCHEMA = f"{BASE_SCHEMA}, n_scored long, log_sum double, square_sum double"
#: Tables of one row per language are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_LANGUAGES = 20_000


# ---------------------------------------------------------------- base rules


def base_statistics(texts: pa.Array, window: int = 8) -> list[pa.Array]:
    """The columns of BASE_SCHEMA for a batch of texts."""
    texts = tk.one_array(texts)
    words = tk.split_words(texts)
    n = len(texts)

    def per_text(of_vocab) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of_vocab.to_numpy(zero_copy_only=False)[words.ids], dtype=np.int64)))
        return np.diff(sums[words.bounds])

    chars = per_text(pc.utf8_length(words.vocab))
    symbols = per_text(pc.count_substring_regex(words.vocab, SYMBOLS))
    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    has_word = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    use = has_word[code] if len(code) else np.zeros(0, bool)
    distinct = np.unique(owner[use] * max(1, len(has_word)) + code[use])
    dup = np.bincount(owner[use], minlength=n) - np.bincount(distinct // max(1, len(has_word)), minlength=n)
    repeat = _repeated_words(words, window)
    sums = np.concatenate(([0], np.cumsum(repeat)))
    columns = (words.counts, chars, symbols, dup, np.diff(sums[words.bounds]))
    return [pa.array(c.astype(np.int64)) for c in columns]


def _repeated_words(words: tk.Words, window: int) -> np.ndarray:
    """Word positions covered by a window that its text holds at least twice."""
    at = np.flatnonzero(tk.window_starts(words.bounds, window))
    flag = np.zeros(len(words.ids), bool)
    word = tk.mix(words.ids.astype(np.uint64) + _GOLD)  # windows are compared within a text only, so a word's number will do
    h = tk.mix(tk.window_hashes(word, window)[at] + tk.mix(words.owner()[at].astype(np.uint64)))
    ranked = np.sort(h)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        some = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        h, at = h[some], at[some]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        same = np.flatnonzero(h[1:] == h[:-1])
        a, b = at[same], at[same + 1]
        for j in range(window):
            equal = words.ids[a + j] == words.ids[b + j]
            a, b = a[equal], b[equal]
        flag[a] = flag[b] = True
    return tk.covered(flag, window)


# ------------------------------------------------------------ symbol n-grams


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``_CHARS`` characters; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + _CHARS, side="right")))
        yield a, b
        a = b


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts, each behind its padding, as code points; and their bounds."""
    plain = tk.joined(tk.split_words(pc.utf8_lower(texts)))
    padded = pc.binary_join_element_wise(pa.scalar(_PAD, plain.type), plain, pa.scalar("", plain.type))
    points = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(pc.utf8_length(padded).to_numpy())))


def _packed(points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Windows [a, b) of symbols, their packed n-grams, and the alphabet of the packing.

    A stretch of more than ``_CHARS`` symbols, or with more different ones than fit
    the packing, is halved.
    """
    todo = [(0, max(0, len(points) - ORDER + 1))]
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        part = points[a : b + ORDER - 1]
        seen = np.zeros(0x110000, bool)
        seen[part] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        if b - a > 2 * _CHARS or len(alphabet) >= 1 << _BITS:
            mid = (a + b) // 2
            todo += [(mid, b), (a, mid)]
            continue
        rank = np.zeros(0x110000, np.uint16)
        rank[alphabet] = np.arange(len(alphabet))
        code = rank[part].astype(np.uint64)
        key = code[: b - a].copy()
        for j in range(1, ORDER):
            key <<= np.uint64(_BITS)
            key |= code[j : b - a + j]
        yield a, b, key, alphabet


def _grams(keys: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams as two numbers of 21 bits a code point: all but the last two, and the last two."""
    wide = alphabet.astype(np.int64)
    code = [wide[((keys >> np.uint64(_BITS * j)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)] for j in range(ORDER - 1, -1, -1)]
    hi = np.zeros(len(keys), np.int64)
    for c in code[:-2]:
        hi = (hi << _POINT) | c
    return hi, (code[-2] << _POINT) | code[-1]


def _language(lang: Column) -> Column:
    """A name for each value of ``lang`` that is never null: null has one that no other value has."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _by_language(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    coded = column.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(coded.dictionary.to_pylist()):
        yield name, np.flatnonzero(code == i)


def _distinct_grams(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, hi, lo, count) of the n-grams of each portion of a batch of texts."""
    for lang, rows in _by_language(langs):
        mine = texts.take(pa.array(rows))
        for x, y in _portions(mine):
            points, bounds = _code_points(mine.slice(x, y - x))
            valid = tk.window_starts(bounds, ORDER)
            for a, b, key, alphabet in _packed(points):
                coded = pa.array(key[valid[a:b]]).dictionary_encode()
                count = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield lang, *_grams(coded.dictionary.to_numpy(), alphabet), count


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, hi, lo, c): every character n-gram of all texts of a language, and how often it stands in them.

    ``hi`` and ``lo`` hold the n-gram's code points, as :func:`_grams` packs them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tk.give_back()
            for lang, hi, lo, c in _distinct_grams(batch.column(0), tk.one_array(batch.column(1))):
                yield pa.record_batch([pa.array([lang] * len(hi), pa.string()), pa.array(hi), pa.array(lo), pa.array(c, pa.int64())], names=["lang", "hi", "lo", "c"])

    rows = docs.select(_language(F.col("lang")).alias("lang"), "text")
    return rows.mapInArrow(count, "lang string, hi long, lo long, c long").groupBy("lang", "hi", "lo").agg(F.sum("c").alias("c"))


# ------------------------------------------------------- modified Kneser-Ney


def _with_language(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` left-joined with a table of one row per ``lang``, which is broadcast only while it is small."""
    known = written(table, "languages")
    if known.count() <= BROADCAST_LANGUAGES:
        return rows.join(F.broadcast(known), "lang", "left")
    salts = 64  # a language may hold a third of all rows
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(salts)).cast("int"))
    return salted.join(spread, ["lang", "salt"], "left").drop("salt")


def _suffix(size: int) -> list[Column]:
    """The last ``size`` symbols of an n-gram of one more."""
    return [F.col(c).bitwiseAND(F.lit((1 << (_POINT * n)) - 1)).alias(c) for c, n in (("hi", max(0, size - 2)), ("lo", min(size, 2)))]


def _context() -> list[Column]:
    """An n-gram without its last symbol."""
    low = F.col("hi").bitwiseAND(F.lit((1 << _POINT) - 1))
    return [F.shiftright("hi", _POINT).alias("chi"), F.shiftleft(low, _POINT).bitwiseOR(F.shiftright("lo", _POINT)).alias("clo")]


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language the three discounts from the numbers of n-grams counted 1 to 4 times."""
    n = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0))
    raw = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0)) for k in (1, 2, 3)]
    usual = (0.5, 1.0, 1.5)
    use = [F.coalesce(F.when((d > 0) & (d < k), d), F.lit(u)).alias(f"d{k}") for k, d, u in zip((1, 2, 3), raw, usual, strict=True)]
    return counts.groupBy("lang").agg(*n).select("lang", *use)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, hi, lo, logp) for every n-gram of the highest order, natural logarithms.

    The highest order uses plain counts, the lower ones the number of different
    symbols seen before the n-gram; the lowest is mixed with the uniform
    distribution over the language's symbols and one more.  Each order is written
    before the next one reads it, and forgotten once it is used.
    """
    levels = [written(counts, "counts")]
    for size in range(order - 1, 0, -1):
        longer = levels[-1].select("lang", *_suffix(size))
        levels.append(written(longer.groupBy("lang", "hi", "lo").agg(F.count(F.lit(1)).alias("c")), f"level{size}"))
    below = None
    for size in range(1, order + 1):
        counted = levels[order - size]
        level = _with_language(counted, _discounts(counted)).select("*", *_context())
        n1, n2, n3 = (F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count_if(F.col("c") >= 3))
        mass = (F.first("d1") * n1 + F.first("d2") * n2 + F.first("d3") * n3) / F.sum("c")
        context = level.groupBy("lang", "chi", "clo").agg(F.sum("c").alias("total"), mass.alias("gamma"))
        joined = level.join(context, ["lang", "chi", "clo"])
        if below is None:
            joined = _with_language(joined, counted.groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("q")))
        else:
            names = [F.col(c).alias(f"s{c}") for c in ("hi", "lo")]
            short = below.select("lang", *names, "q")
            keyed = joined.select("*", *[c.alias(f"s{n}") for c, n in zip(_suffix(size - 1), ("hi", "lo"), strict=True)])
            joined = keyed.join(short, ["lang", "shi", "slo"])
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = (F.col("c") - off) / F.col("total") + F.col("gamma") * F.col("q")
        new = written(joined.select("lang", "hi", "lo", p.alias("q")), f"order{size}")
        for table in [counted] if below is None else [counted, below]:
            forget(table)
        below = new
    model = below.select("lang", "hi", "lo", F.log("q").alias("logp"))
    model.folder = below.folder
    return model


def _hashes(lang: str, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of a language."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return tk.mix(tk.mix(hi.astype(np.uint64) * _GOLD + seed) + lo.astype(np.uint64))


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges of the hash values; rising with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def sorted_arrays(model: DataFrame, ranges: int) -> DataFrame:
    """(r, h, p): the hashes of hash range r, sorted, and their log probabilities."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, p = (batch.column(c).to_numpy() for c in (1, 2, 3))
            for lang, rows in _by_language(batch.column(0)):
                h = _hashes(lang, hi[rows], lo[rows])
                yield pa.record_batch([pa.array(_range_of(h, ranges)), pa.array(h.view(np.int64)), pa.array(p[rows].astype(np.float32))], names=["r", "h", "p"])

    def sort(key, table):
        h, p = table.column("h").to_numpy().view(np.uint64), table.column("p").to_numpy()
        order = np.argsort(h)
        return pa.table({"r": pa.array([key[0].as_py()], pa.int32()), "h": [h[order].tobytes()], "p": [p[order].tobytes()]})

    return model.mapInArrow(hash_rows, "r int, h long, p float").groupBy("r").applyInArrow(sort, "r int, h binary, p binary")


# ------------------------------------------------------------------- scoring


def slices_of(docs: DataFrame, slices: int, carry: tuple[str, ...]) -> DataFrame:
    """(slice, part): the rows dealt by a hash of id and text; a part holds rows of one slice as a compressed Arrow stream.

    A part's columns are doc_id, lang, text and the other columns to carry, as c0, c1, ...
    """
    along = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if c != "text"]
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).alias("slice"), F.col("doc_id").cast("long").alias("doc_id"), _language(F.col("lang")).alias("lang"), "text", *along)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
        for batch in batches:
            of = batch.column(0).to_numpy()
            names, parts = np.unique(of), []
            for s in names.tolist():
                rows_of = batch.take(pa.array(np.flatnonzero(of == s)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows_of.schema, options=options) as stream:
                    stream.write_batch(rows_of)
                parts.append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(parts, pa.binary())], names=["slice", "part"])
            tk.give_back()

    return rows.mapInArrow(deal, "slice long, part binary")


def _unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a slice's parts, about ``_TOGETHER`` bytes at a time."""
    held, size = [], 0
    for part in table.column("part"):
        for batch in pa.ipc.open_stream(part.as_buffer()):
            held.append(batch)
            size += batch.nbytes
            if size >= _TOGETHER:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _distinct(runs: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct values of all runs, sorted; they are united whenever the unsorted ones outgrow the sorted."""
    whole, waiting, size = np.zeros(0, np.uint64), [], 0

    def united() -> np.ndarray:
        values = np.concatenate([whole, *waiting])
        values.sort()
        return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]

    for run in runs:
        waiting.append(run)
        size += len(run)
        if size > max(len(whole), _CHARS):
            whole, waiting, size = united(), [], 0
    return united()


def questions(parts: DataFrame, ranges: int, slices_at_once: int) -> DataFrame:
    """(r, turn, slice, h): the distinct n-gram hashes of a slice in hash range r, sorted."""

    def ask(key, table):
        grams = (x for batch in _unpacked(table) for x in _distinct_grams(batch.column("lang"), tk.one_array(batch.column("text"))))
        h, s = _distinct(_hashes(lang, hi, lo) for lang, hi, lo, _ in grams), key[0].as_py()
        tk.give_back()
        r = _range_of(h, ranges)
        cuts = np.flatnonzero(np.diff(r)) + 1
        pieces = np.split(h, cuts) if len(h) else []
        n = len(pieces)
        names = r[np.concatenate(([0], cuts))] if n else np.zeros(0, np.int32)
        return pa.table({"r": pa.array(names, pa.int32()), "turn": pa.array([s // slices_at_once] * n, pa.int64()), "slice": pa.array([s] * n, pa.int64()), "h": pa.array([x.tobytes() for x in pieces], pa.binary())})

    return parts.groupBy("slice").applyInArrow(ask, "r int, turn long, slice long, h binary")


def answers(asked: DataFrame, arrays: DataFrame, turns: int) -> DataFrame:
    """(slice, r, h, p): the log probabilities of the asked hashes, found by binary search."""

    def find(asking, model):
        if not asking.num_rows:
            return pa.table({"slice": pa.array([], pa.int64()), "r": pa.array([], pa.int32()), "h": pa.array([], pa.binary()), "p": pa.array([], pa.binary())})
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in model.column("h")] or [np.zeros(0, np.uint64)])
        p = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in model.column("p")] or [np.zeros(0, np.float32)])
        found = []
        for want in asking.column("h"):
            keys = np.frombuffer(want.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(h, keys), max(0, len(h) - 1))
            found.append((np.where(h[at] == keys, p[at], 0) if len(h) else np.zeros(len(keys))).astype(np.float32).tobytes())
        return pa.table({"slice": asking.column("slice"), "r": asking.column("r"), "h": asking.column("h"), "p": pa.array(found, pa.binary())})

    each_turn = arrays.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    return asked.groupBy("r", "turn").cogroup(each_turn.groupBy("r", "turn")).applyInArrow(find, "slice long, r int, h binary, p binary")


def _score(langs: pa.Array, texts: pa.Array, h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: scored symbols, sum of log probabilities and of their squares."""
    n, total, squares = (np.zeros(len(texts), t) for t in (np.int64, np.float64, np.float64))
    for lang, rows in _by_language(langs):
        mine = texts.take(pa.array(rows))
        for x, y in _portions(mine):
            points, bounds = _code_points(mine.slice(x, y - x))
            value = np.zeros(len(points) + 1)
            for a, b, key, alphabet in _packed(points):
                coded = pa.array(key).dictionary_encode()
                want = _hashes(lang, *_grams(coded.dictionary.to_numpy(), alphabet))
                at = np.minimum(np.searchsorted(h, want), max(0, len(h) - 1))
                found = np.where(h[at] == want, p[at], 0) if len(h) else np.zeros(len(want))
                value[a:b] = found.astype(np.float64)[coded.indices.to_numpy()]
            valid = tk.window_starts(bounds, ORDER)
            value[: len(valid)][~valid] = 0
            for out, v in ((total, value), (squares, value * value)):
                sums = np.concatenate(([0], np.cumsum(v[: len(points)])))
                out[rows[x:y]] = np.diff(sums[bounds])
            n[rows[x:y]] = np.diff(bounds) - (ORDER - 1)
    return n, total, squares


def scored(parts: DataFrame, answered: DataFrame, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of each slice with base statistics and sums of log probabilities."""
    along = ["text" if c == "text" else f"c{i}" for i, c in enumerate(carry)]

    def score(rows, known):
        known = known.sort_by("r")
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in known.column("h")] or [np.zeros(0, np.uint64)])
        p = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in known.column("p")] or [np.zeros(0, np.float32)])
        out = []
        for batch in _unpacked(rows):
            texts = tk.one_array(batch.column("text"))
            base = [pa.chunked_array(c) for c in zip(*[base_statistics(texts.slice(a, b - a)) for a, b in _portions(texts)], strict=True)]
            sums = [pa.array(x) for x in _score(batch.column("lang"), texts, h, p)]
            cols = [*[batch.column(c) for c in ("doc_id", "lang", *along)], *base, *sums]
            out.append(pa.table(cols, names=["doc_id", "lang", *[f"c{i}" for i in range(len(along))], *[c.split()[0] for c in SCORE_SCHEMA.split(", ")]]))
            tk.give_back()
        return pa.concat_tables(out)

    return parts.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(score, schema)


def bands(rows: DataFrame, grid: float = 0.01) -> DataFrame:
    """Per language the centre and the spread of one symbol's log probability.

    The median is read off a histogram on a fixed grid, so that no group of
    documents is gathered; its size is bounded by the range of the means.
    """
    good = rows.where(~F.col("base_failed") & (F.col("n_scored") > 0))
    mean = F.col("log_sum") / F.col("n_scored")
    hist = good.groupBy("lang", F.floor(mean / grid).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_scored").alias("k"), F.sum("log_sum").alias("s1"), F.sum("square_sum").alias("s2"))
    by = Window.partitionBy("lang")
    run = F.sum("n").over(by.orderBy("bin"))
    marked = hist.select("*", run.alias("run"), F.sum("n").over(by).alias("all"))
    k, s1, s2 = F.sum("k"), F.sum("s1"), F.sum("s2")
    spread = F.sqrt(F.greatest(s2 / k - (s1 / k) * (s1 / k), F.lit(0.0)))
    centre = F.min(F.when(F.col("run") * 2 >= F.col("all"), F.col("bin"))) * grid + grid / 2
    return marked.groupBy("lang").agg(centre.alias("centre"), spread.alias("spread"))


def _length_class(n: Column) -> Column:
    """Doublings of the length, from 8 to 13."""
    return F.least(F.greatest(F.floor(F.log2(n)), F.lit(8)), F.lit(13)).cast("int")


def fitted_bands(rows: DataFrame, labels: DataFrame, margin: float, least_good: int) -> DataFrame:
    """(lang, fitted): per language the lowest and highest mean log probability to keep, by length class.

    ``labels`` has doc_id and quality, 1 for good.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    mean = F.col("log_sum") / F.col("n_scored")
    seen = rows.where(~F.col("base_failed") & (F.col("n_scored") > 0)).select("doc_id", "lang", _length_class(F.col("n_scored")).alias("class"), mean.alias("mean")).join(good, "doc_id", "left_semi")
    wide = margin * F.stddev_samp("mean")
    by_class = seen.groupBy("lang", "class").agg((F.min("mean") - wide).alias("low"), (F.max("mean") + wide).alias("high"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, least_good))
    return by_class.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("low", "high")))).alias("fitted"))  # six classes at most


def judge(
    docs: DataFrame,
    labels: DataFrame | None = None,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    low_band: float = 0.35,
    high_band: float = 0.35,
    noise: float = 4.0,
    range_rows: int = 200_000,
    slice_bytes: int = 32 << 20,
    slices_at_once: int = 1024,
    margin: float = 1.0,
    least_good: int = 50,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Statistics and verdict per document, and the columns to carry under their names with ``carried_``.

    ``low_band`` bounds how much better than its language's centre the model may
    predict a character of a document (in nats), ``high_band`` how much worse, where
    ``labels`` (doc_id, quality) don't fit them.
    ``range_rows`` n-grams make a hash range of the model.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    model = kneser_ney(ngram_counts(docs))
    ranges = max(1, -(-model.count() // range_rows))
    arrays = written(sorted_arrays(model, ranges), "model")
    forget(model)
    parts = slices_of(docs, slices, carry)
    answered = answers(questions(parts, ranges, slices_at_once), arrays, -(-slices // slices_at_once))
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    schema = ", ".join(["doc_id long, lang string", *[f"c{i} {k}" for i, k in enumerate(kinds)], SCORE_SCHEMA])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = written(scored(parts, answered, schema, carry).withColumn("base_failed", failed), "scores")
    forget(arrays)
    mean = F.col("log_sum") / F.nullif(F.col("n_scored"), F.lit(0))
    off = mean - F.col("centre")
    slack = F.col("spread") * noise / F.sqrt(F.nullif(F.col("n_scored"), F.lit(0)))
    inside = (off <= low_band + slack) & (off >= -(high_band + slack))
    of_language = bands(rows)
    if labels is not None:
        fit = F.try_element_at("fitted", _length_class(F.col("n_scored")))
        inside = F.when(fit.isNull(), inside).otherwise(mean.between(fit["low"], fit["high"]))
        of_language = of_language.join(fitted_bands(rows, labels, margin, least_good), "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    more = [F.col(f"c{i}").alias(f"carried_{c}") for i, c in enumerate(carry)]
    return _with_language(rows, of_language).select("doc_id", *STATS, "base_failed", kept.alias("kept"), F.exp(-mean).alias("perplexity"), "centre", *more)


def kept_documents(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rows = judge(docs, labels, carry=tuple(docs.columns), **options).where("kept")
    return rows.select(*[F.col(f"carried_{c}").alias(c) for c in docs.columns])
