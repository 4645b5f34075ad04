"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text is normalised as its model does (a blank in front; U+2581 counts as a
blank) and every segmentation into vocabulary pieces is a path of its lattice; a
character without a piece of its own is spelt in byte pieces.  A path's
probability is the product of its pieces' weights, over the sum for all paths.
The vocabulary's merge ranks are no probabilities, so a piece weighs
``(rank + shift) ** -power`` (Zipf's law).

Sampling: the set of all paths gets a Gumbel value; a perturbed A-star search
splits sets top down.  A set's value belongs to its best path, which is drawn
piece by piece from the lattice's backward sums.  The rest of the set falls into
one subset per step of that path (same pieces before, another piece at the
step); each gets the maximum of its own Gumbel values, truncated at the value of
the whole.  The best subset of all is split next.  The paths come out in order of
their values, all different: a sample without replacement.  With ``threshold``
the value that comes after the last one, a path of log probability f was included
with probability ``1 - exp(-exp(f - threshold))``, given as its logarithm since
long texts underflow.

No piece holds a blank behind another character, or a line feed; so the lattice
is a chain of small ones, one per distinct run of blanks and characters, and the
small ones are built once a batch with array operations over all of them.

Randomness depends on the row key and the seed alone: the same row gives the same
samples on any machine and any partitioning, and rows that share key and text
get the same samples.  Edge cases: a null or empty text has one segmentation,
of no pieces, with probability 1; a text with fewer than ``k`` segmentations gives
all of them, each with log inclusion 0; a null key is a key of its own; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkit as tk

SCHEMA = "key long, sample int, log_prob double, log_inclusion double, ids array<int>"
_SLICE_CHARS = 1_500_000
_SLICE_ROWS = 4000
_PREFIX = -2
_FIXED = 2.0**32
_LOADED: dict = {}
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A vocabulary as lookup tables."""

    texts: list[bytes]
    width: int
    table: np.ndarray
    hashes: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    shift: np.uint64

    @classmethod
    def load(cls, path: str, power: float, shift: float) -> Pieces:
        if (path, power, shift) in _LOADED:
            return _LOADED[path, power, shift]
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids, texts, plain = np.zeros(256, np.int32), [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.replace("\u2581", " ").encode())
                plain.append((i, piece.replace("\u2581", " ")))
        rank = np.arange(n, dtype=np.float64)
        weight = (-power * np.log(rank + shift)).astype(np.float32)
        weight[byte_ids] = weight.min()
        known = {p: i for i, p in plain}
        longest = max(map(len, known))
        for p in list(known):
            for n in range(1, len(p)):
                known.setdefault(p[:n], _PREFIX)
        strings = list(known)
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        widths = np.array([len(p) for p in strings])
        starts = np.cumsum(widths) - widths
        h = np.zeros(len(strings), np.uint64)
        for j in range(longest):
            on = widths > j
            h[on] = h[on] * _MUL + points[starts[on] + j] + np.uint64(1)
        h = tk.mix(h)
        bits = 21
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        table, hashes = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
        for s, v, i in zip(slot.tolist(), h.tolist(), known.values(), strict=True):
            while table[s] != -1:
                s = (s + 1) & ((1 << bits) - 1)
            table[s], hashes[s] = i, v
        _LOADED[path, power, shift] = cls(texts, longest, table, hashes, weight, byte_ids, np.uint64(64 - bits))
        return _LOADED[path, power, shift]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed strings, ``_PREFIX`` for the beginnings of pieces that are none themselves, -1 for others."""
        at = (h >> self.shift).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            slot = at[todo]
            got = self.table[slot]
            same = (got != -1) & (self.hashes[slot] == h[todo])
            out[todo[same]] = got[same]
            todo = todo[(got != -1) & ~same]
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
        return out


def normalised(texts: pa.Array) -> pa.Array:
    """Blank in front of every text that isn't empty; U+2581 as a blank."""
    plain = pc.replace_substring(tk.one_array(texts), "\u2581", " ")
    led = pc.binary_join_element_wise(pa.scalar("", plain.type), plain, pa.scalar(" ", plain.type))
    return pc.if_else(pc.equal(plain, ""), plain, led)


def runs(texts: pa.Array) -> tk.Words:
    """Normalised texts as runs that no piece crosses."""
    marked = pc.replace_substring_regex(texts, "([^ ])( )", "\\1\u2581\\2")
    marked = pc.replace_substring(marked, "\n", "\u2581\n\u2581")
    lists = pc.split_pattern(marked, "\u2581")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index_in(pa.scalar("", coded.dictionary.type), coded.dictionary).as_py()
    if blank is not None:
        keep = ids != blank
        bounds, ids = np.concatenate(([0], np.cumsum(keep)))[bounds], ids[keep]
    return tk.Words(bounds, ids, coded.dictionary)


class Lattices:
    """The lattices of distinct runs: nodes are characters, the edges of node ``v`` are ``first[v]:first[v + 1]``, by length.

    An edge of length L leads L nodes further; per edge there are its piece (-1: the
    character is spelt in bytes), the probability given its node, cumulated
    probability, and logarithms of the probability (in units of ``1 / _FIXED``, so that
    sums along a path are exact in any order) and of what is left for the node's other edges.
    """

    def __init__(self, vocab: pa.Array, pieces: Pieces):
        joined = "".join(vocab.to_pylist())
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.points)
        live = np.arange(n)
        until = np.repeat(self.ends, sizes)
        h = np.zeros(n, np.uint64)
        found, count = [], np.zeros(n + 1, np.int64)
        for j in range(pieces.width):
            live = live[until[live] > live + j]
            if not len(live):
                break
            h[live] = h[live] * _MUL + self.points[live + j] + np.uint64(1)
            ids = pieces.find(tk.mix(h[live]))
            hit = ids >= 0
            at, of = live[hit], ids[hit]
            if not j:  # a character that is no piece is spelt in bytes
                at, of = live, np.where(hit, ids, -1)
            found.append((at, of, count[at]))
            count[at] += 1
            live = live[ids != -1]
        self.first = np.cumsum(count) - count
        m = int(count.sum())
        self.node, self.length, self.piece = np.repeat(np.arange(n, dtype=np.int32), count[:n]), np.zeros(m, np.int8), np.zeros(m, np.int32)
        for j, (at, of, rank) in enumerate(found):
            self.length[self.first[at] + rank] = j + 1
            self.piece[self.first[at] + rank] = of
        code = self.points.astype(np.int64)
        self.n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        spelt = self.piece < 0
        score = pieces.weight[self.piece].astype(np.float64)
        score[spelt] = self.n_bytes[self.node[spelt]] * float(pieces.weight[pieces.byte_ids[0]])
        self._backward(score, sizes)

    def _backward(self, score: np.ndarray, sizes: np.ndarray) -> None:
        """From the edges' scores to their probabilities, in rounds from the ends of the runs."""
        run = np.repeat(np.arange(len(sizes)), sizes)
        total = np.zeros(len(run) + len(sizes))  # a place behind each run stands for its end, where the sum is 0
        order = np.argsort(-sizes, kind="stable")
        ends, shrinking, runs_in_order = self.ends[order], -sizes[order], order
        prob = np.zeros(len(score))
        for d in range(1, int(sizes.max()) + 1 if len(sizes) else 1):
            some = np.searchsorted(shrinking, -d, side="right")
            at = ends[:some] - d
            slot = at + runs_in_order[:some]
            begin, size = self.first[at], self.first[at + 1] - self.first[at]
            cuts = np.cumsum(size) - size
            edge = np.repeat(begin - cuts, size) + np.arange(int(size.sum()))
            s = score[edge] + total[np.repeat(slot, size) + self.length[edge]]
            top = np.maximum.reduceat(s, cuts)
            e = np.exp(s - np.repeat(top, size))
            mass = np.add.reduceat(e, cuts)
            total[slot] = top + np.log(mass)
            prob[edge] = e / np.repeat(mass, size)
        self.prob = prob
        last = self.first[1:] - 1
        self.log = np.zeros(0, np.int64)
        self.cdf, self.log_rest = prob, prob
        if len(prob):
            units = np.rint(prob * _FIXED).astype(np.int64)
            sums = np.cumsum(units)  # each node's part is read off relative to its first edge
            self.cdf = (sums - np.repeat(sums[self.first[:-1]] - units[self.first[:-1]], np.diff(self.first))) / _FIXED
            self.cdf[last] = 2.0
            whole = np.add.reduceat(prob, self.first[:-1])
            with np.errstate(divide="ignore"):
                self.log = np.rint(np.log(prob) * _FIXED).astype(np.int64)
                alone = np.repeat(np.diff(self.first) == 1, np.diff(self.first))
                self.log_rest = np.where(alone, -np.inf, np.log(np.maximum(np.repeat(whole, np.diff(self.first)) - prob, 1e-300)))

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Edges drawn at the nodes."""
        edge = self.first[at]
        todo = np.flatnonzero(self.cdf[edge] <= u)
        while len(todo):
            edge[todo] += 1
            todo = todo[self.cdf[edge[todo]] <= u[todo]]
        return edge


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((tk.mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@dataclass
class Paths:
    """One path per text: the steps of text ``i`` are the edges ``edge[bounds[i]:bounds[i + 1]]``.

    ``before`` is the log probability of the steps before each, ``split`` the value of its subset.
    """

    bounds: np.ndarray
    edge: np.ndarray
    before: np.ndarray
    log_prob: np.ndarray
    value: np.ndarray
    split: np.ndarray


def _free(lat: Lattices, first: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps drawn through each run from node ``first``: per run the number of steps, and edges in order."""
    n = np.zeros(len(first), np.int64)
    at, live, rounds = first.copy(), np.flatnonzero(first < end), []
    while len(live):
        edge = lat.draw(at[live], _uniform(h[live] + n[live].astype(np.uint64)))
        rounds.append((live, edge))
        at[live] += lat.length[edge]
        n[live] += 1
        live = live[at[live] < end[live]]
    begin = np.cumsum(n) - n
    edges = np.zeros(int(n.sum()), np.int64)
    for r, (who, edge) in enumerate(rounds):
        edges[begin[who] + r] = edge
    return n, edges


def _gumbel_below(bound: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at a location, given that it is below a bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class Search:
    """The perturbed search over the lattices of a batch, in step for all of its texts."""

    def __init__(self, words: tk.Words, lat: Lattices, keys: np.ndarray):
        self.words, self.lat, self.keys = words, lat, keys
        self.owner = words.owner()
        self.first, self.end = lat.starts[words.ids], lat.ends[words.ids]
        self.paths: list[Paths] = []
        self.gone: dict[tuple[int, int, int], list[int]] = {}

    def _stamp(self, sample: int, what: int) -> np.ndarray:
        return tk.mix(self.keys + np.uint64(sample * 64 + what))

    def _finish(self, sample: int, value: np.ndarray, first: np.ndarray, kept: np.ndarray, upto: np.ndarray) -> Paths:
        """Paths of the ``upto`` kept edges of each text and free ones behind; new subsets for the free steps."""
        ordinal = np.arange(len(self.owner)) - self.words.bounds[self.owner]
        h = tk.mix(self._stamp(sample, 1)[self.owner] + ordinal.astype(np.uint64)) << np.uint64(12)
        n, free = _free(self.lat, first, self.end, h)
        added = np.concatenate(([0], np.cumsum(n)))[self.words.bounds]
        doc = np.repeat(np.arange(len(upto)), np.diff(added))
        place = np.arange(len(free)) - added[doc] + upto[doc]
        begin = np.concatenate(([0], np.cumsum(upto)))
        bounds = added + begin
        where = bounds[doc] + place
        edge = np.empty(int(bounds[-1]), np.int64)
        edge[where] = free
        edge[np.arange(len(kept)) + np.repeat(added[:-1], upto)] = kept
        sums = np.concatenate(([0], np.cumsum(self.lat.log[edge])))
        before = (sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))) / _FIXED
        u = _uniform(tk.mix(self._stamp(sample, 2)[doc] + place.astype(np.uint64)) + np.uint64(sample))
        split = np.full(len(edge), -np.inf)
        some = np.flatnonzero(self.lat.log_rest[free] > -np.inf)
        split[where[some]] = _gumbel_below(value[doc[some]], before[where[some]] + self.lat.log_rest[free[some]], u[some])
        return Paths(bounds, edge, before, (sums[bounds[1:]] - sums[bounds[:-1]]) / _FIXED, value, split)

    def start(self) -> None:
        value = -np.log(-np.log(_uniform(self._stamp(0, 0))))
        self.paths.append(self._finish(0, value, self.first, np.zeros(0, np.int64), np.zeros(len(self.keys), np.int64)))

    def advance(self) -> None:
        """Split the best subset of every text; texts without one get an empty path of value -inf."""
        n, sample = len(self.keys), len(self.paths)
        best = np.full((len(self.paths), n), -np.inf)
        where = np.zeros((len(self.paths), n), np.int64)
        for r, path in enumerate(self.paths):
            some = np.flatnonzero(np.diff(path.bounds) > 0)
            if len(some):
                best[r, some] = np.maximum.reduceat(path.split, path.bounds[some])
                size = np.diff(path.bounds)[some]
                top = np.flatnonzero(path.split == np.repeat(best[r, some], size))
                where[r, some] = top[np.searchsorted(top, path.bounds[some])] - path.bounds[some]
        source = best.argmax(axis=0)
        value = best[source, np.arange(n)]
        upto = np.zeros(n, np.int64)
        first = np.where(np.isfinite(value)[self.owner], self.first, self.end)
        other, again = _uniform(self._stamp(sample, 3)), _uniform(self._stamp(sample, 4))
        kept = [np.zeros(0, np.int64)]
        lat = self.lat
        for i in np.flatnonzero(np.isfinite(value)).tolist():
            r, j = int(source[i]), int(where[source[i], i])
            path = self.paths[r]
            a = path.bounds[i]
            old = int(path.edge[a + j])
            node = int(lat.node[old])
            low = int(lat.first[node])
            gone = self.gone.setdefault((r, i, j), [old])
            p = lat.prob[low : lat.first[node + 1]].copy()
            p[np.array(gone) - low] = 0
            edge = low + min(int(np.searchsorted(np.cumsum(p), other[i] * p.sum(), side="right")), int(np.flatnonzero(p)[-1]))
            gone.append(edge)
            p[edge - low] = 0
            rest = p.sum()
            path.split[a + j] = -np.inf if rest == 0 else _gumbel_below(value[i], path.before[a + j] + np.log(rest), again[i])
            upto[i] = j + 1
            kept += [path.edge[a : a + j], [edge]]
            # Each step lies in one run: runs wholly before the changed step are done, its own goes on behind it.
            lo, hi = self.words.bounds[i], self.words.bounds[i + 1]
            passed = int(lat.length[path.edge[a : a + j]].sum(dtype=np.int64))
            done = lo + int(np.searchsorted(np.cumsum(self.end[lo:hi] - self.first[lo:hi]), passed, side="right"))
            first[lo:done] = self.end[lo:done]
            first[done] = node + int(lat.length[edge])
        self.paths.append(self._finish(sample, value, first, np.concatenate(kept), upto))

    def ids(self, path: Paths, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all paths back to back, and their bounds."""
        got = self.lat.piece[path.edge]
        spelt = np.flatnonzero(got < 0)
        size = np.ones(len(got), np.int64)
        size[spelt] = self.lat.n_bytes[self.lat.node[path.edge[spelt]]]
        ends = np.cumsum(size)
        flat = np.repeat(got, size)
        for s in spelt.tolist():
            raw = chr(int(self.lat.points[self.lat.node[path.edge[s]]])).encode()
            flat[ends[s] - len(raw) : ends[s]] = pieces.byte_ids[list(raw)]
        return flat, np.concatenate(([0], ends))[path.bounds]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about _SLICE_CHARS characters; a longer text stands alone."""
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > _SLICE_CHARS:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def sample_batch(keys: list[int | None], texts: pa.Array, pieces: Pieces, k: int, seed: int) -> Iterator[tuple[int, int, float, float, np.ndarray]]:
    """(row, sample, log probability, log inclusion, ids) for rows of one batch."""
    texts = normalised(texts)
    hashed = tk.mix(np.array([-1 if x is None else x for x in keys], np.int64).view(np.uint64) + tk.mix(np.array([seed], np.uint64)))
    for a, b in _slices(pc.utf8_length(texts).to_numpy(zero_copy_only=False)):
        words = runs(texts.slice(a, b - a))
        search = Search(words, Lattices(words.vocab, pieces), hashed[a:b])
        search.start()
        for _ in range(k):
            search.advance()
        threshold = search.paths[k].value
        empty = np.diff(words.bounds) == 0
        for s, path in enumerate(search.paths[:k]):
            flat, bounds = search.ids(path, pieces)
            f = path.log_prob
            with np.errstate(over="ignore", divide="ignore"):
                x = f - threshold
                log_q = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
            for i in range(b - a):
                if np.isfinite(path.value[i]) and (s == 0 or not empty[i]):
                    yield a + i, s + 1, float(f[i]), 0.0 if np.isneginf(threshold[i]) else float(min(log_q[i], 0.0)), flat[bounds[i] : bounds[i + 1]]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", k: int = 2, seed: int = 0, power: float = 0.3, shift: float = 10.0) -> DataFrame:
    """Up to ``k`` distinct segmentations per row of ``key`` and text: key, sample (from 1, best value first), log_prob, log_inclusion, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path, power, shift)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE_ROWS):
                batch = whole.slice(at, _SLICE_ROWS)
                keys = batch.column(0).to_pylist()
                rows = list(sample_batch(keys, batch.column(1), pieces, k, seed))
                yield _record(keys, rows)

    return docs.select(docs[key].cast("long").alias("key"), "text").mapInArrow(run, SCHEMA)


def _record(keys: list, rows: list) -> pa.RecordBatch:
    flat = np.concatenate([r[4] for r in rows] or [np.zeros(0, np.int32)]).astype(np.int32)
    bounds = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))).astype(np.int32)
    cols = [
        pa.array([keys[r[0]] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.float64()),
        pa.array([r[3] for r in rows], pa.float64()),
        pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
    ]
    return pa.record_batch(cols, names=["key", "sample", "log_prob", "log_inclusion", "ids"])


def decode_ids(ids: pa.Array, pieces: Pieces) -> list[str]:
    """Texts of lists of ids: pieces joined, the blank in front taken away; broken byte sequences give U+FFFD."""
    table = pieces.texts
    out = []
    for row in ids:
        raw = b"".join([table[i] for i in row.values.to_numpy(zero_copy_only=False).tolist()]) if row.is_valid else b""
        out.append(raw.decode("utf-8", "replace")[1:])
    return out


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``coded`` with the text of its column ``ids`` as column ``decoded``, in place of the ids."""
    kept = [c for c in coded.columns if c not in ("ids", "decoded")]
    schema = ", ".join([f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in kept] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path, 0.3, 10.0)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = pa.array(decode_ids(batch.column(len(kept)), pieces), pa.string())
                yield pa.record_batch([*batch.columns[: len(kept)], texts], names=[*kept, "decoded"])

    return coded.select(*[coded[c] for c in kept], "ids").mapInArrow(run, schema)


def digest(docs: DataFrame, model_path: str, key: str = "doc_id", k: int = 2, seed: int = 0, power: float = 0.3, shift: float = 10.0) -> DataFrame:
    """Samples and round trips without the ids: doc_id, sample, n_ids, log_prob, log_inclusion, ids_crc32, round_trip.

    The ids are encoded, decoded again in the same task, and compared with the
    normalised text, so only the digest leaves the task.
    """
    import zlib

    schema = "doc_id long, sample int, n_ids long, log_prob double, log_inclusion double, ids_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path, power, shift)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE_ROWS):
                batch = whole.slice(at, _SLICE_ROWS)
                keys = batch.column(0).to_pylist()
                plain = normalised(batch.column(1)).cast(pa.large_binary()).to_pylist()
                cols: tuple[list, ...] = ([], [], [], [], [], [], [])
                for row, sample, f, q, ids in sample_batch(keys, batch.column(1), pieces, k, seed):
                    back = b"".join([pieces.texts[i] for i in ids.tolist()])
                    for c, v in zip(cols, (keys[row], sample, len(ids), f, q, zlib.crc32(ids.astype("<u4").tobytes()), back == plain[row]), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(docs[key].cast("long").alias("key"), "text").mapInArrow(run, schema)
