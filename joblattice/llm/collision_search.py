"""Nearest neighbours by collision-counting hashing, largest inner product first.

Vectors are dealt by a hash of their id into shards of about ``shard_rows``.  A
shard is one index: its vectors, lengthened by one component so that all have the
shard's largest norm (then the largest inner product is the least distance), are
projected on ``projections`` random directions, and every projection is kept as
one sorted array.  A query opens a window around its own projection in every
array; a vector collides where it lies in the window.  Virtual rehashing widens
all windows by ``growth`` at a time, and only the newly covered stretches are
counted; a query begins at the widths at which the one before it ended, and widens or
narrows them from there.  Vectors that collide in ``threshold`` of the arrays are verified, by
the inner product of the original vectors in double precision.  The windows grow
until as many vectors are verified as the shard's index found to be needed when it
was built: for ``sample`` of its own vectors it ranks the whole shard exactly, widens
the windows until the true ``k`` nearest have passed the threshold, and keeps the
number at which ``recall`` of all of them had.  So the verified share follows the
data: small where near vectors collide early, all of the shard where nothing tells
them apart.  Whatever passes the threshold is verified: there is no cap on copies.

Queries are streamed through each shard's task in blocks, and each task holds one
shard only; per query and shard at most ``k`` rows leave it, and a ranking over
these gives the result.  With more queries than ``block_queries`` a shard is
indexed once per block of them.

Edge cases: a null vector, one with null or non-finite components, and one of
zeros only take no part, nor does a null id; vectors of different lengths are not
compared; with fewer candidates than ``k`` all are returned; ties go to the
smaller vec_id; rows that repeat id and vector count once, and a row never finds
rows of its own id; of query rows that share an id one counts; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double"


class ShardIndex:
    """Sorted projections of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
        self.ids, self.vectors = ids[~again], vectors[~again]
        norms = (self.vectors**2).sum(axis=1)
        self.reach = float(np.sqrt(norms.max()))
        lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])
        self.directions = np.random.default_rng(seed).standard_normal((lifted.shape[1], projections))
        shadow = lifted @ self.directions
        self.order = np.argsort(shadow, axis=0, kind="stable").T.copy()
        # All sorted arrays in one, each moved up behind the one before, so that one search finds all window ends.
        self.low, self.high = float(shadow.min()) - 1, float(shadow.max()) + 1
        self.shift = np.arange(projections) * (self.high - self.low + 1)
        self.flat = (np.take_along_axis(shadow, self.order.T, axis=0).T + self.shift[:, None]).ravel()
        self.step = float(shadow.std()) / 4 or 1.0
        self.level = 0

    def _ends(self, at: np.ndarray, side: str) -> np.ndarray:
        """Places in the sorted arrays, one value per projection."""
        found = self.flat.searchsorted(np.clip(at, self.low, self.high) + self.shift, side=side)
        return found - np.arange(len(self.order)) * len(self.ids)

    def _shadow(self, query: np.ndarray) -> np.ndarray:
        return (query / np.sqrt((query**2).sum()) * self.reach) @ self.directions[:-1]

    def _window(self, at: np.ndarray, level: int, growth: float) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the windows in the sorted arrays after ``level`` widenings."""
        width = self.step * growth**level
        return self._ends(at - width, "left"), self._ends(at + width, "right")

    def _covered(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the stretches [lo, hi) of the sorted arrays each vector lies in."""
        some = [o[a:b] for o, a, b in zip(self.order, lo.tolist(), hi.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(some), minlength=len(self.ids)) if some else np.zeros(len(self.ids), np.int64)

    def _widening(self, query: np.ndarray, threshold: float, growth: float) -> Iterator[np.ndarray]:
        """The vectors over the threshold, after each widening of the windows; all in the end."""
        need, at = max(1, int(np.ceil(threshold * len(self.order)))), self._shadow(query)
        lo = hi = self._ends(at, "left")
        counts, level = np.zeros(len(self.ids), np.int64), 0
        while lo.max() > 0 or hi.min() < len(self.ids):
            new_lo, new_hi = self._window(at, level, growth)
            counts += self._covered(new_lo, lo) + self._covered(hi, new_hi)
            lo, hi, level = new_lo, new_hi, level + 1
            yield np.flatnonzero(counts >= need)

    def _passed(self, query: np.ndarray, enough: int, threshold: float, growth: float) -> np.ndarray:
        """The vectors over the threshold after the first widening at which there are enough; all if there never are.

        What passes only grows with the windows, so the way to that widening begins where the query before it
        ended, up or down, and only the stretches between two widenings are counted.
        """
        need, at, level = max(1, int(np.ceil(threshold * len(self.order)))), self._shadow(query), self.level
        lo, hi = self._window(at, level, growth)
        counts = self._covered(lo, hi)
        passed = np.flatnonzero(counts >= need)
        if len(passed) >= enough:
            while level:
                new_lo, new_hi = self._window(at, level - 1, growth)
                counts -= self._covered(lo, new_lo) + self._covered(new_hi, hi)
                less = np.flatnonzero(counts >= need)
                if len(less) < enough:
                    break
                passed, lo, hi, level = less, new_lo, new_hi, level - 1
        while len(passed) < enough and (lo.max() > 0 or hi.min() < len(self.ids)):
            level += 1
            new_lo, new_hi = self._window(at, level, growth)
            counts += self._covered(new_lo, lo) + self._covered(hi, new_hi)
            passed, lo, hi = np.flatnonzero(counts >= need), new_lo, new_hi
        self.level = level
        return passed

    def calibrate(self, k: int, threshold: float, growth: float, recall: float, sample: int) -> None:
        """Find how many vectors have to be verified for the recall, on the shard's own vectors."""
        n = len(self.ids)
        needed: list[int] = []
        for i in np.random.default_rng(n).permutation(n)[:sample].tolist():
            query = self.vectors[i]
            scores = np.where(self.ids == self.ids[i], -np.inf, self.vectors @ query)
            missing = np.zeros(n, bool)
            missing[np.argsort(-scores, kind="stable")[:k]] = True
            for passed in self._widening(query, threshold, growth):
                new = passed[missing[passed]]
                missing[new] = False
                needed += [len(passed)] * len(new)
                if not missing.any():
                    break
        self.enough = int(np.quantile(needed, recall, method="higher")) if n > 4 * k and needed else n

    def search(self, query_id: int, query: np.ndarray, k: int, threshold: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best verified vectors."""
        enough = max(self.enough, k + int((self.ids == query_id).sum()))
        passed = self._passed(query, enough, threshold, growth)
        self.verified = len(passed)
        passed = passed[self.ids[passed] != query_id]
        scores = (self.vectors[passed] * query).sum(axis=1)
        if len(scores) > k:
            least = ~(scores < np.partition(scores, -k)[-k])
            passed, scores = passed[least], scores[least]
        best = np.lexsort((self.ids[passed], -scores))[:k]
        return self.ids[passed[best]], scores[best]


def usable(vector: Column) -> Column:
    """The vector takes part: finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    vectors = batch.column("vector").take(pa.array(rows))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    projections: int = 64,
    threshold: float = 0.8,
    recall: float = 0.92,
    sample: int = 48,
    growth: float = 1.06,
    shard_rows: int = 8192,
    block_queries: int = 16384,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest found; columns vec_id and embedding are read."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asking // block_queries))
    mixed = F.xxhash64("id")
    held = rows.select(F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("vector").alias("size"), F.lit(0).alias("kind"), "id", "vector")
    queries = rows.where("asks").dropDuplicates(["id"])
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.size("vector").alias("size"), F.lit(1).alias("kind"), "id", "vector")
    key = ["shard", "block", "size"]
    dealt = held.unionByName(asked).repartition(shards * blocks, "shard", "block").sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, index = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in (*key, "kind")]) if batch.num_rows else np.zeros((0, 4))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(batch.num_rows), cuts) if batch.num_rows else []:
                group, kind = tuple(keys[part[0], :3].tolist()), keys[part[0], 3]
                ids, matrix = batch.column("id").take(pa.array(part)).to_numpy(), _matrix(batch, part)
                if group != now:
                    now, parts, index = group, [], None
                if kind == 0:
                    parts.append((ids, matrix))
                elif parts:
                    if index is None:
                        index = ShardIndex(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), projections, seed)
                        index.calibrate(k, threshold, growth, recall, sample)
                    found = [(q, *index.search(q, v, k, threshold, growth)) for q, v in zip(ids.tolist(), matrix, strict=True)]
                    who = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
                    yield pa.record_batch([pa.array(who), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
