"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Documents with the same
set form a class; from there on one row stands for a class, however many copies
it has.  A class carries ``coords`` minwise values and a one-bit sketch of them.

Trees: a node of an independent tree selects minwise coordinates by a hash of its
path.  A class moves to one child per selected coordinate, named by its minwise
token there.  A node of at most ``small`` classes is compared exhaustively: all
pairs whose sketches agree enough become candidates.  Larger nodes branch again:
into two children per class at the first levels, then into one, so a class is in
at most four nodes of a tree.  Whatever is still larger after the last level
agrees on four random tokens, and mostly is a huge group of near copies.  Such a
node is first cut at random into parts of about a third of ``small``; each part is
compared exhaustively, and every member is compared with the node's first one.
That joins most of a group cheaply, but decides nothing: nodes whose members are
still in different components afterwards are compared whole, every member with
every member of another component, block by block (``_block_links``).  So a node
that is one group costs work in proportion to its size, and a mixed one the
product of its largest group and the rest, plus the square of the rest, in tasks
of bounded size.

A tree keeps a pair of similarity 0.8 in a common node down to the last level with
probability 0.85 (1 - (1 - 0.8 * 0.76) ** 2, where 0.76 is the same one level down,
over two levels of 0.8); six independent trees miss it with a chance of 0.15 ** 6,
as every node is compared whole, be it small or large.

Candidates whose minwise values agree often enough are confirmed on full sets,
from the documents' texts, in two steps: first each class against its most similar candidate, which joins most groups;
then all other candidates whose ends are still in different groups.  Links give
connected components; a component is named by its smallest doc_id.

Edge cases: null, empty and blank texts have the empty set and link with
nothing; a text of fewer words than a shingle is one shingle; rows that share a
doc_id or a text are treated as rows of their own; a null doc_id never names a
component unless there is no other; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .store import delete, forget, noted, written

COORDS = 128
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as a sorted array of 64-bit hashes."""
    words = tk.split_words(tk.lower_ascii(texts))
    h = words.hashes()
    grams = tk.window_hashes(h, width)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(tk.window_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, COORDS + 1, dtype=np.uint64)
    return (tk.mix(k * _GOLD) | np.uint64(1)).astype(np.uint32), tk.mix(k + _GOLD).astype(np.uint32)


def _minwise(items: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32)
    low = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096, None] * mul[None, :] + add[None, :]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def _row_key() -> Column:
    """128 bits for a row's id and text; null and empty ones have keys of their own."""
    spelled = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "text")))
    return F.unhex(F.md5(spelled))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, k, n_shingles, set fingerprint, minwise values and one-bit sketch per document; ``k`` is a hash of id and text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _multipliers()
        for whole in batches:
            tk.give_back()
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = shingle_sets(batch.column(1), width)
                fp = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                sig = [_minwise(s, mul, add) if len(s) else np.zeros(COORDS, np.uint32) for s in sets]
                bits = np.array([np.packbits((s >> np.uint32(7)) & np.uint32(1), bitorder="little") for s in sig] or np.zeros((0, COORDS // 8), np.uint8))
                halves = bits.astype(np.uint8).view("<i8").reshape(-1, 2)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.record_batch(
                    [batch.column(0), batch.column(2), pa.array(n), pa.array(fp, pa.binary()), pa.array([s.astype("<u4").tobytes() for s in sig], pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    names=["doc_id", "k", "n_shingles", "fp", "sig", "s1", "s2"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key().alias("k")).mapInArrow(sketch, "doc_id long, k binary, n_shingles long, fp binary, sig binary, s1 long, s2 long")


def _children(branches: int, roots: list[int] | None):
    """A batch function to the child rows: from (fp, sig, s1, s2) at the roots, or from these with ``nodes``, a list of (tree, path)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(n, COORDS)
            row = np.arange(n)
            if roots:
                starts = [(pa.array(np.full(n, t, np.int32)), np.full(n, r, np.uint64)) for t, r in enumerate(roots)]
            else:
                nodes = batch.column("nodes")
                row = np.repeat(row, pc.list_value_length(nodes).to_numpy(zero_copy_only=False))
                nodes = nodes.flatten()
                starts = [(nodes.field("tree"), nodes.field("path").to_numpy().view(np.uint64))]
            same = [batch.column(c).take(pa.array(row)) for c in ("fp", "s1", "s2")]
            for tree, path in starts:
                pick = (tk.mix(path + _GOLD) % np.uint64(COORDS)).astype(np.int64)
                jump = (tk.mix(path ^ _GOLD) % np.uint64(COORDS // 2)).astype(np.int64) + 1
                for b in range(branches):
                    at = (pick + b * jump) % COORDS
                    child = tk.mix(path * _GOLD + tk.mix(sig[row, at].astype(np.uint64) * np.uint64(COORDS) + at.astype(np.uint64)))
                    yield pa.record_batch([tree, pa.array(child.view(np.int64)), *same], names=["tree", "path", "fp", "s1", "s2"])

    return grow


def _looked_up(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per document of the nodes' members (tree, path, fp, s1, s2), with its minwise values and the list of its nodes.

    A document lies in as many nodes of one level as the trees have branches, so the values are fetched once for all of them.
    """
    held = nodes.groupBy("fp").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.collect_list(F.struct("tree", "path")).alias("nodes"))
    return held.join(classes.select("fp", "sig"), "fp")


_ROWS = "tree int, path long, fp binary, s1 long, s2 long"


def _node_pairs(rows: DataFrame, least_agreement: int) -> DataFrame:
    """All pairs within each path whose sketches agree in enough bits; nodes must be small."""
    nodes = rows.groupBy("path").agg(F.collect_list(F.struct("fp", "s1", "s2")).alias("m")).where(F.size("m") > 1)
    agree = lambda x, y: F.lit(COORDS) - F.bit_count(x["s1"].bitwiseXOR(y["s1"])) - F.bit_count(x["s2"].bitwiseXOR(y["s2"]))
    near = lambda x: F.filter("m", lambda y: (y["fp"] > x["fp"]) & (agree(x, y) >= least_agreement))
    of_one = lambda x: F.transform(near(x), lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))
    return nodes.select(F.explode(F.flatten(F.transform("m", of_one))).alias("p")).select("p.*")


def _sized(rows: DataFrame) -> DataFrame:
    """The members of nodes of two classes or more, with the node's number of members ``n`` and its ``first`` one.

    One row comes in and at most one goes out for a class and node, so the rows are as many as the trees have branches, whatever the size of a node.
    """
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).where("n > 1")
    return rows.join(sizes, "path")


def _least_agreement(similarity: float) -> int:
    """One-bit values agree where the tokens do, and in half of the other cases."""
    return int(COORDS * (1 + similarity) / 2)


def candidates(classes: DataFrame, trees: int = 6, branches: tuple[int, ...] = (2, 2, 1, 1), small: int = 24, least_similarity: float = 0.6) -> tuple[DataFrame, DataFrame | None]:
    """Distinct candidate pairs of classes (a < b), and the members (path, fp, s1, s2) of nodes still large.

    ``branches`` are those per level of a tree.  The pairs of the nodes still large are not all there.
    """
    least = _least_agreement(least_similarity)
    roots = [int(x) for x in tk.mix(np.arange(1, trees + 1, dtype=np.uint64))]
    rows = classes.select("fp", "sig", "s1", "s2").mapInArrow(_children(branches[0], roots), _ROWS)
    found, used, still = [], [], None
    for level in range(1, len(branches) + 1):
        nodes = written(rows, "nodes")
        sized = written(_sized(nodes), "sized")
        forget(nodes)
        used.append(sized)
        found.append(written(_node_pairs(sized.where(F.col("n") <= small), least).distinct(), "pairs"))
        large = sized.where(F.col("n") > small)
        if level == len(branches):
            first = large.where(F.col("fp") != F.col("first")).select("first", "fp").distinct()
            found.append(first.select(F.col("first").alias("a"), F.col("fp").alias("b")))
            parts = F.pow(F.lit(2), F.ceil(F.log2(3 * F.col("n") / small))).cast("long")
            cut = F.xxhash64("path", F.pmod(F.xxhash64("fp", "tree"), parts))
            found.append(_node_pairs(large.select(cut.alias("path"), "fp", "s1", "s2"), least))
            still = written(large.select("path", "fp", "s1", "s2"), "large")
        elif not large.take(1):
            break
        else:
            rows = _looked_up(large, classes).mapInArrow(_children(branches[level], None), _ROWS)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    pairs = written(whole.distinct(), "candidates")
    for table in [*used, *found[: len(used)]]:
        forget(table)
    return pairs, still


def likely(pairs: DataFrame, classes: DataFrame, least_similarity: float = 0.66) -> DataFrame:
    """Pairs (a, b) whose minwise values agree often enough, with the number of agreeing ones.

    The share of ``COORDS`` agreeing values has a standard deviation of 0.035 at a
    similarity of 0.8, so the bound lies four of them below.
    """
    of = lambda end, value: classes.select(F.col("fp").alias(end), F.col("sig").alias(value))
    both = pairs.select("a", "b").join(of("a", "sig_a"), "a").join(of("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, COORDS) for c in (2, 3))
            agree = (x == y).sum(axis=1)
            kept = pa.record_batch([batch.column(0), batch.column(1), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])
            yield kept.filter(pa.array(agree >= least_similarity * COORDS))

    return both.mapInArrow(count, "a binary, b binary, agree int")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = pairs.select("a", "b").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            tk.give_back()
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keep = []
                for x, y in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary")


def _blocks(large: DataFrame, classes: DataFrame, groups: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(path, i, j, side, fp, root, s1, s2): the members of nodes with several components, dealt to pairs of blocks.

    Blocks hold members of the node's largest component or others, never both; two
    blocks of the largest component need no comparison.  Of nodes with the same
    members one is taken.
    """
    marked = large.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y"))
    once = marked.groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path")
    distinct = large.join(once, "path", "left_semi")
    rooted = distinct.join(classes.select("fp", "n_shingles"), "fp").join(groups.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    by_root = rooted.groupBy("path", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    nodes = by_root.groupBy("path").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "root")).alias("main")).where("roots > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / block_rows, w / block_shingles)).cast("int")
    sized = nodes.select("path", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.w")).alias("km"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("ko"))
    rows = rooted.join(sized, "path")
    is_main, h = F.col("root") == F.col("main"), F.xxhash64("fp")
    rows = rows.withColumn("block", F.when(is_main, F.col("ko") + F.pmod(h, F.col("km"))).otherwise(F.pmod(h, F.col("ko"))).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("ko")).otherwise(F.col("ko") + F.col("km")) - 1)))
    return rows.select("path", F.least("block", "q").alias("i"), F.greatest("block", "q").alias("j"), (F.col("block") > F.col("q")).alias("side"), "fp", "root", "s1", "s2")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int, least_agreement: int) -> DataFrame:
    """Links (a, b) that join the components of each pair of blocks, by full sets."""

    def link(key, table):
        fp = table.column("fp").to_pylist()
        root = table.column("root").combine_chunks().dictionary_encode()
        root = (root.combine_chunks() if isinstance(root, pa.ChunkedArray) else root).indices.to_numpy(zero_copy_only=False).copy()
        bits = np.stack([table.column(c).to_numpy() for c in ("s1", "s2")], axis=1).view(np.uint64)
        sets = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids.astype(np.int32), np.cumsum(size)[:-1])
        one = key[1].as_py() == key[2].as_py()
        side = table.column("side").to_numpy(zero_copy_only=False)
        left, right = (np.arange(len(fp)),) * 2 if one else (np.flatnonzero(~side), np.flatnonzero(side))
        mark, out = np.zeros(len(names), bool), []
        for x in left:
            agree = COORDS - np.bitwise_count(bits[right] ^ bits[x]).sum(axis=1, dtype=np.int64)
            fits = 100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])
            near = right[(root[right] != root[x]) & (agree >= least_agreement) & fits & ((right > x) | (not one))]
            if not len(near):
                continue
            mark[ids[x]] = True
            shared = np.add.reduceat(mark[np.concatenate([ids[y] for y in near])], np.cumsum(size[near]) - size[near], dtype=np.int64)
            mark[ids[x]] = False
            for y in near[100 * shared >= percent * (size[x] + size[near] - shared)]:
                if root[y] != root[x]:
                    out.append((fp[x], fp[y]))
                    root[root == root[y]] = root[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return rows.join(sets, "fp").groupBy("path", "i", "j").applyInArrow(link, "a binary, b binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(fp, grams): each text's set as sorted little-endian 64-bit hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(whole.slice(at, 500).column(0), width)]
                yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["fp", "grams"])

    return docs.select("text").mapInArrow(pack, "fp binary, grams binary")


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, **options: float) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest of its component) per document; options as in :func:`_grouped`."""
    return _grouped(docs, width, percent, **options).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, **options: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of similar texts stays.

    It is one of the smallest doc_id (a null one counts as largest); of rows that
    agree in doc_id and text one stays, whichever.  Rows without words are similar to
    nothing and stay.
    """
    rows = _grouped(docs, width, percent, **options)
    filled = rows.where("n_shingles > 0").withColumn("g", F.coalesce("root", "fp"))
    first = filled.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("m")).select(F.col("m.k").alias("_k")).distinct()
    blank = rows.where("n_shingles = 0").select(F.col("k").alias("_k")).distinct()
    keyed = docs.withColumn("_k", _row_key())
    stay = keyed.join(first, "_k", "left_semi").dropDuplicates(["_k"])
    return stay.unionByName(keyed.join(blank, "_k", "left_semi")).select(*docs.columns)


def _grouped(docs: DataFrame, width: int = 5, percent: int = 80, **options: float) -> DataFrame:
    """The rows of :func:`similar_groups` with k, fp and root, written; the tables made on the way are deleted."""
    with noted() as folders:
        out = _rooted(docs, width, percent, **options)
        grouped = written(out, "grouped")
    for folder in folders:
        if folder != grouped.folder:
            delete(docs.sparkSession, folder)
    return grouped


def _rooted(docs: DataFrame, width: int, percent: int, block_rows: int = 2048, block_shingles: int = 500_000, **tree: float) -> DataFrame:
    """The rows of :func:`similar_groups` with k, fp and root, the fingerprint that stands for the group (null for a class on its own).

    ``block_rows`` and ``block_shingles`` bound a block of a large node, and so the memory of one task.
    """
    rows = written(sketches(docs, width), "sketches")
    filled = rows.where("n_shingles > 0")
    sized = filled.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("n_shingles").alias("n_shingles"))
    classes = written(sized, "classes")
    first_pairs, large = candidates(classes, **tree)
    pairs = written(likely(first_pairs, classes), "likely")
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    wanted = written(classes.select("fp", "rep").join(ends, "fp", "left_semi"), "wanted")
    source = _texts_of(docs, wanted)
    texts = written(_with_fingerprint(source, width).join(wanted.select("fp"), "fp", "left_semi"), "texts")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a"))
    links = written(_confirm(best, texts, width, percent), "links")
    groups = connected_components(links)
    of = lambda v, name: groups.select(F.col("v").alias(v), F.col("root").alias(name))
    open_pairs = pairs.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    more = written(_confirm(open_pairs.where(apart), texts, width, percent), "links")
    if more.take(1):
        links = links.union(more)
        groups = connected_components(links)
    if large is not None:
        blocks = written(_blocks(large, classes, groups, block_rows, block_shingles), "blocks")
        forget(large)
        members = written(classes.select("fp", "rep").join(blocks.select("fp").distinct(), "fp", "left_semi"), "members")
        sets = _sets(_texts_of(docs, members), width).join(members.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("grams").alias("grams"))
        least = _least_agreement(tree.get("least_similarity", 0.6))
        rest = written(_block_links(blocks, sets, percent, least), "links")
        forget(blocks)
        if rest.take(1):
            groups = connected_components(links.union(rest))
    rooted = classes.select("fp", "rep", "copies").join(groups.withColumnRenamed("v", "fp"), "fp", "left")
    rooted = rooted.where(F.col("root").isNotNull() | (F.col("copies") > 1)).select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "root", "component_id")
    out = rows.select("doc_id", "k", "n_shingles", "fp").join(named, "fp", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "k", "n_shingles", "fp", "root", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), own.isNull()).alias("kept"))


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that share the doc_id ``rep`` of a class, null ones too."""
    reps = classes.select(F.coalesce("rep", F.lit(-1)).alias("i"), F.col("rep").isNull().alias("none")).distinct()
    keyed = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("i"), F.col("doc_id").isNull().alias("none"))
    return keyed.join(reps, ["i", "none"], "left_semi").select("text")


def _with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """(fp, text) with one text per set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            tk.give_back()
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                fp = [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(batch.column(0), width)]
                yield pa.record_batch([pa.array(fp, pa.binary()), batch.column(0)], names=["fp", "text"])

    return docs.select("text").mapInArrow(mark, "fp binary, text string")
