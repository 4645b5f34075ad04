"""Connected components of an edge list, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for each vertex of the undirected edges (a, b): root is the smallest vertex reachable.

    Each round takes the smallest label among a vertex and its neighbours, then
    replaces that label by the label's own label, so chains shorten by half.
    Labels live in tables in the shared folder; neighbours are only ever
    aggregated, never gathered.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), "labels")
    for _ in range(max_rounds):
        of_b = labels.select(F.col("v").alias("b"), F.col("l").alias("lb"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("v")).agg(F.min("lb").alias("m"))
        low = labels.join(near, "v", "left").select("v", "l", F.least("l", "m").alias("n"))
        jump = labels.select(F.col("v").alias("n"), F.col("l").alias("j"))
        step = low.join(jump, "n", "left").select("v", F.least("n", F.coalesce("j", "n")).alias("l"), (F.col("l") != F.least("n", F.coalesce("j", "n"))).alias("moved"))
        new = written(step, "labels")
        moved = new.where("moved").limit(1).count()
        forget(labels)
        labels = new
        if not moved:
            return labels.select("v", F.col("l").alias("root"))
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
