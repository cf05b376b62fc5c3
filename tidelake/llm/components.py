"""Connected components of an edge table, labelled with the smallest node."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Edges that one task may join by itself: about 200 MB of Python dictionaries.
LOCAL_EDGES = 1_000_000


def _forest(batches):
    """Union-find over one partition's edges: each node with the smallest node of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], ["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES, plain: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge to another; ``edges`` are columns (a, b) of longs.

    Partitions contract their edges to forests by union-find first. While the forest is larger than
    one task should hold, rounds of large-star and small-star shrink it: a node's neighbours are
    linked with its smallest neighbour by an aggregate and a join, so a node with very many
    neighbours is never collected. ``plain`` does with the rounds alone, which are DataFrame
    functions. Null ends and loops are no edges.
    """
    edges = edges.where("a <> b").select("a", "b")
    edges = materialize(edges.distinct() if plain else edges.mapInArrow(_forest, "a long, b long"), "forest")
    if not plain and edges.count() <= local_edges:
        done = edges.repartition(1).mapInArrow(_forest, "a long, b long")
        return materialize(done.select(F.col("b").alias("node"), F.col("a").alias("component")), "components")
    seen = None
    while (mark := _mark(edges)) != seen:
        seen = mark
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "stars")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
