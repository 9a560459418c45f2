"""Connected components of a distributed graph: union-find inside partitions, stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def find(parent: dict[int, int], x: int) -> int:
    """The root of x; every node passed is hung below its grandparent."""
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """node -> the least node that these edges join it with, for nodes that aren't the least themselves."""
    parent: dict[int, int] = {}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root for x in parent if (root := find(parent, x)) != x}


def locally(edges: DataFrame) -> DataFrame:
    """(child, parent): each partition's edges as stars around their least nodes, a row for each node at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = forest((a, b) for x in batches for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["child", "parent"])

    return edges.mapInArrow(run, "child long, parent long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(child, parent): every node of ``edges`` (a, b) but each component's least, with that least node.

    A round links every child's parents to the least of them, hangs children below their parents' parents, and lets each
    partition's union-find shorten what it holds. Parents only fall, and rounds end when no parent is a child and no child
    has two. Rows never exceed the edges' number, and a node with very many neighbours is spread over its children's
    partitions.
    """
    now = written(locally(edges.select("a", "b")), "links")
    for _ in range(most):
        least = now.groupBy("child").agg(F.min("parent").alias("least"))
        up = least.select(F.col("child").alias("parent"), F.col("least").alias("above"))
        # A second parent of a child is linked to the child's least parent.
        both = now.join(least, "child")
        moved = both.select("child", F.col("least").alias("parent")).union(both.filter("parent != least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))).distinct()
        jumped = moved.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("open"))
        after = written(jumped, "links")
        opened, rows, children = after.agg(F.sum(F.col("open").cast("long")), F.count("*"), F.countDistinct("child")).first()
        now = after.select("child", "parent")
        if not opened and rows == children:
            return now
        now = locally(now.select(F.col("child").alias("a"), F.col("parent").alias("b")))
        now = written(now, "links")
    raise RuntimeError(f"components did not settle in {most} rounds")
