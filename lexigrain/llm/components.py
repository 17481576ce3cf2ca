"""Connected components of an edge table: contraction within tasks, and star contractions between them.

Defined cases: an edge from a node to itself is none, and neither is one without a node; repeated edges count once; a
table without edges has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch, table

#: Edges that one task contracts at most.
TASK_EDGES = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that aren't the smallest of their component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b):
            np.minimum.at(after, label[side], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    if held:
        u, v = contract(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the root is the smallest node it is connected with.

    Tasks turn at most ``task_edges`` edges each into stars.  Where that takes more than one task, large-star links
    every node's larger neighbours to its smallest one, small-star its smaller ones, and tasks contract again, until
    nothing changes.  Every round starts from a written table.  Minima are taken by partial aggregates and written,
    so that joins with a great star's centre are of two plain shuffles, which Spark can split.
    """
    spark = edges.sparkSession
    kept: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        """A round's tables are dropped when the next one has read them."""
        kept.append(scratch(spark))
        return table(df, kept[-1])

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while True:
        tasks = -(-now.count() // task_edges)
        dealt = now.repartition(tasks) if tasks > 1 else now.coalesce(1)
        now = before = written(dealt.mapInArrow(_contract, "u long, v long"))
        if tasks <= 1:
            break
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.where("u <> v").distinct())
        # The sum of a hash over all edges stays when the edges do.
        sums = [d.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("s")).first() for d in (before, now)]
        if sums[0] == sums[1]:
            break
        for path in kept[:-1]:
            drop(spark, path)
        del kept[:-1]
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
