"""Connected components of a table of links, as rounds of joins and minimum aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import settle, stage


def _smallest(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the smallest of u and all its v; the minimum is combined before it moves."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m")
    )
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one instead."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    near = _smallest(links)
    return near.select("u", F.col("m").alias("v")).unionByName(
        near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task to a link of every node with the smallest it is joined to there."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = 500_000) -> DataFrame:
    """(node, component): every node of a link with the smallest node it is linked to by any way.

    Links are thinned to forests inside tasks first.  What then fits one task, ``task_links``
    at most, is finished there.  More goes through alternating stars (Kiveris and others
    2014): about log2 squared of the nodes' number of rounds at most, each written to the
    shared folder, a hub's links split where the join with its minimum is skewed.  Links
    of a node with itself are of no effect; an empty table gives an empty result.
    """
    settle(links.sparkSession)
    pairs = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = stage(pairs.where("u <> v").mapInArrow(_forest, "u long, v long"))
    if now.count() <= task_links:
        now = now.repartition(1).mapInArrow(_forest, "u long, v long")
    else:
        mark = None
        while True:
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == mark:
                break
            mark = state
            now = stage(_small_star(_large_star(now).distinct()).where("u <> v").distinct())
    now = stage(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
