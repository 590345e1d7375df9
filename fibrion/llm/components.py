"""Connected components of an edge table: by rounds of large-star and small-star over reliable checkpoints, or, of a counted
and bounded number of edges, in one task. Both give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task joins at most (16 bytes each, some 100 with its work space).
ONE_TASK = 1_000_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (node, component)."""
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = forest(len(ids), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["node", "component"])


def _stars(edges: DataFrame, large: bool, salts: int) -> DataFrame:
    """Links each node's neighbours to the least node about it. A node with many neighbours is dealt to `salts` tasks."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = near.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = near.join(least, ["a", "_salt"])
    linked = both.where("b > a").select("b", "m") if large else both.select("b", "m").unionByName(least.where("_salt = 0").select(F.col("a").alias("b"), "m"))
    return linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, salts: int = 8, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) pairs of long ids -> (node, component): the least id that each node reaches. Nodes without an edge to
    another are absent. Null ends and loops are ignored; an empty table gives an empty one."""
    edges = common.cut(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    if edges.count() <= one_task:
        common.ship(edges.sparkSession)
        return edges.repartition(1).mapInArrow(_together, "node long, component long")
    before = None
    while True:
        edges = common.cut(_stars(_stars(edges, True, salts), False, salts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
