"""Connected components of an edge table, all on executors.

Alternates large-star and small-star steps (Kiveris et al. 2014). Each step is a
minimum per vertex (combined before the shuffle) joined back to the edges by
``spread_join``, so a hub with a third of all edges neither gathers a list nor meets in
one task. Each step costs the driver a plan of about ten exchanges, so edges that are
or become at most ``ONE_TASK`` are finished by a single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

#: Most edges that a single task takes, in arrays of about 100 MB in all.
ONE_TASK = 1_000_000


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with u > v, perhaps with repeats, and the vertex ``w`` that each came by."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
    out = spread_join(both.where("v > u"), low, ["u"], 2 * total, "v")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w")).where("u > v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with u > v, perhaps with repeats; repeated edges of a hub differ in ``w``, which deals them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    out = spread_join(edges, low, ["u"], total, "w").where("v > m")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (u, v) and the least vertex that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    low, ends = np.arange(len(ids)), at.reshape(2, -1)
    while True:
        a, b = low[ends]
        apart = a != b
        if not apart.any():
            return ids, ids[low]
        ends = ends[:, apart]
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (low[low] != low).any():
            low = low[low]


def _one_task(edges: DataFrame) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("component", pa.int64())])

    def run(it):
        held = [b for b in it if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            found = least_reachable(t.column("u").to_numpy(), t.column("v").to_numpy())
            yield from pa.Table.from_arrays([pa.array(x) for x in found], schema=schema).to_batches(50_000)

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "id long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest reachable id of every vertex of ``edges`` (a, b: long).

    Self loops and repeats are ignored; vertices without another neighbour are absent.
    """
    now = materialize(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        if mark[0] <= ONE_TASK:
            return _one_task(now)
        seen = tuple(mark)
        now = materialize(_small_star(_large_star(now, mark[0]), mark[0]).distinct())
