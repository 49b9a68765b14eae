"""Exhaustive comparison inside groups, whatever their size.

Rows of a group (a tree's node, a band's bucket) are dealt to pairs of blocks of bounded
size, so that no task holds a group and each pair of rows of different components meets
in exactly one task, or few. What a task passes on is a forest of links at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join

#: Shingles, or other units of size, of a block's rows.
BLOCK_SIZE = 2_000_000


class Unions:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def in_blocks(rows: DataFrame, by: str, block: int, payload: str, total: int | None = None) -> DataFrame:
    """Rows (id, comp, n, payload) keyed by pairs of blocks of their group ``by``, with their side there.

    One that fits a block keeps one key. Of a larger one the largest component's blocks
    (side 1) each meet all blocks of the rest (side 2), and those meet each other (side 0).
    ``total`` is the number of rows, or more; they are counted if it is not known.
    """
    def blocks(count, sizes):
        return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(count) / block, F.col(sizes) / BLOCK_SIZE))).cast("int")

    sizes = rows.groupBy(by, "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sizes = sizes.groupBy(by).agg(F.max(F.struct("m", "comp", "w")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    sizes = sizes.select(by, F.col("top.comp").alias("top"), F.col("top.m").alias("m1"), F.col("top.w").alias("w1"), (F.col("m") - F.col("top.m")).alias("m2"), (F.col("w") - F.col("top.w")).alias("w2"), "m", "w")
    sizes = sizes.select(by, "top", blocks("m", "w").alias("b0"), blocks("m1", "w1").alias("b1"), blocks("m2", "w2").alias("b2"), F.col("m").alias("_n"))
    rows = spread_join(rows, sizes, [by], rows.count() if total is None else total, "id")
    major = F.col("comp") == F.col("top")
    at = F.pmod(F.xxhash64("id"), F.when(major, F.col("b1")).otherwise(F.col("b2"))).cast("int")
    rows = rows.withColumn("at", at)

    def keys(count, side, key):
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda j: F.struct(F.lit(side).alias("side"), key(j).alias("key")))

    met = (
        F.when(F.col("b0") == 1, F.array(F.struct(F.lit(0).alias("side"), F.xxhash64(by).alias("key"))))
        .when(major, keys("b2", 1, lambda j: F.xxhash64(by, F.lit(1), "at", j)))
        .otherwise(F.concat(keys("b1", 2, lambda j: F.xxhash64(by, F.lit(1), j, "at")), keys("b2", 0, lambda j: F.xxhash64(by, F.lit(2), F.least("at", j), F.greatest("at", j)))))
    )
    kept = ["id", "comp", payload]
    return rows.select(F.explode(met).alias("met"), *kept).select("met.key", "met.side", *kept)


def by_key(rows: DataFrame, columns: list[str], work, distinct: bool = True) -> DataFrame:
    """Pairs (a, b: long) that ``work(lists of the columns)`` yields for each key's rows, streamed key by key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        key, held, found = None, [[] for _ in columns], []

        def out():
            a, b = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        def close():
            if len(held[0]) > 1:
                found.extend(work(*held))
            for h in held:
                h.clear()

        for x in it:
            for k, *row in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if k != key:
                    close()
                    key = k
                for h, v in zip(held, row, strict=True):
                    h.append(v)
            if len(found) > 100_000:
                yield out()
        close()
        if found:
            yield out()

    out = rows.select("key", *columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return out.distinct() if distinct else out


def mixed(rows: DataFrame, total: int) -> DataFrame:
    """Rows of nodes that hold two components at least, with the node's size; ``total`` rows at most."""
    nodes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    nodes = nodes.select("key", "size", F.col("size").alias("_n"))
    return spread_join(rows.drop("size"), nodes, ["key"], total, "id")
