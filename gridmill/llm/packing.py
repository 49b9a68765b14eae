"""Packing by optimal length buckets.

The histogram of lengths is taken over all documents (one row a distinct length). A
dynamic program picks the bucket boundaries that minimise total padding when each
document is padded to the boundary of its bucket; its cost is a lower envelope of
lines, so it takes O(buckets x distinct lengths). Inside each bucket, batches hold
as many documents as a token budget allows at the bucket's length.

Documents take their places by a distributed rank in (bucket, id) order: a range
shuffle of ids, and one row a partition and bucket for the offsets, so a bucket with
a third of all documents spreads over many tasks.

Defined cases: empty texts and null lengths count as 0; columns but the id and the length
are not read; a document longer than the budget fills a
batch of its own; repeated rows are packed one by one; null ids come first.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text"):
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORDS)).cast("long")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths, ascending, of at most ``buckets`` buckets with the least padding.

    With f_k(j) the least padded total of the j shortest lengths in k buckets,
    f_k(j) = min_i f_{k-1}(i) + L_j (C_j - C_i): lines of slope -C_i queried at
    ascending L_j, so one pointer walks their lower envelope.
    """
    n = len(lengths)
    if not n:
        return []
    cum = [0, *np.cumsum(counts).tolist()]
    inf = float("inf")
    best = [0, *[inf] * n]
    back: list[list[int]] = []
    for _ in range(min(buckets, n)):
        now, frm = [inf] * (n + 1), [0] * (n + 1)
        now[0] = 0
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] < inf:
                m, b = -cum[j - 1], best[j - 1]
                while len(hull) - at >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            x = lengths[j - 1]
            while len(hull) - at >= 2 and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            m, b, i = hull[at]
            now[j], frm[j] = m * x + b + x * cum[j], i
        back.append(frm)
        best = now
    out, j = [], n
    for frm in reversed(back):
        if j:
            out.append(lengths[j - 1])
            j = frm[j]
    return sorted(set(out))


def padding(lengths: list[int], counts: list[int], bounds: list[int]) -> int:
    return sum((bounds[bisect_left(bounds, x)] - x) * c for x, c in zip(lengths, counts, strict=True))


def pack(rows: DataFrame, length_col: str, id_col: str = "doc_id", buckets: int = 16, token_budget: int = 65536) -> DataFrame:
    """Add bucket, bucket_length, batch, slot and padding to (id, length) rows.

    ``batch`` numbers the batches inside a bucket. Only the id and the length move.
    """
    rows = materialize(rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("length")))
    hist = sorted((r.length, r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    bounds = optimal_boundaries([x for x, _ in hist], [c for _, c in hist], buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda e: e < F.col("length")))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_length", F.get(edges, F.col("bucket")))
    order = ["bucket", F.col("id").asc_nulls_first(), "length"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    runs = placed.groupBy("part", "bucket").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row a task and bucket
    before = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "bucket", (before - F.col("first")).alias("shift"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1))).cast("long"))
    rank = F.col("at") + F.col("shift")
    out = placed.join(F.broadcast(runs), ["part", "bucket"])
    return out.select(F.col("id").alias(id_col), F.col("length").alias("n_tokens"), "bucket", "bucket_length", F.floor(rank / capacity).cast("long").alias("batch"), (rank % capacity).alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))
