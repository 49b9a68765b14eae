"""Embedding near-duplicates by spherical-cap filters.

Filter directions form random product codes: the space is cut into blocks, each
block has its own Gaussian codewords, and a direction is one codeword a block. Each
code turns the space by a random rotation of its own before the cut, so that no vector
has its norm in one block however its coordinates lie. Several independent codes even
out how many directions a vector reaches. A
vector belongs to every direction whose inner product with it reaches the cap's
height; list decoding finds those without trying all directions, by extending
partial products only while the best remaining codewords can still reach the
height (Becker, Ducas, Gama and Laarhoven 2016). Vectors that share a filter are
compared exactly, in double precision.

The number of directions is chosen so that two vectors at the threshold share
``SHARED`` filters on average; in few dimensions, where no direction is rare, caps are
wider. One plan serves vectors of any length. Vectors are scaled by a power of two
before any square, so neither tiny nor huge components under- or overflow. Equal vectors of a label collapse first, so a
group of copies is one vector with a multiplicity. A filter with too many vectors
is compared in blocks of fixed size, spread over tasks; none is capped.

Defined cases: null, zero or non-finite vectors, null labels and null ids link with
nothing (an invalid vector is a component of its own); vectors of different lengths
never link; rows that share an id count as separate vectors.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches, spread_join
from .components import connected_components

SHARED = 32
BLOCKS = 2
CODES = 16
BLOCK = 512


@lru_cache(CODES * 4)
def _rotation(dim: int, code: int) -> np.ndarray:
    """A fixed random orthogonal matrix, made where it is used."""
    q, r = np.linalg.qr(np.random.default_rng((2718, dim, code)).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows turned to a largest component between 1/2 and 1, exactly."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


class Caps:
    """Product codes for vectors of one dimension."""

    def __init__(self, dim: int, height: float, words: int, seed: int = 1729):
        self.height, self.words = height, words
        self.cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        rng = np.random.default_rng((seed, dim))
        self.codes = [[rng.standard_normal((words, b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)] for _ in range(CODES)]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Ascending indices of all directions whose inner product with the unit vector x reaches the height."""
        size = self.words ** (len(self.cuts) - 1)
        return np.concatenate([k * size + np.sort(self._decode(code, _rotation(len(x), k) @ x)) for k, code in enumerate(self.codes)])

    def _decode(self, code: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        dots = [c @ x[a:b] for c, a, b in zip(code, self.cuts, self.cuts[1:], strict=False)]
        best = [0.0]
        for d in reversed(dots[1:]):
            best.append(best[-1] + d.max())
        sums, at = np.zeros(1), np.zeros(1, np.int64)
        for d, rest in zip(dots, reversed(best), strict=True):
            order = np.argsort(-d)
            top = np.searchsorted(-d[order], sums + rest - self.height, "right")  # codewords that can still reach
            i = np.repeat(np.arange(len(sums)), top)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(top) - top, top)]
            sums, at = sums[i] + d[j], at[i] * self.words + j
        return at[sums >= self.height]


@lru_cache(64)
def plan_caps(n: int, dim: int, cosine: float) -> Caps:
    """Height from the number of vectors, so that caps hold few strangers; words from the wanted overlap."""
    height = min(4.2, math.sqrt(dim) + 0.5, max(1.5, math.sqrt(2 * math.log(max(n, 192) / 64))))
    rng = np.random.default_rng(3)
    # P(both products reach the height) for Gaussian directions and unit vectors at the threshold.
    x = height + rng.exponential(1 / height, 200_000)  # tail of a Gaussian, reweighted
    w = np.exp(-(x**2) / 2 + height * (x - height)) / math.sqrt(2 * math.pi) / height
    tail = np.array([0.5 * math.erfc((height - cosine * v) / math.sqrt(2 * (1 - cosine**2))) for v in x[:20_000]])
    both = float((w[:20_000] * tail).mean())
    return Caps(dim, height, math.ceil((SHARED / CODES / both) ** (1 / min(BLOCKS, dim))))


def _numbers(df: DataFrame, vec_col: str):
    """Single precision stays as it is, exactly; anything else becomes double."""
    return F.col(vec_col) if df.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")


def _usable(id_col: str, vec_col: str, label_col: str):
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & finite, F.lit(False))


def _linked(x: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x link; values within rounding of the threshold are taken again one by one."""
    x = _scaled(x)
    norm = np.sqrt((x * x).sum(1))
    cos = (x @ x.T) / (norm[:, None] * norm)
    out = cos >= cosine
    for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):
        out[i, j] = float(np.dot(x[min(i, j)], x[max(i, j)])) / (norm[min(i, j)] * norm[max(i, j)]) >= cosine
    np.fill_diagonal(out, False)
    return out


def _met_before(filters: list[np.ndarray], own: int) -> np.ndarray:
    """Which rows share a filter that comes before ``own``."""
    early = [f[: np.searchsorted(f, own)] for f in filters]
    row = np.repeat(np.arange(len(early)), [len(f) for f in early])
    _, at, times = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
    twice = times > 1
    column = np.cumsum(twice) - 1
    keep = twice[at]
    a = np.zeros((len(early), int(twice.sum())), np.float32)
    a[row[keep], column[at[keep]]] = 1
    return a @ a.T > 0


def _bucket_links(rows: DataFrame, cosine: float) -> DataFrame:
    """Per bucket (key) its vectors' new links: (cid, peer, others).

    ``others`` counts a vector's linked partners, with their multiplicities, each pair in
    the first filter that both share, so sums over buckets count it once; ``peer``
    names the least vector of its linked group there. What a bucket yields is linear
    in its vectors.
    """
    schema = pa.schema([("cid", pa.int64()), ("peer", pa.int64()), ("others", pa.int64())])

    def work(own, cids, blocks, across, times, vecs, filters):
        link = _linked(np.stack(vecs).astype(float), cosine)
        block = np.array(blocks)
        if across[0]:
            link &= block[:, None] != block  # pairs inside a block have a task of their own
        if not link.any():
            return
        low = np.arange(len(cids))
        while True:
            new = np.minimum(low, np.where(link, low, len(low)).min(1))
            if (new == low).all():
                break
            low = new
        count = (link & ~_met_before(filters, own)) @ np.array(times)
        for i in np.flatnonzero(link.any(1)).tolist():
            yield cids[i], cids[low[i]], int(count[i])

    def run(it):
        key, held, found = None, [[] for _ in range(7)], []

        def close():
            if len(held[0]) > 1:
                found.extend(work(held[0][0], *held[1:]))
            for h in held:
                h.clear()

        def out():
            cols = list(zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        def slices(column):
            flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            return [flat[a:b] for a, b in zip(off, off[1:], strict=False)]

        for x in it:
            plain = [x.column(c).to_pylist() for c in ("key", "filter", "cid", "block", "across", "n")]
            for k, *row in zip(*plain, slices(x.column("v")), slices(x.column("filters")), strict=True):
                if k != key:
                    close()
                    key = k
                for h, value in zip(held, row, strict=True):
                    h.append(value)
            if len(found) > 50_000:
                yield out()
        close()
        if found:
            yield out()

    rows = rows.select("key", "filter", "cid", "block", "across", "n", "v", "filters").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "cid long, peer long, others long")


def vector_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``df``."""
    small_batches(df.sparkSession)
    with scratch(df.sparkSession) as keep:
        return keep(_vector_links(df, id_col, vec_col, label_col, cosine))


def _vector_links(df: DataFrame, id_col: str, vec_col: str, label_col: str, cosine: float) -> DataFrame:
    even = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # signed zeros are equal numbers
    every = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), _numbers(df, vec_col).alias("v"))
    ok = _usable("id", "v", "label")
    rows = every.where(ok).withColumn("v", even)
    rows = materialize(rows.withColumn("key", F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("v"))), 256)))
    classes = rows.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()

    def decode(it):
        for b in it:
            got = [plan_caps(n, len(x), cosine).decode(_unit(x)) for x in (np.array(v, float) for v in b.column("v").to_pylist())]
            yield b.append_column("filters", pa.array(got, pa.list_(pa.int32())))

    own = classes.select("cid", "label", "n", "v")
    own = materialize(own.mapInArrow(decode, f"cid long, label {classes.schema['label'].dataType.simpleString()}, n long, v {classes.schema['v'].dataType.simpleString()}, filters array<int>"))
    bucket = ["filter", "label", "dim"]
    member = own.select("cid", "label", F.size("v").alias("dim"), F.explode("filters").alias("filter"))
    total = own.agg(F.sum(F.size("filters"))).first()[0] or 0
    sizes = member.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1").withColumn("_n", F.col("size"))
    put = spread_join(member, sizes, bucket, total, "cid").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    put = put.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    put = put.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    put = put.select("cid", *bucket, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    put = put.select("cid", "filter", "block", (F.col("lo") != F.col("hi")).alias("across"), F.xxhash64(*bucket, "lo", "hi").alias("key"))
    found = materialize(_bucket_links(put.join(own.select("cid", "n", "v", "filters"), "cid"), cosine).groupBy("cid", "peer").agg(F.sum("others").alias("others")))
    count = found.groupBy("cid").agg(F.sum("others").alias("others"))
    linked = found.select(F.col("cid").alias("a"), F.col("peer").alias("b"))
    comp = connected_components(linked).withColumnRenamed("id", "cid")
    named = materialize(classes.select("key", "cid", "n", "low").join(count, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("_n"))
    named = spread_join(named, lows, ["component"], n, "cid").select("key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id", F.col("n").alias("_n"))
    out = spread_join(rows.select("id", "key"), named, ["key"], rows.count(), "id").select("id", "n_links", "component_id")
    rest = every.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
