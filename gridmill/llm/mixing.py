"""Mixing documents to target token weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates from 0 to
``MOST`` that give each source its target of tokens and keep the shares of the length
bands, the ones closest to 1 in relative entropy over tokens are exponentially tilted:
``min(MOST, exp(multiplier of the source + multiplier of the band))``. Sources are met
exactly; bands, of which a source may lack some, within a penalty: a band misses its
share by ``SOFT`` times its multiplier.

The multipliers minimise a convex dual. Given the bands' multipliers a source's own
follows in closed form from its band sums, so Newton's steps are taken in the bands
alone: gradient and Hessian are sums over all sources, one row each, taken on executors;
the driver holds one number a pair of bands, at most 63 x 63, whatever the number of
sources.

Rates become copies by error diffusion: documents of a source are dealt by a hash of
their id into chunks of bounded size, and inside a chunk, largest first, the rounding
error is carried on, so a chunk misses its share by no more than about half of its
smallest documents. The result depends on ids and sizes alone, so reruns agree.

Defined cases: null text has size 0 and takes no part; a null source is a source of
its own, last; rows equal in id, source and size get equal copies; other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Most rows of a rounding chunk, on average.
CHUNK = 4_000
MOST = 3
#: Penalty on the bands' multipliers.
SOFT = 0.02
#: A band holds sizes from a power of two to the next.
BANDS = 63
#: Most sources whose table is broadcast; a source takes about 100 bytes and its bands' rates.
BROADCAST_SOURCES = 20_000


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``rank``, from 0: the source's place by code point, null last; no task holds more than a range of sources."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a task
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(parts.select("_part", (before - F.col("_first")).alias("_shift"))), "_part").withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def capped_targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Add ``target`` to sources (source, source_size, weight).

    All sizes are shared by weight; what exceeds ``most`` times a source's size is shared
    again among the others until nothing does. Each round fixes the sources above the
    rate, so the rate rises from round to round and one aggregate a round suffices.
    """
    share = F.col("weight")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.sum(share).alias("w")).first()
    rate = total.s / total.w if total.w else 0.0
    while True:
        over = F.col("weight") * rate > most * F.col("source_size")
        r = sources.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(over, 0).otherwise(share)).alias("w")).first()
        left = total.s - most * (r.full or 0)
        new = left / r.w if r.w else rate
        if new <= rate or not r.w:
            break
        rate = new
    return sources.withColumn("target", F.when(over, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("weight") * F.lit(float(rate))))


def tilt(mass: np.ndarray, target: float, mu: np.ndarray, most: float = MOST) -> tuple[float, np.ndarray]:
    """A source's multiplier given the bands', and its rates: sum(mass * min(most, exp(lam + mu))) = target."""
    some = mass > 0
    if not some.any() or target <= 0:
        return -math.inf, np.zeros(len(mass))
    if target >= most * mass.sum() * (1 - 1e-12):
        return math.inf, np.full(len(mass), float(most))
    order = np.flatnonzero(some)[np.argsort(-mu[some], kind="stable")]
    e = np.exp(mu[order] - mu[order[0]])
    rest = np.cumsum((mass[order] * e)[::-1])[::-1]
    full = np.concatenate([[0.0], np.cumsum(mass[order])])
    for k in range(len(order)):  # the k bands of the largest multipliers are at the bound
        x = (target - most * full[k]) / rest[k]
        if x > 0 and x * e[k] <= most:
            lam = math.log(x) - mu[order[0]]
            return lam, np.minimum(most, np.exp(np.minimum(lam + mu, 50.0)))
    return math.inf, np.full(len(mass), float(most))


def _dual(mass: np.ndarray, target: np.ndarray, mu: np.ndarray, most: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed over some sources: the dual's value, the bands' tilted sums, and the Hessian with the sources eliminated."""
    value, got, hess = 0.0, np.zeros(len(mu)), np.zeros((len(mu), len(mu)))
    top = math.log(most)
    for m, t in zip(mass, target, strict=True):
        lam, r = tilt(m, t, mu, most)
        got += m * r
        if not math.isfinite(lam):  # nothing, or every band at the bound: linear in the multipliers
            value += float((m * r) @ mu)
            continue
        x = lam + mu
        free = (x < top) & (m > 0)
        value += float((m * np.where(x < top, np.exp(np.minimum(x, top)), most * (1 + x - top))).sum()) - lam * t
        w = np.where(free, m * r, 0.0)
        if w.sum() > 0:
            hess += np.diag(w) - np.outer(w, w) / w.sum()
    return value, got, hess


def balance(sources: DataFrame, bands: int = BANDS, most: float = MOST, steps: int = 40, tol: float = 1e-9) -> np.ndarray:
    """The bands' multipliers for sources (target, mass: one number a band); Newton's steps with a line search."""
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def at(mu: np.ndarray):
        def run(it):
            sums = np.zeros(2 + 2 * bands + bands * bands)
            for b in it:
                if b.num_rows:
                    mass, target = np.array(b.column(0).to_pylist(), float), b.column(1).to_numpy()
                    value, got, hess = _dual(mass, target, mu, most)
                    sums += np.concatenate([[value, target.sum()], got, mass.sum(0), hess.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], schema.field(0).type)], schema=schema)

        parts = sources.select("mass", "target").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
        sums = np.zeros(2 + 2 * bands + bands * bands)
        for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # as many numbers as the Hessian has
            sums[r.i] = r.x
        value, target, got, mass, hess = np.split(sums, [1, 2, 2 + bands, 2 + 2 * bands])
        return float(value[0]), got, hess.reshape(bands, bands), mass, float(target[0])

    mu = np.zeros(bands)
    value, got, hess, mass, target = at(mu)
    if not mass.sum():
        return mu
    goal = mass * (target / mass.sum())

    def full(value, mu):
        return value - mu @ goal + SOFT * (goal * mu * mu).sum() / 2

    for _ in range(steps):
        g = got - goal + SOFT * goal * mu
        if np.abs(g).max() <= tol * goal.sum():
            break
        live = goal > 0
        step = np.zeros(bands)
        step[live] = -np.linalg.solve(hess[np.ix_(live, live)] + np.diag(SOFT * goal[live]), g[live])
        size = min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        now = full(value, mu)
        for _ in range(20):
            new = at(mu + size * step)
            if full(new[0], mu + size * step) <= now + 1e-4 * size * (g @ step) + 1e-12 * abs(now):
                break
            size /= 2
        mu = mu + size * step
        value, got, hess = new[:3]
    return np.round(mu, 9)  # sums over tasks come in any order; a rerun rounds to the same


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of one chunk's rows (id, size, rows, rate)."""
    pdf = pdf.sort_values(["size", "id"], ascending=[False, True], na_position="first")
    err, copies = 0.0, []
    for size, n, rate in zip(pdf["size"].tolist(), pdf["rows"].tolist(), pdf["rate"].tolist(), strict=True):
        low = int(rate + 1e-9)
        err += (rate - low) * size * n
        extra = low < MOST and size > 0 and err >= size * n / 2
        err -= size * n if extra else 0.0
        copies.append(low + extra)
    return pdf.assign(copies=copies)[["id", "source", "size", "rows", "source_size", "target", "rate", "copies"]]


def _band(size: str = "size"):
    """0 for sizes of 1, 1 for 2 and 3, ...: the position of the highest bit."""
    return F.length(F.bin(F.col(size))) - 1


def mix(docs: DataFrame, size, id_col: str = "doc_id", source_col: str = "source", weight=None) -> DataFrame:
    """(id, source, size, rows, source_size, target, rate, copies) of each distinct (id, source, size).

    ``size`` is a column expression; ``weight`` makes a source's weight of its rank by
    code point (a column expression over ``rank``), by default 1, 2, 3 and again.
    """
    small_batches(docs.sparkSession)
    units = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size")).groupBy("id", "source", "size").agg(F.count("*").alias("rows")))
    cells = units.groupBy("source", _band().alias("band")).agg(F.sum(F.col("size") * F.col("rows")).alias("mass"), F.count("*").alias("n"), F.max("size").alias("most"))
    mass = F.array(*[F.coalesce(F.sum(F.when((F.col("band") == i) & (F.col("most") > 0), F.col("mass"))), F.lit(0)).cast("double") for i in range(BANDS)])
    sources = cells.groupBy("source").agg(F.sum("mass").cast("long").alias("source_size"), F.sum("n").alias("n"), mass.alias("mass"))
    sources = numbered(sources).withColumn("weight", F.col("rank") % 3 + 1 if weight is None else weight(F.col("rank")))
    sources = materialize(capped_targets(materialize(sources)))
    mu = balance(sources)
    found = pa.schema([("source", pa.string()), ("rates", pa.list_(pa.float64()))])

    def rates(it):
        for b in it:
            both = zip(b.column("mass").to_pylist(), b.column("target").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("source").cast(pa.string()), pa.array([tilt(np.array(m, float), t, mu)[1].tolist() for m, t in both], found.field(1).type)], schema=found)

    tilted = sources.select("source", "mass", "target").mapInArrow(rates, "source string, rates array<double>").withColumnRenamed("source", "_r")
    about = sources.join(tilted, F.col("source").eqNullSafe(F.col("_r"))).select(F.col("source").alias("_s"), "source_size", "target", "rates", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    about = materialize(about)
    rated = units.join(F.broadcast(about) if about.count() <= BROADCAST_SOURCES else about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, F.get("rates", _band())).otherwise(0.0)).drop("rates")
    none = -(2**63)  # stands for a null id inside pandas, whose integers have no nulls
    rated = rated.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("id", F.coalesce("id", F.lit(none)))

    return rated.groupBy("source", "chunk").applyInPandas(_round, "id long, source string, size long, rows long, source_size long, target double, rate double, copies int").withColumn("id", F.nullif("id", F.lit(none)))
