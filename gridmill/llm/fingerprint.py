"""Document fingerprints by a randomised edit embedding.

A shared random walk reads each text character by character: at step j it emits
the character under the cursor and moves on if bit (j, character) of a shared
table says so. Two texts an edit apart fall back into step after it, so few edits
leave few differing emissions: edit distance becomes Hamming distance
(Chakraborty, Goldenberg and Koucky 2016).

An embedding is sampled at ``COORDINATES`` coordinates. Each draws the step with
the least shared random rank among the steps that the walk takes, so texts of
about one length sample the same steps and a longer one shares them in proportion.
A coordinate is one hex digit of the fingerprint, a hash of the emitted character;
``-`` stands for an empty text. How long a walk takes to fall into step varies
widely, so ``WALKS`` independent ones are kept, and ``likeness`` is the best of them:
the share of equal coordinates, corrected for chance.

``near_classes`` finds texts of near fingerprints: bands of bit-sampled coordinates, each
within one walk since a single walk may carry the likeness, put texts into buckets;
those that meet are verified on all coordinates. A pair at ``NEAR`` shares one of a
walk's ``BANDS`` bands of ``WIDTH`` coordinates with a probability of 0.96, likelier ones
more so. Equal fingerprints count once; a bucket is first compared with its least text
and only buckets that still hold two classes are compared whole, in pairs of blocks.

Defined cases: null text = empty text; two empty texts have likeness 1, an empty
and a non-empty one 0; equal texts have equal fingerprints; repeated ids stay
separate rows but are one document to the classes; empty texts share a class with each
other only, rows without an id with equal texts only.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts_of, scratch, small_batches
from .components import connected_components
from .groups import Unions, by_key, in_blocks, mixed
from .words import joined, mix

WALKS = 3
COORDINATES = 128  # of each walk
#: Steps after which the shared table of moves repeats.
PERIOD = 4096
_END = 256  # symbol behind every text; the cursor never leaves it
#: Characters of texts walked together.
BLOCK_CHARS = 12_000_000
#: Share of coordinates at which unrelated prose agrees by chance.
CHANCE = 0.125
#: Likeness of texts that share a class; bands of a walk and coordinates of a band; rows of a block.
NEAR, BANDS, WIDTH, BLOCK = 0.9, 12, 16, 768


@cache
def _moves(walk: int) -> np.ndarray:
    bits = np.random.default_rng((20240607, walk)).integers(0, 2, (PERIOD, 257)).astype(np.int64)
    bits[:, _END] = 0
    return bits


@cache
def _records(walk: int, limit: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Steps below ``limit`` at which some coordinate's rank falls, and those coordinates."""
    at: dict[int, list[int]] = {}
    for b in range(COORDINATES):
        rng, low, base = np.random.default_rng((7, walk, b)), np.inf, 0
        while base < limit:
            ranks = rng.random(65536)
            best = np.minimum.accumulate(np.minimum(ranks, low))
            for j in np.flatnonzero(ranks <= best):
                if ranks[j] < low:
                    low = ranks[j]
                    at.setdefault(base + int(j), []).append(b)
            base += 65536
    steps = np.array(sorted(at), np.int64)
    return steps, [np.array(at[s]) for s in steps]


@cache
def _digit() -> np.ndarray:
    """Symbol to hex digit, by a shared shuffle."""
    return np.random.default_rng(99).permutation(np.arange(256) % 16).astype(np.uint8)


def _symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(cp < 256, cp, (cp * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint16)


def _sample(flat: np.ndarray, pos: np.ndarray, walk: int, limit: int, got: np.ndarray) -> None:
    """One walk over all texts, longest first, from cursors ``pos``; fills the coordinates ``got``."""
    moves, digit = _moves(walk), _digit()
    steps, which = _records(walk, limit)
    live, j, r = len(pos), 0, 0
    while live:
        p = pos[:live]
        for j in range(j, j + 256):
            c = flat.take(p)
            if r < len(steps) and steps[r] == j:
                there = c != _END
                d = digit.take(np.minimum(c, 255))
                for b in which[r]:
                    np.copyto(got[b, :live], d, where=there)
                r += 1
            p += moves[j % PERIOD].take(c)
        j += 1
        left = np.flatnonzero(flat.take(p) != _END)
        live = int(left[-1]) + 1 if len(left) else 0


def _walk(texts: list[str]) -> list[str]:
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if texts[i]]
    out = ["-"] * len(texts)
    if not order:
        return out
    parts = []
    for i in order:
        parts += [_symbols(texts[i]), np.array([_END], np.uint16)]
    flat = np.concatenate(parts)
    del parts
    lens = np.array([len(texts[i]) for i in order], np.int64)
    start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    got = np.zeros((WALKS * COORDINATES, len(order)), np.uint8)
    limit = 1 << int(4 * lens[0] + 1024).bit_length()
    for walk in range(WALKS):
        _sample(flat, start.copy(), walk, limit, got[walk * COORDINATES : (walk + 1) * COORDINATES])
    hexes = np.frombuffer(b"0123456789abcdef", np.uint8)[got.T]
    for k, i in enumerate(order):
        out[i] = hexes[k].tobytes().decode()
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """One fingerprint a text; the texts are walked side by side, in blocks."""
    out: list[str] = []
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            out += _walk(texts[a : i + 1])
            a, size = i + 1, 0
    return out + _walk(texts[a:])


def likeness(x: str, y: str) -> float:
    if "-" in (x, y):
        return float(x == y)
    same = np.frombuffer(x.encode(), np.uint8) == np.frombuffer(y.encode(), np.uint8)
    best = int(same.reshape(WALKS, COORDINATES).sum(1).max())
    return max(0.0, (best / COORDINATES - CHANCE) / (1 - CHANCE))


def _blocks(it, column: str):
    """Arrow batches joined up to BLOCK_CHARS of text, with that column as a list."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.column(column).nbytes
        if size >= BLOCK_CHARS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint``; one narrow pass."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "fingerprint"]
    rest = docs.select(kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "fingerprint string"])

    def run(it):
        for t in _blocks(it, text_col):
            fp = fingerprints([x or "" for x in t.column(text_col).to_pylist()])
            yield from t.append_column("fingerprint", pa.array(fp, pa.string())).to_batches()

    return rest.mapInArrow(run, schema)


def _coordinates() -> list[np.ndarray]:
    """The coordinates of each band, drawn within one walk; the same for all texts."""
    rng = np.random.default_rng(5)
    return [w * COORDINATES + rng.choice(COORDINATES, WIDTH, replace=False) for w in range(WALKS) for _ in range(BANDS)]


def _least_equal(min_likeness: float) -> int:
    """Equal coordinates of a walk from which the likeness is reached."""
    return math.ceil(COORDINATES * (min_likeness * (1 - CHANCE) + CHANCE) - 1e-9)


def _alike(prints: np.ndarray, one: np.ndarray, least: int) -> np.ndarray:
    return (prints == one).reshape(-1, WALKS, COORDINATES).sum(2).max(1) >= least


def _matrix(prints) -> np.ndarray:
    return np.frombuffer("".join(prints).encode(), np.uint8).reshape(-1, WALKS * COORDINATES)


def near_classes(prints: DataFrame, id_col: str = "id", min_likeness: float = NEAR) -> DataFrame:
    """(fingerprint, near_class) of all distinct fingerprints: the least id that near fingerprints reach.

    ``prints`` has an id and a fingerprint. What a bucket passes on is linear in its rows.
    """
    with scratch(prints.sparkSession) as keep:
        return keep(_near_classes(prints, id_col, _least_equal(min_likeness)))


def _banded(reps: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(key, part, id) of every band of every fingerprint; ``hot`` has the keys whose rows are dealt to several parts."""
    bands = _coordinates()
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("id", pa.int64())])
    keys = np.array(sorted(hot), np.int64)
    parts = np.array([hot[k] for k in keys.tolist()], np.uint64)

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            m, ids = _matrix(b.column("fingerprint").to_pylist()), b.column("id").to_numpy()
            for k, at in enumerate(bands):
                own = np.ascontiguousarray(m[:, at]).view("<u8").astype(np.uint64)
                key, part = joined([np.full(len(ids), k, np.uint64), own[:, 0], own[:, 1]]).view(np.int64), np.zeros(len(ids), np.int32)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    part = np.where(keys[place] == key, mix(ids.view(np.uint64)) % parts[place], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(ids)], schema=schema)

    return reps.where("fingerprint <> '-' and id is not null").select("id", "fingerprint").mapInArrow(run, "key long, part int, id long")


def _shared_rows(reps: DataFrame) -> DataFrame:
    """(key, a, id) of the buckets with several fingerprints, ``a`` the bucket's least id.

    A bucket with more than its share of rows (``common.parts_of``) is joined in parts. The
    driver gets these keys and the bands deal their rows, so no join reads rows of all bands.
    """
    shared = _banded(reps, {}).groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("_n")).where("a <> z")
    shared = materialize(shared.select("key", "a", "_n"))
    parts = parts_of(len(_coordinates()) * reps.count())
    hot = {r.key: r.parts for r in shared.select("key", parts.alias("parts")).where("parts > 1").collect()}
    side = shared.select("key", "a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return _banded(reps, hot).join(side, ["key", "part"]).select("key", "a", "id")


def _near_classes(prints: DataFrame, id_col: str, least: int) -> DataFrame:
    reps = materialize(prints.groupBy("fingerprint").agg(F.min(id_col).alias("id")))
    rows = materialize(_shared_rows(reps))
    stars = rows.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    first = materialize(connected_components(_verified(stars, reps, least)))
    named = rows.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    left = materialize(mixed(named, rows.count())).join(reps.select("id", "fingerprint"), "id").withColumn("n", F.lit(0))

    def work(ids, comps, sides, prints):
        u, m, c, side = Unions(), _matrix(prints), np.array(comps), np.array(sides)
        for i in range(len(m) - 1):
            other = np.flatnonzero((c[i + 1 :] != c[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0))) + i + 1
            for j in other[_alike(m[other], m[i], least)].tolist() if len(other) else ():
                if u.join(comps[i], comps[j]):
                    yield min(comps[i], comps[j]), max(comps[i], comps[j])

    more = by_key(in_blocks(left, "key", BLOCK, "fingerprint"), ["id", "comp", "side", "fingerprint"], work)
    links = first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
    comp = connected_components(links)
    return reps.join(comp, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("near_class"))


def _verified(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose fingerprints are near."""
    rows = pairs.join(reps.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb")), "b").join(reps.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa")), "a").select("a", "b", "fa", "fb")

    def run(it):
        for x in it:
            if x.num_rows:
                ok = _alike(_matrix(x.column("fa").to_pylist()), _matrix(x.column("fb").to_pylist()), least)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return rows.mapInArrow(run, "a long, b long")


def _rank(cuts: list[int], base: int = 0):
    """How many of the ascending cuts the id reaches; a tree of comparisons, NULL for a null id."""
    if not cuts:
        return F.when(F.col("id").isNotNull(), F.lit(base))
    m = len(cuts) // 2
    return F.when(F.col("id") < cuts[m], _rank(cuts[:m], base)).when(F.col("id") >= cuts[m], _rank(cuts[m + 1 :], base + m + 1))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_task: int = 4000) -> DataFrame:
    """Neighbours in ascending id order, within id ranges that overlap by one row.

    Returns rows (part, ghost, id, text), ``ghost`` marking the row that opens the
    next range (after the last: the first). The texts move once; the driver sees
    one id a range. Range bounds come from the id column alone.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    n = ids.count()
    parts = max(1, min(4096, -(-n // rows_a_task)))
    cuts = [] if parts == 1 else sorted({c for c in ids.where("id is not null").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)})
    # Part k holds ids in [cuts[k-1], cuts[k]); null ids sort first.
    part = F.coalesce(_rank([int(c) for c in cuts]), F.lit(0))
    if cuts:
        firsts = sorted((r.part, r.low) for r in ids.withColumn("part", part).groupBy("part").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("low")).collect())
    else:
        firsts = [(0, r.low) for r in ids.agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("low")).collect() if r.low is not None]
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("part", part)
    key = F.coalesce("id", F.lit(-(2**63)))
    if before:
        to = F.create_map(*[F.lit(x) for low, k in before.items() for x in (low, k)])
        plain = [low for low in before if low != -(2**63)]  # a filter that reaches the scan
        ghosts = rows.where(F.col("id").isin(plain) | (F.col("id").isNull() if len(plain) < len(before) else F.lit(False))).select(F.element_at(to, key).alias("part"), F.lit(True).alias("ghost"), "id", "text")
        rows = rows.select("part", F.lit(False).alias("ghost"), "id", "text").unionByName(ghosts)
    else:
        rows = rows.select("part", F.lit(False).alias("ghost"), "id", "text")
    return rows.repartitionById(firsts[-1][0] + 1 if firsts else 1, F.col("part")).sortWithinPartitions("part", "ghost", F.col("id").asc_nulls_first(), "text")
