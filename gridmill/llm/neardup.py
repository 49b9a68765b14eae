"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets collapse first; every later step sees one
representative a set. Each of ``TREES`` independent trees branches the
representatives by minwise tokens: at the root by the tree's least token, and a node
that is too large by further minwise tokens, two branches at a time, so that
a similar pair survives a level with high probability. No two trees branch by the
same tokens at any level, so what one tree loses another keeps. Small nodes are compared
exhaustively on sketches, candidates are confirmed on full shingle sets.

Large tight groups would fill every node, so the trees are used twice:

1. Every node links its members to its least member. Pairs that meet so in several
   trees and come near by sketch are confirmed, which joins n copies by about n pairs.
   Components that an unconfirmed one connects form a group.
2. Nodes that still hold two groups are compared, the largest after branching on, and
   groups that come near by sketch join. The documents of a group are confirmed against each other.

A node or group beyond a block is compared in pairs of blocks of bounded size: exact,
with no task holding it, and each task passes on a forest of links instead of all
pairs. Members of one component need no comparison with each other, so the largest
component's blocks meet only those of the rest: a great group of joined copies with a
few strangers costs rows in proportion to its size. Sketches are compared first; texts
move only for the rows that come near a row of another component in their pair of
blocks. No node or group is capped or sampled.

A pair of similarity s shares a root with probability 1 - (1 - s)^12, beyond
0.9999999 at 0.75. If all its roots are nodes that branch on to the last level, a tree
keeps it with s (1 - (1 - s)^2)^4 and the twelve together with 0.99997 at 0.75 and
0.999998 at 0.8. The sketch test lies five standard deviations below.

Defined cases: null or blank texts have an empty set and link with nothing; rows that
share an id are one document; null ids link with nothing (component null, kept).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, scratch, small_batches, spread_join
from .components import connected_components
from .groups import Unions, by_key, in_blocks, mixed
from .words import shingle_set

TREES = 12
SKETCH = 128
#: Levels below the root; each takes two sketch coordinates of a tree's own, so TREES * (1 + 2 * LEVELS) <= SKETCH.
LEVELS = 4
#: Rows of a block, where a group is compared in pairs of blocks with its texts, and a
#: node with its sketches. A node of more than so many blocks branches on first.
BLOCK, NODE_BLOCK, NODE_BLOCKS = 384, 768, 8
#: Trees in which a member must meet the same least member to be confirmed in step 1.
MEETINGS = 4
#: Most ids that a broadcast may hold: about 10 MB.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(31337)
_A = _rng.integers(0, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SKETCH, np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i : i + 512, None] * _A + _B).min(0), out=low)
    return low


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("mins", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def make(b):
        n, key, mins, sketch = [], [], [], []
        for t in b.column(1).to_pylist():
            s = shingle_set(t, size)
            n.append(len(s))
            if len(s):
                m = minwise(s)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                mins.append(m[:TREES].view(np.int64))
                sketch.append((m >> np.uint64(32)).astype("<u2").tobytes())
            else:
                key.append(None)
                mins.append(None)
                sketch.append(None)
        return [b.column(0), n, key, mins, sketch]

    return docs.mapInArrow(lambda it: batches(it, schema, make), "id long, n long, key binary, mins array<long>, sketch binary")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the documents in ``pairs``, read where they lie."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    texts = _texts(docs, pairs)
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(it):
        kept: dict[tuple, np.ndarray] = {}

        def of(i, t):
            k = (i, len(t or ""), hash(t))
            if k not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[k] = shingle_set(t, size)
            return kept[k]

        for x in it:
            a, b, ta, tb = (c.to_pylist() for c in x.columns)
            ok = [similar(of(i, t), of(j, u), percent) for i, j, t, u in zip(a, b, ta, tb, strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _least(percent: int) -> int:
    """Equal sketch coordinates below which a pair is no candidate: five deviations under the threshold."""
    j = percent / 100
    return int(np.floor(SKETCH * (j - 5 * np.sqrt(j * (1 - j) / SKETCH))))


def _near(sketches: list[bytes], comps: np.ndarray, sides: list[int], least: int):
    """(i, js): for each row the later rows of other components whose sketches come near.

    Rows of sides 1 and 2 meet only the other side; rows of side 0 meet all.
    """
    s, side = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, SKETCH), np.array(sides)
    for i in range(len(s) - 1):
        other = (comps[i + 1 :] != comps[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0))
        other = np.flatnonzero(other) + i + 1
        if len(other):
            js = other[(s[other] == s[i]).sum(1) >= least]
            if len(js):
                yield i, js


def _node_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of components in a node (key) that near sketches connect; a spanning forest of them."""
    least = _least(percent)

    def work(comps, sides, sketches):
        u, c = Unions(), np.array(comps)
        for i, js in _near(sketches, c, sides, least):
            for j in js.tolist():
                if u.join(comps[i], comps[j]):
                    yield min(comps[i], comps[j]), max(comps[i], comps[j])

    return by_key(rows, ["comp", "side", "sketch"], work)


def _links(docs: DataFrame, reps: DataFrame, comps: DataFrame, groups: DataFrame, percent: int, size: int) -> DataFrame:
    """Components (a, b) joined by a confirmed link, for groups of components near by sketch.

    Every pair of a group's documents from different components is tested, by sketch
    and then on full sets, unless links found in the same task already join their
    components. First sketches alone meet, in pairs of blocks, and name the rows that
    come near another component there; then these rows' texts move to their pairs.
    """
    least = _least(percent)
    members = reps.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).join(groups, "comp").select("group", "id", "comp", "n", "sketch")
    met = materialize(in_blocks(materialize(members), "group", BLOCK, "sketch"))

    def involved(keys, ids, comps, sides, sketches):
        seen = set()
        for i, js in _near(sketches, np.array(comps), sides, least):
            seen.add(i)
            seen.update(js.tolist())
        for i in seen:
            yield keys[i], ids[i]

    near = by_key(met.withColumn("of", F.col("key")), ["of", "id", "comp", "side", "sketch"], involved, distinct=False)
    near = materialize(met.join(near.select(F.col("a").alias("key"), F.col("b").alias("id")), ["key", "id"]))
    texts = _texts(docs, near.select(F.col("id").alias("a"), F.col("id").alias("b")))
    rows = near.join(texts, "id").select("key", "comp", "side", "sketch", "text")

    def work(comps, sides, sketches, texts):
        u, c, sets = Unions(), np.array(comps), {}

        def of(i):
            if i not in sets:
                sets[i] = shingle_set(texts[i], size)
            return sets[i]

        for i, js in _near(sketches, c, sides, least):
            for j in js.tolist():
                if u.root(comps[i]) != u.root(comps[j]) and similar(of(i), of(j), percent):
                    u.join(comps[i], comps[j])
                    yield min(comps[i], comps[j]), max(comps[i], comps[j])

    return by_key(rows, ["comp", "side", "sketch", "text"], work)


def _near_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches come near."""
    least = _least(percent)
    rows = pairs.join(reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b").join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(it):
        for x in it:
            if x.num_rows:
                sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(-1, SKETCH) for c in ("sa", "sb"))
                yield x.select(["a", "b"]).filter(pa.array((sa == sb).sum(1) >= least))

    return rows.mapInArrow(run, "a long, b long")


def _renamed(pairs: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with both ends replaced by their name, where they have one."""
    ends = [names.select(F.col("id").alias(c), F.col(column).alias(f"n{c}")) for c in "ab"]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))


def _candidates(nodes: DataFrame, reps: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs of components that meet near each other in a node; the largest nodes branch on first."""
    rows = materialize(mixed(nodes, total).join(reps.select("id", "sketch"), "id").withColumn("n", F.lit(0)))

    def compared(part: DataFrame) -> DataFrame:
        small = part.where(F.col("size") <= NODE_BLOCK).select("key", F.lit(0).alias("side"), "id", "comp", "sketch")
        return _node_pairs(small.unionByName(in_blocks(part.where(F.col("size") > NODE_BLOCK), "key_", NODE_BLOCK, "sketch", total)), percent)

    rows = rows.withColumn("key_", F.col("key"))
    few = F.col("size") <= NODE_BLOCKS * NODE_BLOCK
    out = compared(rows.where(few))
    for level in range(LEVELS):
        large = rows.where(~few)
        if large.isEmpty():
            return out
        first = TREES + 2 * (LEVELS * F.col("tree") + level)  # the tree's own pair of coordinates
        total *= 2
        child = [F.xxhash64("key", F.lit(i), F.substring("sketch", 2 * (first + i) + 1, F.lit(2))) for i in (0, 1)]
        rows = materialize(mixed(large.select(F.explode(F.array(*child)).alias("key"), "tree", "id", "comp", "n", "sketch"), total)).withColumn("key_", F.col("key"))
        out = out.unionByName(compared(rows.where(few)))
    return out.unionByName(compared(rows.where(~few)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their shingle sets;
    a component is what links reach, named by its least id.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, id_col, text_col, percent, size))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(_sets(docs, size))
    sets = rows.where("key is not null and id is not null")
    groups = sets.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("_n"))
    reps = materialize(sets.join(groups.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key", "id"]).select("id", "n", "mins", "sketch"))
    tokens = reps.select("id", F.posexplode("mins").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("key"), "tree", "id")
    nodes = tokens.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("_n")).where("a <> z").select("key", "a", "_n")
    tokens = materialize(spread_join(tokens, nodes, ["key"], TREES * reps.count(), "id"))
    stars = tokens.where("a <> id").groupBy("a", F.col("id").alias("b")).count().where(F.col("count") >= MEETINGS).select("a", "b")
    stars = materialize(_near_pairs(stars, reps, percent))
    # Rows that share an id are one document even if their sets differ.
    same_id = spread_join(sets.select(F.col("id").alias("b"), "key"), groups, ["key"], rows.count(), "b").select(F.col("rep").alias("a"), "b").where("a <> b")
    first = materialize(connected_components(confirm(docs, stars, percent, size).unionByName(same_id.distinct())))
    # Components that a near but unconfirmed pair connects are one group from here on: a
    # node that holds a single group has nothing to add.
    open_pairs = materialize(_renamed(stars, first, "component").where("a <> b").distinct())
    group = materialize(connected_components(open_pairs))
    left = tokens.select("key", "tree", "id").join(first, "id", "left").select("key", "tree", "id", F.coalesce("component", "id").alias("c"))
    left = left.join(group.withColumnsRenamed({"id": "c", "component": "g"}), "c", "left").select("key", "tree", "id", F.coalesce("g", "c").alias("comp"))
    more = materialize(_candidates(left, reps, percent, tokens.count()).distinct())
    if not more.isEmpty():
        group = materialize(connected_components(open_pairs.unionByName(more)))
    links = _links(docs, reps, first, group.withColumnsRenamed({"id": "comp", "component": "group"}), percent, size)
    second = connected_components(links).select(F.col("id").alias("component"), F.col("component").alias("top"))
    named = first.join(second, "component", "left").select("id", F.coalesce("top", "component").alias("c1"))
    alone = second.select(F.col("component").alias("id"), F.col("top").alias("c2"))
    out = rows.select("id", F.col("n").alias("n_shingles")).join(named, "id", "left").join(alone, "id", "left")
    final = F.coalesce("c1", "c2", "id")
    return out.select("id", "n_shingles", final.alias("component_id"), F.col("id").eqNullSafe(final).alias("kept"))
