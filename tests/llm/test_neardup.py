import random

import pytest
from pyspark.sql import functions as F

from gridmill.llm import common, components, groups, neardup
from gridmill.llm.words import word_hashes


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=75):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    out = []
    for i, s in sets:
        c = None if i is None else root(i)
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.55 and texts:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.75:
            texts.append(" ".join(passage + [word() for _ in range(r.randint(5, 60))]))
        else:
            texts.append(" ".join(word() for _ in range(r.randint(0, 80))))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("node,block,levels", [(768, 384, 4), (3, 3, 2), (2, 2, 0)])
def test_against_brute_force(spark, monkeypatch, node, block, levels):
    monkeypatch.setattr(neardup, "NODE_BLOCK", node)
    monkeypatch.setattr(neardup, "NODE_BLOCKS", 2)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LEVELS", levels)
    rows = corpus(node, 220) + [(500, None), (501, ""), (502, " \t"), (503, "Few words"), (504, "few WORDS"), (505, "few words here"), (None, "few words"), (506, "É x"), (507, "é x")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int").repartition(5)
    got = sorted((tuple(r) for r in neardup.near_duplicates(d).collect()), key=str)
    assert got == brute(rows)


def test_trees_branch_apart(spark, monkeypatch):
    """Every shared root is beyond the limit and branches to the last level; no tree may lose what all lose."""
    monkeypatch.setattr(neardup, "NODE_BLOCK", 1)
    monkeypatch.setattr(neardup, "NODE_BLOCKS", 1)
    monkeypatch.setattr(neardup, "MEETINGS", neardup.TREES + 1)
    words = [[f"d{i}w{k}" for k in range(117)] for i in range(300)]
    rows = [(2 * i + k, " ".join(w[13 * k : 13 * k + 104])) for i, w in enumerate(words) for k in (0, 1)]  # 87 of 113 shingles
    got = {r.id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_great_groups_move_little(spark):
    """20,000 joined copies and a few strangers: rows in proportion to the group, each pair across it in one task."""
    rows = [(7, i, 0, 50, b"") for i in range(20_000)] + [(7, 20_000 + i, 20_000 + i // 2, 50, b"") for i in range(6)] + [(8, 30_000 + i, i % 2, 50, b"") for i in range(3)]
    d = spark.createDataFrame(rows, "group long, id long, comp long, n long, sketch binary")
    met = groups.in_blocks(d, "group", 384, "sketch").collect()
    assert len(met) <= 20_000 + 6 * (20_000 // 384 + 2) + 3
    by = {}
    for r in met:
        by.setdefault(r.key, []).append(r)
    assert max(map(len, by.values())) < 600
    seen = {}
    for own in by.values():
        for i, x in enumerate(own):
            for y in own[i + 1 :] if len(own) < 50 or x.comp == 0 else [y for y in own[i + 1 :] if y.comp == 0]:
                if x.comp != y.comp and (x.side == 0 or x.side != y.side):
                    seen[min(x.id, y.id), max(x.id, y.id)] = 1
    assert all((i, 20_000 + k) in seen for i in range(20_000) for k in range(6)) and (20_000, 20_002) in seen and (30_000, 30_001) in seen


def test_blocks_by_shingles(spark):
    """A few very long texts are spread like many short ones."""
    rows = [(7, i, i, 1_500_000, b"") for i in range(8)]
    d = spark.createDataFrame(rows, "group long, id long, comp long, n long, sketch binary")
    met = groups.in_blocks(d, "group", 384, "sketch").collect()
    ids = {}
    for r in met:
        ids.setdefault((r.key, r.side), set()).add(r.id)
    assert len(ids) > 8


def test_near_copies_and_an_outlier(spark, monkeypatch):
    """A third of all rows in one group of near copies; one text near them by sketch links with none."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:199], f"tail{i}"])) for i in range(600)] + [(5000, " ".join([*base[:150], *(f"x{i}" for i in range(50))]))] + [(6000 + i, " ".join(f"r{i}x{k}" for k in range(30))) for i in range(1200)]
    got = {r.id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: 0 if i < 600 else i for i in got} and len(got) == len(rows)


def test_chains_and_repeated_rows(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w[i * 8 : i * 8 + 100])) for i in range(8)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in neardup.near_duplicates(d).collect()]
    assert sorted(got, key=str) == brute(rows) and {r[2] for r in got} == {0}


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    t = " ".join(f"w{i % 5000}" for i in range(60_000))
    d = spark.createDataFrame([(1, t), (2, t + " end")], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(d).collect()} == {1}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 4), (4, 1), *[(20, i) for i in range(21, 60)], *[(i, i + 1) for i in range(100, 140)]]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, 8: 8, 9: 8, **{i: 20 for i in range(20, 60)}, **{i: 100 for i in range(100, 141)}}


@pytest.mark.parametrize("shares", [1, 7, 4096])
def test_components_of_hubs(spark, monkeypatch, shares):
    """Hubs of least, greatest and middle id, and random edges, repeated."""
    monkeypatch.setattr(common, "SHARES", shares)
    r = random.Random(shares)
    edges = [(0, i) for i in range(1, 300)] + [(9999, i) for i in range(400, 700)] + [(1500, i) for i in range(1400, 1600)] + [(r.randrange(2000, 3000), r.randrange(2000, 3000)) for _ in range(500)]
    edges += [(5000, i) for i in range(4000, 4100)] + [(6000, i) for i in range(4000, 4100)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = components.connected_components(spark.createDataFrame(edges * 2, "a long, b long")).collect()
    assert len(got) == len(want) and {x.id: x.component for x in got} == want


@pytest.mark.parametrize("limit", [0, 250, 10_000])
def test_few_edges_are_finished_in_one_task(spark, monkeypatch, limit):
    """By steps alone, by steps until few edges are left, and without a step."""
    r = random.Random(4)
    edges = [(r.randrange(150), r.randrange(150, 300)) for _ in range(300)] + [(i, i + 1) for i in range(400, 460)] + [(-7, -9), (2**62, 3)]
    steps, step = [], components._large_star
    monkeypatch.setattr(components, "ONE_TASK", limit)
    monkeypatch.setattr(components, "_large_star", lambda *x: steps.append(x[1]) or step(*x))
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(up | dict(edges) | {b: a for a, b in edges}) and {x.id: x.component for x in got} == {x: root(x) for e in edges for x in e}
    assert not steps if limit == 10_000 else steps and min(steps) > limit


def test_hot_keys_are_dealt(spark):
    """A key with a third of all rows reaches many tasks, and each row meets its side once."""
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)] + [(None, 7)], "k long, i long")
    side = rows.where("k is not null and k <> 3").groupBy("k").agg(F.min("i").alias("low"), F.count("*").alias("_n"))
    plain = rows.join(side.drop("_n"), "k")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = common.spread_join(rows, side, ["k"], 3001, "i")
        assert out.columns == plain.columns and sorted(out.collect()) == sorted(plain.collect())
        held = [x["count"] for x in out.where("k = 0").groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) == 16 and max(held) < 300
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_words_are_the_contracts():
    r, seen = random.Random(1), {}
    for _ in range(1500):
        t = "".join(r.choice("abAB \n\t\r\x0b\x0céÉ\x00\x1cß ") for _ in range(r.randrange(60)))
        words, hashes = t.encode().lower().split(), word_hashes(t).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
