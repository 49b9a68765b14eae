import random

import numpy as np
from pyspark.sql import functions as F

from gridmill.llm import common, queries
from gridmill.llm import fingerprint as fp


def _text(r, n):
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def _slow(text):
    """The walks, one character at a time."""
    if not text:
        return "-"
    s, out = [*fp._symbols(text).tolist(), fp._END], ""
    for walk in range(fp.WALKS):
        steps, which = fp._records(walk, 1 << (4 * len(text) + 1024).bit_length())
        at = dict(zip(steps.tolist(), which, strict=True))
        got, pos, j = np.zeros(fp.COORDINATES, int), 0, 0
        while s[pos] != fp._END:
            for b in at.get(j, ()):
                got[b] = fp._digit()[s[pos]]
            pos += fp._moves(walk)[j % fp.PERIOD, s[pos]]
            j += 1
        out += "".join("0123456789abcdef"[x] for x in got)
    return out


def test_side_by_side_equals_one_by_one():
    r = random.Random(3)
    texts = ["", "a", "é漢😀", _text(r, 3), _text(r, 200), "x" * 5000, _text(r, 40)]
    assert fp.fingerprints(texts) == [_slow(t) for t in texts]


def test_likeness_follows_edits():
    r = random.Random(5)
    base = _text(r, 300)
    values = []
    for edits in (0, 3, 30, 150):
        w = base.split()
        for _ in range(edits):
            w[r.randrange(len(w))] = _text(r, 1)
        values.append(fp.likeness(*fp.fingerprints([base, " ".join(w)])))
    other = fp.likeness(*fp.fingerprints([base, _text(r, 300)]))
    assert values[0] == 1 and values[1] > 0.7 and values[0] > values[1] > values[2] > values[3] > other and other < 0.2
    shifted = fp.likeness(*fp.fingerprints([base, "An inserted head. " + base]))
    assert shifted > other + 0.2
    assert fp.likeness("-", "-") == 1 and fp.likeness("-", fp.fingerprints(["a"])[0]) == 0


def _brute_classes(rows, near):
    """Least ids that likeness of ``near`` or more reaches, every pair compared."""
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(rows):
        for j, y in rows[a + 1 :]:
            if x == y or x != "-" and y != "-" and fp.likeness(x, y) >= near:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}


def _change(r, print_, share, walk):
    """A fingerprint equal at just that share of one walk's coordinates, and like a stranger on the others."""
    out = list("".join(r.choice("0123456789abcdef") for _ in print_))
    own = range(walk * fp.COORDINATES, (walk + 1) * fp.COORDINATES)
    kept = r.sample(own, round(share * fp.COORDINATES))
    for i in own:
        out[i] = print_[i] if i in set(kept) else "f" if print_[i] == "0" else "0"
    return "".join(out)


def test_recall_at_the_threshold(spark):
    """Pairs that only one walk joins, with just enough equal coordinates."""
    r = random.Random(2)
    share = fp._least_equal(fp.NEAR) / fp.COORDINATES
    rows = []
    for i in range(600):
        base = "".join(r.choice("0123456789abcdef") for _ in range(fp.WALKS * fp.COORDINATES))
        rows += [(2 * i, base), (2 * i + 1, _change(r, base, share, i % 3))]
        assert fp.NEAR <= fp.likeness(rows[-1][1], base) < fp.NEAR + 0.01
    got = dict(fp.near_classes(spark.createDataFrame(rows, "id long, fingerprint string")).join(spark.createDataFrame(rows, "id long, fingerprint string"), "fingerprint").select("id", "near_class").collect())
    assert sum(got[2 * i + 1] == 2 * i for i in range(600)) >= 0.9 * 600
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(600))


def test_near_classes_by_brute_force(spark, monkeypatch):
    """Chains, copies, a bucket that many share; blocks of a few rows."""
    monkeypatch.setattr(fp, "BLOCK", 7)
    r = random.Random(8)
    rows = []
    for i in range(12):
        p = "".join(r.choice("0123456789abcdef") for _ in range(fp.WALKS * fp.COORDINATES))
        for _ in range(20):
            rows.append((len(rows), p))
            at = r.randrange(len(p) - 4)
            p = p[:at] + "".join(r.choice("0123456789abcdef") for _ in range(4)) + p[at + 4 :]
    rows += [(len(rows) + k, rows[0][1]) for k in range(30)] + [(9000, "-"), (9001, "-")]
    d = spark.createDataFrame(rows, "id long, fingerprint string").repartition(5)
    got = dict(d.join(fp.near_classes(d), "fingerprint").select("id", "near_class").collect())
    assert got == _brute_classes(rows, fp.NEAR)
    assert fp.near_classes(d.limit(0)).count() == 0


def test_hot_bands_are_dealt_without_a_join(spark, monkeypatch):
    """Bands that half of the fingerprints share: each row once with the least id, no row of another band, many parts."""
    monkeypatch.setattr(common, "SHARES", 400)
    r = random.Random(3)
    bands, rows, base = fp._coordinates(), [], "0123456789abcdef" * (fp.WALKS * fp.COORDINATES // 16)
    for i in range(300):
        p = "".join(r.choice("0123456789abcdef") for _ in base)
        rows.append((7 * i, "".join(b if at < 128 else x for at, (b, x) in enumerate(zip(base, p, strict=True))) if i % 2 else p))
    met = {}
    for i, p in rows:
        for k, at in enumerate(bands):
            met.setdefault((k, "".join(p[x] for x in at)), []).append(i)
    want = sorted((min(ids), i) for ids in met.values() if len(ids) > 1 for i in ids)
    reps = spark.createDataFrame(rows, "id long, fingerprint string")
    out = fp._shared_rows(reps)
    assert "LeftOuter" not in out._jdf.queryExecution().toString()
    assert len(want) == 12 * 150 and sorted((x.a, x.id) for x in out.collect()) == want
    hot = out.groupBy("key").agg(F.count("*").alias("n")).collect()
    dealt = fp._banded(reps, {x.key: 6 for x in hot}).where(F.col("key").isin([x.key for x in hot])).groupBy("key", "part").count().collect()
    assert {x.n for x in hot} == {150} and len(dealt) == 72 and max(x["count"] for x in dealt) < 50


def test_neighbours_across_ranges(spark):
    ids = [*range(0, 60, 2), None, 7, 7]
    d = spark.createDataFrame([(i, f"text {i} {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    want = sorted(((i, f"text {i} {k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for size in (4, 1000):
        rows = [tuple(r) for r in fp.with_next(d, rows_a_task=size).collect()]
        parts = {}
        for part, ghost, i, t in rows:
            parts.setdefault(part, []).append((ghost, i, t))
        pairs = []
        for own in parts.values():
            real = [x for x in own if not x[0]]
            ghost = next(x for x in own if x[0])
            pairs += [(a[1:], b[1:]) for a, b in zip(real, [*real[1:], ghost], strict=True)]
        assert sorted(pairs, key=str) == sorted(zip(want, [*want[1:], want[0]], strict=True), key=str)


def test_query_handles_one_and_no_row(spark, tmp_path):
    d = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = queries.op3_fingerprints(spark, str(tmp_path)).collect()
    assert (r.doc_id, r.n_chars, r.near_next, r.near_class) == (4, 8, 1.0, 4) and queries.edited("abcdefgh", "abcdefgh") == "abcdefab"
    d.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert queries.op3_fingerprints(spark, str(tmp_path)).count() == 0
