import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import lmscore, mixing, packing, queries, toxicity, veclinks, words

SF = "/root/testdata/sf0.01"


# Packing ----------------------------------------------------------------------------

def test_boundaries_by_enumeration():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 9)
        lengths = sorted(r.sample(range(0, 60), n))
        counts = [r.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5):
            got = packing.optimal_boundaries(lengths, counts, k)
            best = min(packing.padding(lengths, counts, [*c, lengths[-1]]) for m in range(min(k, n)) for c in itertools.combinations(lengths[:-1], m))
            assert len(got) <= k and packing.padding(lengths, counts, got) == best
    assert packing.optimal_boundaries([], [], 3) == []


def test_batches(spark):
    rows = [(i, random.Random(i).choice([0, 3, 10, 11, 500, 70000])) for i in range(300)] + [(7, 3), (7, 3), (None, 3), (8, None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, n long, bucket int")
    got = packing.pack(d, "n", buckets=4, token_budget=1000).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, n or 0) for i, n in rows)
    places = Counter((r.bucket, r.batch, r.slot) for r in got)
    assert max(places.values()) == 1
    for (bucket, batch), own in itertools.groupby(sorted(got, key=lambda r: (r.bucket, r.batch)), key=lambda r: (r.bucket, r.batch)):
        own = list(own)
        assert len(own) * own[0].bucket_length <= 1000 or len(own) == 1
        assert all(0 <= r.padding == r.bucket_length - r.n_tokens for r in own)
    full = Counter((r.bucket, r.batch) for r in got)
    for b in {b for b, _ in full}:
        sizes = [full[b, k] for k in range(1 + max(k for x, k in full if x == b))]
        assert len(set(sizes[:-1])) <= 1 and min(sizes) >= 1
    assert packing.pack(d.limit(0), "n").count() == 0


# Mixing -----------------------------------------------------------------------------

def slow_targets(sizes, weights, most=3):
    """Share, cut, share the rest again."""
    free, out, left = set(sizes), {}, float(sum(sizes.values()))
    while free:
        weight = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / weight > most * sizes[k]}
        if not over:
            return out | {k: left * weights[k] / weight for k in free}
        out |= {k: float(most * sizes[k]) for k in over}
        left -= sum(most * sizes[k] for k in over)
        free -= over
    return out


def test_targets(spark):
    r = random.Random(9)
    for sizes in ([10, 10], [100, 1, 0], [5], [0, 0], [1, 2, 3, 500, 4, 1, 90], *([r.choice([0, 1, 7, 50, 4000]) for _ in range(r.randint(1, 12))] for _ in range(6))):
        d = spark.createDataFrame([(str(i), s, i % 3 + 1) for i, s in enumerate(sizes)], "source string, source_size long, weight long")
        want = slow_targets(dict(enumerate(sizes)), {i: i % 3 + 1 for i in range(len(sizes))})
        assert {int(x.source): round(x.target, 6) for x in mixing.capped_targets(d).collect()} == {k: round(v, 6) for k, v in want.items()}


def test_ranks(spark):
    names = ["b", "", "a", None, "É", "Z", "\U0001f600", "\uffee"]
    got = {r.source: r.rank for r in mixing.numbered(spark.createDataFrame([(n,) for n in names], "source string").repartition(3)).collect()}
    assert got == {n: i for i, n in enumerate([*sorted(n for n in names if n is not None), None])}


def _cells(seed, sources, bands):
    r = np.random.default_rng(seed)
    mass = np.floor(r.gamma(0.7, 400, (sources, bands))) * (r.random((sources, bands)) < 0.8)
    mass[:, 0] += 1
    target = mass.sum(1) * np.minimum(3, r.gamma(2, 0.5, sources))
    return mass, target


@pytest.mark.parametrize("seed", range(3))
def test_balance_is_the_least_entropy(spark, seed):
    """Sources are met, none above the bound, and no small change that keeps them is closer to 1."""
    mass, target = _cells(seed, 6, 5)
    d = spark.createDataFrame([(float(t), m.tolist()) for m, t in zip(mass, target)], "target double, mass array<double>").repartition(3)
    mu = mixing.balance(d, bands=5)
    rates = np.stack([mixing.tilt(m, t, mu)[1] for m, t in zip(mass, target)])
    assert np.allclose((mass * rates).sum(1), target) and rates.max() <= 3 and rates.min() >= 0
    goal = mass.sum(0) * target.sum() / mass.sum()

    def cost(r):
        miss = (mass * r).sum(0) - goal
        return (mass * (r * np.log(np.maximum(r, 1e-300)) - r)).sum() + (miss**2 / (2 * mixing.SOFT * goal)).sum()

    g, best = np.random.default_rng(1), cost(rates)
    for _ in range(300):
        step = g.standard_normal(mass.shape) * 1e-3 * (mass > 0)
        step -= ((mass * step).sum(1) / np.maximum((mass**2).sum(1), 1))[:, None] * mass
        new = rates + step
        if new.max() <= 3 and new.min() >= 0:
            assert cost(new) >= best - 1e-6 * abs(best)


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["s1", "s2", "s3", None]) if i % 3 else "s1", " ".join("w" * r.randint(0, 60)), 1) for i in range(1500)] + [(1, "s1", "a b", 1)] * 3 + [(None, "s2", "a", 1), (5000, "only empty", None, 1), (6000, "s3", "w " * 4000, 1)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    run = lambda x: sorted((tuple(y) for y in mixing.mix(x, packing.word_count()).collect()), key=str)
    got = run(d)
    assert got == run(d.repartition(7))
    sizes, taken = Counter(), Counter()
    for _id, source, size, n, source_size, target, _rate, copies in got:
        assert 0 <= copies <= 3
        taken[source] += size * n * copies
        sizes[source] += size * n
    want = slow_targets(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(["only empty", "s1", "s2", "s3", None])})
    for _id, source, _size, _n, source_size, target, _rate, _copies in got:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6
        assert abs(taken[source] - target) <= max(2, 0.01 * target)
    assert sum(n for *_, n, _s, _t, _r, _c in got) == len(rows)
    assert mixing.mix(d.limit(0), packing.word_count()).count() == 0


def test_bands_keep_their_shares(spark):
    """Long texts lie in one source that is cut; without balanced bands their share would fall with it."""
    rows = [(i, "big", 40 if i % 2 else 300) for i in range(3000)] + [(5000 + i, "small", 40 if i % 5 else 300) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n long"), F.col("n")).collect()
    long_before = sum(n for *_, n in rows if n == 300) / sum(n for *_, n in rows)
    taken = Counter()
    for r in got:
        taken[r.size] += r.size * r.copies
    plain = Counter()
    for r in got:
        plain[r.size] += r.size * r.target / r.source_size
    assert abs(taken[300] / sum(taken.values()) - long_before) < 0.6 * abs(plain[300] / sum(plain.values()) - long_before)


# Toxicity ---------------------------------------------------------------------------

def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    s = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(y[i], r.predicted) for i, r in s.items() if r.held_out and i in y]
    hit, clean = [p for t, p in out if t == 1], [p for t, p in out if t == 0]
    assert np.mean(hit) >= 0.7 and np.mean(clean) <= 0.005
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in s.items())


def _slow_kn(toxic, ordinary, word):
    """The model letter by letter, from the definition."""
    def grams(w):
        s = [0] * (toxicity.ORDER - 2) + [2, *w, 3]
        for i in range(toxicity.ORDER - 1, len(s)):
            for n in range(toxicity.ORDER):
                yield n, tuple(s[i - n : i]), s[i], i - (toxicity.ORDER - 1) < n

    raw = [Counter(), Counter()]
    for c, counts in enumerate((toxic, ordinary)):
        for w, k in counts.items():
            for g in grams(w):
                raw[c][g] += k
    every = set(raw[0]) | set(raw[1])

    def count(c, n, ctx, x, framed):
        if n == toxicity.ORDER - 1 or n >= toxicity.SHARED and framed:
            return raw[c][n, ctx, x, framed]
        longer = [g for g in every if g[0] == n + 1 and g[1][1:] == ctx and g[2] == x]
        return len(longer) if n < toxicity.SHARED else sum(raw[c][g] > 0 for g in longer)

    ratio = 0.0
    for c, sign in ((0, 1), (1, -1)):
        at = list(grams(word))
        for a in range(0, len(at), toxicity.ORDER):
            p = 1 / 256
            for n, ctx, x, framed in at[a : a + toxicity.ORDER]:
                own = {g[2]: count(c, n, ctx, g[2], g[3]) for g in every if g[0] == n and g[1] == ctx}
                total = sum(own.values())
                if total:
                    types = sum(v > 0 for v in own.values())
                    p = max(own.get(x, 0) - toxicity.DISCOUNT, 0) / total + min(toxicity.DISCOUNT * types, total) / total * p
            ratio += sign * math.log(p)
    return ratio


def test_model_by_its_definition():
    toxic, ordinary = Counter({b"scum": 5, b"scam": 2, b"the": 9, b"cum": 1}), Counter({b"the": 40, b"then": 7, b"scan": 3, b"hen": 2, b"um": 1})
    m = toxicity.Model.fit(toxic, ordinary)
    for w in (b"scum", b"scan", b"then", b"hens", b"zebra", b"u"):
        assert abs(m.evidence([w])[0][0] - _slow_kn(toxic, ordinary, w)) < 1e-4, w


def test_toxicity_rows(spark):
    bad, good = "you are a vile grubbish person today", "the weather is fine and the sea is calm"
    docs = spark.createDataFrame([(i, bad if i % 4 == 0 else good, 1.0) for i in range(200)] + [(900, None, 1.0), (901, "", 1.0), (902, ("fine calm sea " * 20_000) + "grubbish", 1.0), (902, bad, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, 0), (4, None)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    got = [(r.doc_id, r.score) for r in toxicity.score_documents(docs, m).collect()]
    assert len(got) == 204 and all(s > 0.7 for i, s in got if i < 200 and i % 4 == 0) and all(s < 0.3 for i, s in got if i < 200 and i % 4)
    assert all(s < 0.5 for i, s in got if i in (900, 901)) and max(s for i, s in got if i == 902) > 0.7
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs.limit(3), none).collect()} == {0.5}


# Language model -----------------------------------------------------------------------

def test_mix_is_invertible():
    x = np.random.default_rng(1).integers(0, 2**64, 10_000, np.uint64)
    assert (words.unmix(words.mix(x)) == x).all()


def test_filter_never_forgets():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 50_000, np.uint64))
    counts = r.geometric(0.3, len(keys)) ** 3
    levels = lmscore.level_of(counts)
    parts = np.array_split(np.arange(len(keys)), 3)
    segments = [lmscore.build_segment(keys[p], levels[p]) for p in parts]
    f = lmscore.Filter(np.array([keys[p[0]] for p in parts]), np.array([len(x) for x in segments]))
    for p, x in zip(parts, segments, strict=True):
        f.put(keys[p[0]], x)
    got = f.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.96
    assert (f.levels(r.integers(2**63, 2**64, 20_000, np.uint64)) > 0).mean() < 0.03
    assert len(f.bits) * 8 < 1.01 * lmscore.BITS_AN_ITEM * levels.sum() + 200
    about = lmscore.count_of(levels)
    assert (np.abs(about - counts) <= 0.25 * counts + 0.5)[levels < lmscore.LEVELS].all()


def _lm_rows():
    r = random.Random(6)
    words = ["The", "sea", "is", "calm", "É", "blue", "and", "old"]
    rows = [(i, " ".join(r.choice(words[: r.randint(2, 8)]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "never seen before"), (902, "the SEA"), (None, "sea\tsea"), (903, "calm " * 30_000)]


def _lm_brute(rows, about):
    """The scores with counts of pairs as the filter's levels round them."""
    c, pair, after = Counter(), Counter(), {}
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            w = [*(t or "").encode().lower().split(), None]
            c.update(w)
            pair.update(zip([None, *w], w))
    for h, w in pair:
        after.setdefault(h, set()).add(w)
    n, v = sum(c.values()), len(c)
    out = []
    for _, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        p = [(c[x] + 1) / (n + v + 1) for x in w]
        s = [len(after.get(h, ())) for h in [None, *w[:-1]]]
        cond = [(about(pair[h, x]) + k * q) / (c[h] + k) if k else q for h, x, k, q in zip([None, *w], w, s, p)]
        out.append((len(w), sum(c[x] > 0 for x in w), n, round(sum(map(math.log10, p)), 6), round(sum(map(math.log10, cond)), 6)))
    return sorted(out)


@pytest.mark.parametrize("head,bits", [(1 << 20, 1 << 30), (3, 1 << 30), (1 << 20, 250), (3, 1), (0, 1)])
def test_scores_by_brute_force(spark, monkeypatch, head, bits):
    """Every bound gives the same scores: what workers do not hold is joined. Hashes are fixed, and these pairs hit nothing falsely."""
    monkeypatch.setattr(lmscore, "BLOCK", 3000)
    rows = _lm_rows()
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7) == 2
    got = [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lmscore.score_corpus(d, d.where(~held), head=head, max_bits=bits).collect()]
    assert sorted(got) == _lm_brute(rows, lambda k: lmscore.count_of(lmscore.level_of(np.array([k])))[0] if k else 0.0)


def test_a_context_sums_to_one():
    """Witten-Bell over all words and one unseen, with exact counts: no mass is lost."""
    c = {"a": {"b": 3, "c": 1}, "b": {"a": 2, "c": 1}}
    uni = {"a": 2, "b": 3, "c": 2}
    n, v = 7, 3
    p = lambda w: (uni.get(w, 0) + 1) / (n + v + 1)
    for h, own in c.items():
        t, total = len(own), sum(own.values())
        assert abs(sum((own.get(w, 0) + t * p(w)) / (total + t) for w in (*uni, "unseen")) - 1) < 1e-12


def test_pairs_of_words_help_held_out_texts(spark):
    s = queries.op9_lm_score(spark, SF).where("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert 0 > s.m > s.b


def test_joined_pairs_score_like_the_filter(spark):
    """On the tables: with a filter of a tenth the scores differ by the filter's false hits alone."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: (r.score, r.n_tokens) for r in lmscore.score_corpus(d, d).collect()}
    part = {r.doc_id: r.score for r in lmscore.score_corpus(d, d, head=2000, max_bits=1 << 20).collect()}
    assert whole.keys() == part.keys()
    assert max(abs(part[i] - s) / n for i, (s, n) in whole.items()) < 0.03


def test_no_training_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lmscore.score_corpus(d, d.limit(0))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lmscore.score_corpus(d.limit(0), d).count() == 0


# Vectors --------------------------------------------------------------------------------

def brute_links(rows, cosine=0.98, dtype=np.float32):
    ok = [v is not None and len(v) > 0 and lb is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lb in rows]
    n, link = len(rows), {}
    x = [np.array(v, dtype).astype(float) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and np.dot(x[a], x[b]) / math.sqrt(np.dot(x[a], x[a]) * np.dot(x[b], x[b])) >= cosine:
                link.setdefault(a, set()).add(b)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in link.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min((rows[b][0] for b in seen), default=None) if rows[a][0] is not None else None
        out.append((rows[a][0], len(link.get(a, ())), low, rows[a][0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 5])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(veclinks, "BLOCK", block)
    r = np.random.default_rng(7)
    rows = []
    for c in range(12):
        center = r.standard_normal(16)
        rows += [(len(rows) + k, (center + r.standard_normal(16) * r.choice([0.02, 0.12, 0.3])).tolist(), int(c % 3)) for k in range(12)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], 1), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] * 16, 0), (1006, rows[1][1][:8], 0), (1007, rows[0][1], None), (None, rows[0][1], 0), (1008, [], 0), (1009, [None] * 16, 0), (1010, [float("inf")] + [1.0] * 15, 0)]
    rows += [(1011, [2 * x for x in rows[0][1]], 0), (1012, [0.0, 1.0], 2), (1013, [-0.0, 1.0], 2), (1014, [0.0, -1.0], 2)]
    d = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    assert sorted((tuple(x) for x in veclinks.vector_links(d).collect()), key=str) == brute_links(rows)
    assert veclinks.vector_links(d.limit(0)).count() == 0


def test_filters_lose_no_link(spark):
    """All pairs just above the threshold, in the tables' dimension."""
    r = np.random.default_rng(11)
    a = r.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((1500, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = 0.9802 * a + math.sqrt(1 - 0.9802**2) * b
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, near]))]
    got = veclinks.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links >= 1").count() == 3000


def _spread(kind, r):
    """Two independent vectors of a kind whose norm is not spread over the dimensions."""
    dim = {"two": 2, "three": 3, "twelve": 12}.get(kind, 64)
    if kind == "low rank":
        return r.standard_normal((2, 3)) @ np.random.default_rng(1).standard_normal((3, dim))
    if kind == "one-hot":
        return np.eye(dim)[r.choice(dim, 2, replace=False)]
    scale = {"first half": np.arange(dim) < 32, "last half": np.arange(dim) >= 32, "sparse": np.arange(dim) % 16 == 0, "decaying": 0.8 ** np.arange(dim)}
    return r.standard_normal((2, dim)) * scale.get(kind, np.ones(dim))


@pytest.mark.parametrize("n", [5000, 1_000_000, 100_000_000])
@pytest.mark.parametrize("kind", ["dense", "first half", "last half", "sparse", "decaying", "low rank", "one-hot", "two", "three", "twelve"])
def test_vectors_of_any_kind_share_filters(n, kind):
    """Pairs just above the threshold, with the filters planned for so many vectors: recall 0.99 at least."""
    r, missed = np.random.default_rng(13), 0
    for _ in range(400):
        a, b = _spread(kind, r)
        a /= np.linalg.norm(a)
        b = b - (a @ b) * a
        b *= math.sqrt(1 - 0.9802**2) / np.linalg.norm(b)
        caps = veclinks.plan_caps(n, len(a), 0.98)
        missed += not len(np.intersect1d(caps.decode(a), caps.decode(0.9802 * a + b)))
    assert missed <= 4


def test_tiny_and_huge_numbers(spark):
    a, b = [1.0, 0.5, 0.25], [1.0, 0.5, 0.2500001]
    rows = [(2 * i + k, [x * s for x in v], 1) for i, s in enumerate((1e-300, 1e-200, 1.0, 1e200, 1e300)) for k, v in enumerate((a, b))] + [(50, [1e-310, 0.0, 0.0], 1), (51, [3e-310, 0.0, 0.0], 1), (52, [-3e300, 0.0, 0.0], 1)]
    got = {r.id: (r.n_links, r.component_id) for r in veclinks.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (9, 0) for i in range(10)}, 50: (1, 50), 51: (1, 50), 52: (0, 52)}


def test_one_sided_links_by_brute_force(spark):
    """Half of each vector is zero, lengths differ; every pair is compared the plain way."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(150):
        dim = (64, 64, 3, 10)[i % 4]
        a = np.concatenate([r.standard_normal(dim - dim // 2), np.zeros(dim // 2)])
        rows += [(10 * i + k, (a + 0.13 * k * np.concatenate([r.standard_normal(dim - dim // 2), np.zeros(dim // 2)]) * np.abs(a).mean()).tolist(), i % 2) for k in range(3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, ok = sorted(tuple(x) for x in veclinks.vector_links(d).collect()), np.array([v for _, v, _ in rows], object)
    want = sorted(brute_links([(i, np.array(v, np.float64), lb) for i, v, lb in rows], dtype=np.float64))
    assert len(ok) == len(got) and got == want
