"""Toxicity from class-conditional Kneser-Ney models.

Two character n-gram models inside words, one of toxic and one of ordinary
documents, are compared. Both are interpolated Kneser-Ney models: the highest order
counts documents that hold a word, every lower one continuations, in how many longer
contexts of its class a letter follows (at a word's start, which has one longer context
only, documents again). Below ``SHARED`` letters both classes back off to one model of
continuation counts pooled over them, so an expression that is rare in both gets the
same mass from both and no evidence arises from the classes' sizes.

A word's evidence is its log-likelihood ratio. A document shows three length-normalised
differences of toxic and ordinary log-likelihood: that of its whole text, a letter; that
of its most toxic passage, a letter; and that of its few strongest words, wherever they
stand. Beside the logarithm of its length a logistic map takes them to (0, 1). The whole
text alone would dilute an insult of a few words in a long document.

The models are fitted on at most ``max_rows`` labelled rows, drawn by the hash of the
id. Every document is scored whole in one narrow pass; only the n-gram table, bounded
by that sample, is broadcast.

Defined cases: null = empty text; it scores like a text without evidence; a document
with several labels counts as toxic if one of them is; repeated rows are scored one by
one; a column named like the score gives way to it; without labels, or labels of one
class, all scores are one constant.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filesystem, materialize, scratch, shared_dir, small_batches
from .words import mix

ORDER = 6
#: Parts of the sample, each scored by a model of the others to fit the score's parameters.
FOLDS = 5
SHARED = 2
DISCOUNT = 0.75
#: A letter speaks for toxicity only if toxic texts showed it after this many letters at least, so often.
SUPPORT, SUPPORT_COUNT = 4, 3
#: Words of a passage and its least letters; bounds on the evidence that one word may give there.
PASSAGE, LETTERS = 24, 100
WORD_LIMIT, WORD_FLOOR = 6.0, -0.25
#: Strongest distinct words of a text that are averaged.
STRONGEST = 6
#: Evidence above which a word counts once in a passage, however often it stands there.
REPEATED = 1.0
FEATURES = 4
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without surrounding punctuation."""
    return [w for w in (x.strip(_STRIP) for x in (text or "").lower().encode().split()) if w]


def _grams(words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the hash of the context and of context plus letter at every letter; and each letter's word.

    Words are framed, so beginnings and endings are letters of their own.
    """
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer(b"\x03".join(words) + b"\x03", np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lens)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    ctx, full, h = [], [], np.zeros(len(flat), np.uint64)
    letter = mix(flat + np.uint64(1))
    for n in range(ORDER):
        # h hashes the n letters before; positions before the word's start give one frame letter.
        if n:
            prev = np.full(len(flat), np.uint64(7777))
            prev[n:] = flat[:-n]
            prev[offset < n] = 2
            if n > 1:
                prev[offset < n - 1] = 0
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + prev + np.uint64(11))
        c = mix(h + np.uint64(n + 1))
        ctx.append(c)
        full.append(mix(c ^ letter))
    return ctx, full, word


_GRAMS = pa.schema([("order", pa.int32()), ("key", pa.int64()), ("ctx", pa.int64()), ("lower", pa.int64()), ("framed", pa.int32()), ("toxic", pa.int64()), ("ordinary", pa.int64())])


def gram_counts(toxic: Counter, ordinary: Counter) -> pa.Table:
    """Counts of all n-grams of the words, each with its context, the n-gram one letter shorter and whether it opens a word."""
    words = sorted(toxic.keys() | ordinary.keys()) or [b"x"]
    weight = np.array([[c.get(w, 0) for w in words] for c in (toxic, ordinary)], np.float64)
    ctx, full, word = _grams(words)
    lens = np.bincount(word)
    offset = np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens)
    parts = []
    for n in range(ORDER):
        keys, first, at = np.unique(full[n], return_index=True, return_inverse=True)
        counts = [np.bincount(at, w[word], len(keys)).astype(np.int64) for w in weight]
        lower = full[n - 1][first] if n else np.zeros(len(keys), np.uint64)
        cols = [np.full(len(keys), n, np.int32), keys.view(np.int64), ctx[n][first].view(np.int64), lower.view(np.int64), (offset[first] < n).astype(np.int32), *counts]
        parts.append(pa.Table.from_arrays([pa.array(c) for c in cols], schema=_GRAMS))
    return pa.concat_tables(parts)


@dataclass
class _Level:
    keys: np.ndarray  # hashes of context plus letter
    counts: np.ndarray  # (2, n): of each class, as the order counts
    seen: np.ndarray  # toxic documents' words that hold it
    ctx: np.ndarray
    total: np.ndarray  # (2, m)
    types: np.ndarray


@dataclass
class Model:
    levels: list[_Level] = field(default_factory=list)
    weights: tuple[float, ...] = (0.0,) * FEATURES
    shift: float = 0.0

    @classmethod
    def fit(cls, toxic: Counter, ordinary: Counter) -> Model:
        return cls.of_grams(gram_counts(toxic, ordinary))

    @classmethod
    def of_grams(cls, grams: pa.Table) -> Model:
        """From the summed counts of all n-grams (order, key, ctx, lower, framed, toxic, ordinary)."""
        order, key, ctx, lower, framed = (grams.column(c).to_numpy() for c in ("order", "key", "ctx", "lower", "framed"))
        both = np.stack([grams.column(c).to_numpy().astype(np.float32) for c in ("toxic", "ordinary")])
        out = cls()
        for n in range(ORDER):
            at = np.flatnonzero(order == n)
            at = at[np.argsort(key[at].view(np.uint64))]
            keys, raw = key[at].view(np.uint64), both[:, at]
            counts = raw
            if n < ORDER - 1:
                longer = order == n + 1
                follows = np.searchsorted(keys, lower[longer].view(np.uint64))
                more = [np.bincount(follows, x, len(keys)) for x in (both[:, longer] > 0).astype(np.float32)]
                if n < SHARED:
                    counts = np.bincount(follows, minlength=len(keys)).astype(np.float32)[None].repeat(2, 0)
                else:
                    counts = np.where(framed[at] == 1, raw, np.stack(more)).astype(np.float32)
            c_keys, c_at = np.unique(ctx[at].view(np.uint64), return_inverse=True)
            total = np.stack([np.bincount(c_at, counts[c], len(c_keys)) for c in (0, 1)])
            types = np.stack([np.bincount(c_at, np.minimum(counts[c], 1), len(c_keys)) for c in (0, 1)])
            out.levels.append(_Level(keys, counts, raw[0], c_keys, total.astype(np.float32), types.astype(np.float32)))
        return out

    def evidence(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word log p(word | toxic) - log p(word | ordinary); the same with what toxic texts support; its letters."""
        if not words:
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        ctx, full, word = _grams(words)
        p = np.full((2, len(word)), 1 / 256)
        support = np.zeros(len(word))
        for n, lv in enumerate(self.levels):
            k = np.minimum(np.searchsorted(lv.keys, full[n]), len(lv.keys) - 1)
            c = np.minimum(np.searchsorted(lv.ctx, ctx[n]), len(lv.ctx) - 1)
            hit = lv.keys[k] == full[n]
            count = np.where(hit, lv.counts[:, k], 0)
            if n >= SUPPORT:
                support = np.maximum(support, np.where(hit, lv.seen[k], 0))
            seen = lv.ctx[c] == ctx[n]
            total, types = np.where(seen, lv.total[:, c], 0), np.where(seen, lv.types[:, c], 0)
            safe = np.maximum(total, 1e-9)
            p = np.where(total > 0, np.maximum(count - DISCOUNT, 0) / safe + np.minimum(DISCOUNT * types, total) / safe * p, p)
        ratio = np.log(p[0]) - np.log(p[1])
        backed = np.where(support >= SUPPORT_COUNT, ratio, np.minimum(ratio, 0.0))
        return np.bincount(word, ratio, len(words)), np.bincount(word, backed, len(words)), np.bincount(word, minlength=len(words))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.shift, -30, 30)))


class Scorer:
    """Remembers the evidence of words while a worker lives."""

    def __init__(self, model: Model):
        self.model, self.place, self.known = model, {}, np.zeros((3, 0))

    def _learn(self, words: set[bytes]) -> None:
        """Places in ``known`` for all words; forgets the others once they are many."""
        new = list(words - self.place.keys())
        if len(self.place) + len(new) > 400_000:
            self.place, self.known = {}, np.zeros((3, 0))
            new = list(words)
        at = len(self.place)
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        parts = [np.stack(self.model.evidence(new[a : a + 20_000])) for a in range(0, len(new), 20_000)]
        self.known = np.concatenate([self.known, *parts], 1)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the evidence of its strongest passage, strongest words and whole, and the log of its length."""
        split = [tokens(t) for t in texts]
        self._learn({w for ws in split for w in ws})
        out = np.zeros((len(texts), FEATURES))
        for i, ws in enumerate(split):
            out[i, 3] = math.log(len(ws) + 10)
            if not ws:
                continue
            at = np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))
            plain, backed, letters = self.known[:, at]
            v = np.clip(backed, WORD_FLOOR, WORD_LIMIT)
            last: dict[int, int] = {}
            for k in np.flatnonzero(v > REPEATED).tolist():
                if k - last.get(at[k], -PASSAGE) < PASSAGE:
                    v[k] = 0.0
                last[at[k]] = k
            w = min(PASSAGE, len(ws))
            s, n = (np.concatenate([[0.0], np.cumsum(x)]) for x in (v, letters))
            out[i, 0] = max(0.0, ((s[w:] - s[:-w]) / np.maximum(n[w:] - n[:-w], LETTERS)).max())
            top = np.sort(np.clip(self.known[1, np.unique(at)], 0.0, WORD_LIMIT))[-STRONGEST:]
            out[i, 1] = top.sum() / STRONGEST
            out[i, 2] = plain.sum() / letters.sum()
        return out


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic fit by Newton steps, lightly regularised, classes as they occur: (weights, shift)."""
    scale = np.maximum(x.std(0), 1e-6)
    z = np.concatenate([x / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - 0.01 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000) -> Model:
    """Fit on the labelled rows of ``docs``, at most ``max_rows``, least id hashes first.

    The n-grams of the sample are counted on executors; the driver gets one row an
    n-gram of letters, far fewer than words. Each fold of the sample is scored by
    a model of the others to fit the logistic map, so it holds for texts that the
    model has not seen; a task builds its fold's model from the counts in shared storage.
    """
    small_batches(docs.sparkSession, 500)
    with scratch(docs.sparkSession):
        return _train(docs, labels, id_col, text_col, max_rows)


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int) -> Model:
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_y"))
    rows = marks.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = rows.withColumn("_f", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int"))
    sample = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(rows), "_id").select("_t", "_y", "_f"))

    def count(it):
        def flush(c):
            for f in range(FOLDS):
                if c[f, 0] or c[f, 1]:
                    t = gram_counts(c[f, 1], c[f, 0])
                    yield from t.add_column(0, pa.field("fold", pa.int32()), pa.array(np.full(t.num_rows, f, np.int32))).to_batches(50_000)

        c = {(f, y): Counter() for f in range(FOLDS) for y in (0, 1)}
        for b in it:
            for t, y, f in zip(*(b.column(k).to_pylist() for k in ("_t", "_y", "_f")), strict=True):
                c[f, int(y)].update(set(tokens(t)))
            if sum(map(len, c.values())) > 100_000:
                yield from flush(c)
                c = {k: Counter() for k in c}
        yield from flush(c)

    kinds = "fold int, order int, key long, ctx long, lower long, framed int, toxic long, ordinary long"
    by = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).cast("int").alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "ordinary")]
    folder = shared_dir(docs.sparkSession)
    sample.mapInArrow(count, kinds).groupBy("order", "key").agg(*[F.any_value(c).alias(c) for c in ("ctx", "lower", "framed")], *by).write.parquet(folder)
    every = F.expr(" + ".join(f"toxic{f}" for f in range(FOLDS))), F.expr(" + ".join(f"ordinary{f}" for f in range(FOLDS)))
    grams = docs.sparkSession.read.parquet(folder).select("order", "key", "ctx", "lower", "framed", every[0].cast("long").alias("toxic"), every[1].cast("long").alias("ordinary")).toArrow()
    model = Model.of_grams(grams if grams.num_rows else gram_counts(Counter(), Counter()))
    del grams
    pa.default_memory_pool().release_unused()
    out = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int64())])

    def evidence(it):
        scorers: dict[int, Scorer] = {}
        for b in it:
            folds = b.column("_f").to_numpy()
            for f in np.unique(folds).tolist():
                part = b.filter(pa.array(folds == f))
                if f not in scorers:
                    scorers.clear()
                    scorers[f] = Scorer(_without(folder, f))
                x = scorers[f].features(part.column("_t").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), out.field("x").type), part.column("_y").cast(pa.int64())], schema=out)

    t = sample.repartitionById(FOLDS, F.col("_f")).mapInArrow(evidence, "x array<double>, y long").toArrow()
    x, y = np.array(t.column(0).to_pylist(), float).reshape(-1, FEATURES), t.column(1).to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights, model.shift = _calibrate(x, y)
    elif len(y):
        model.shift = 5.0 if y[0] else -5.0
    return model


def _without(folder: str, fold: int) -> Model:
    """The model of all folds but one, from the counts in shared storage."""
    fs, path = filesystem(folder)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.endswith(".parquet")]
    names = [f"{c}{k}" for k in range(FOLDS) if k != fold for c in ("toxic", "ordinary")]
    t = pa.concat_tables([pq.read_table(f, filesystem=fs, columns=["order", "key", "ctx", "lower", "framed", *names]) for f in files])
    sums = [sum(t.column(c).to_numpy().astype(np.int64) for c in names if c.startswith(kind)) for kind in ("toxic", "ordinary")]
    some = pa.array(sums[0] + sums[1] > 0)
    t = pa.Table.from_arrays([*(t.column(c).cast(_GRAMS.field(c).type) for c in ("order", "key", "ctx", "lower", "framed")), *map(pa.array, sums)], schema=_GRAMS).filter(some)
    return Model.of_grams(t if t.num_rows else gram_counts(Counter(), Counter()))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``; one narrow pass over whole texts."""
    small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select([c for c in docs.columns if c != score_col])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{score_col}` double"])

    def run(it):
        s = Scorer(handle.value)
        for b in it:
            if b.num_rows:
                yield b.append_column(score_col, pa.array(s.model.score(s.features(b.column(text_col).to_pylist()))))

    return rest.mapInArrow(run, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose labels may be learned from: crc32 of the id's text modulo 3 is not 1."""
    return docs.where(crc_mod(id_col, 3) != 1)
