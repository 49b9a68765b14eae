"""Language-model scores from a log-frequency Bloom filter.

Words and pairs of words are counted over all training documents. The logarithms of
the pairs' counts are quantised, and a pair of level q is put into a Bloom filter as
the items (pair, 1) ... (pair, q); a reader probes levels upwards until one is missing
(Talbot and Osborne 2007). Most pairs occur once and cost one item. Every pair is
counted and stored, however rare.

A pair's key keeps, behind an invertible mix, 36 bits of its first word's hash, so the
number of different successors of each word falls out of the same counts without
moving the words again.

The filter is cut into segments by key, each built by the task that merged the counts
of its keys and written to shared storage, from where workers load it; neither the
driver nor a broadcast carries it. Workers hold at most ``max_bits``. If the pairs need
more, those of the lowest levels stay out of the workers' filter and are looked up by a
join instead, only for the tokens whose pair the filter does not hold; scores are the
same either way, but for the filter's false positives.

Score: sum of log10 p(word | previous) with Witten-Bell smoothing,
(c(previous, word) + T p(word)) / (c(previous) + T), T the number of different
successors of the previous word, so each context has its own weight; p(word) is add-one
smoothed. Base: exact add-one unigrams. Counts of the ``head`` most frequent words are
broadcast; rarer ones are joined, which is exact at any size of vocabulary.

Defined cases: null text = empty text = one end token; no training rows: N = V = 0 and
every score is log10(1) a token; repeated rows are scored one by one; columns named like
an output column give way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, scratch, shared_dir, small_batches
from .words import joined, mix, unmix, word_hashes

#: Hash that stands for the end token; its preimage is no word.
END = np.uint64(0x5EED0FE2D0C4)
#: Ratio of neighbouring levels of counts, and the highest level.
GROWTH, LEVELS = 1.5, 63
PROBES = 5
BITS_AN_ITEM = 9
#: Pairs of a segment of the filter, and tokens that a task counts at a time.
SEGMENT, BLOCK = 1 << 20, 1_500_000
#: Bytes of text scored at a time, but for a longer text.
PIECE = 2 << 20
#: Bytes of (compressed) input a slice of the key space, and the most slices.
SLICE_BYTES, SLICE_BITS = 2 << 20, 20
#: Low bits of a pair's raw key that tell its words apart; the others name the first word.
_WORD_BITS = np.uint64(28)
_WORD_MASK = np.uint64((1 << 28) - 1)


def _edges() -> np.ndarray:
    """Least count of each level from 1; counts of neighbouring levels differ by GROWTH, by one at least."""
    out = [1]
    while len(out) < LEVELS:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * GROWTH)))
    return np.array(out, np.int64)


_LEAST = _edges()
#: The middle of each level's counts; level 0 is absent.
_COUNT = np.concatenate([[0.0], (_LEAST + np.concatenate([_LEAST[1:] - 1, _LEAST[-1:]])) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEAST, counts, "right")


def count_of(levels: np.ndarray) -> np.ndarray:
    return _COUNT[levels]


def pair_keys(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((prev & ~_WORD_MASK) | (joined([prev, word]) & _WORD_MASK))


def context_of(prev: np.ndarray) -> np.ndarray:
    """What a pair's key remembers of its first word."""
    return prev >> _WORD_BITS


def _probe(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and stride of an item's probes, as fractions of a segment in 2^32 parts."""
    h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _place(at: np.ndarray, bits) -> np.ndarray:
    return ((at & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)).astype(np.int64)


def build_segment(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """The bits of one segment: of size in proportion to its items, whole 64-bit words."""
    size = np.uint64(max(1, -(-int(levels.sum()) * BITS_AN_ITEM // 64)) * 64)
    out = np.zeros(int(size), bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= q], levels[levels >= q]
        at, stride = _probe(keys, q)
        for _ in range(PROBES):
            out[_place(at, size)] = True
            at = at + stride
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """All segments: ascending least keys and each one's bits."""

    def __init__(self, lows: np.ndarray, sizes: np.ndarray):
        """Empty segments of so many bytes."""
        self.lows, self.size = lows, (sizes * 8).astype(np.uint64)
        self.first = (np.cumsum(sizes) - sizes) * 8
        self.bits = np.zeros(int(sizes.sum()), np.uint8)

    def put(self, low: int, bits) -> None:
        at = int(self.first[np.searchsorted(self.lows, np.uint64(low))]) // 8
        self.bits[at : at + len(bits)] = np.frombuffer(bits, np.uint8)

    @classmethod
    def load(cls, folder: str) -> Filter:
        """From the files of a table (low, bytes, bits) in shared storage, one row group in memory at a time."""
        fs, path = filesystem(folder)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.endswith(".parquet")]
        tables = [pq.read_table(f, filesystem=fs, columns=["low", "bytes"]) for f in files]
        lows = np.concatenate([np.zeros(0, np.uint64), *(t.column("low").to_numpy().view(np.uint64) for t in tables)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(t.column("bytes").to_numpy() for t in tables)])
        order = np.argsort(lows)
        out = cls(lows[order], sizes[order])
        for f in files:
            with pq.ParquetFile(f, filesystem=fs) as file:
                for b in file.iter_batches(batch_size=4, columns=["low", "bits"]):
                    for low, bits in zip(b.column("low").to_numpy().view(np.uint64), b.column("bits"), strict=True):
                        out.put(low, bits.as_buffer())
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key; a probe that misses ends its key's search at once."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.lows):
            return out
        seg = np.maximum(np.searchsorted(self.lows, keys, "right") - 1, 0)
        live, base, size = np.arange(len(keys)), self.first[seg], self.size[seg]
        for q in range(1, LEVELS + 1):
            at, stride = _probe(keys, q)
            for _ in range(PROBES):
                place = base + _place(at, size)
                hit = np.flatnonzero(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                keys, base, size, live, at, stride = keys[hit], base[hit], size[hit], live[hit], at[hit], stride[hit]
                at = at + stride
            if not len(live):
                break
            out[live] = q
        return out


def _with_end(text) -> np.ndarray:
    return np.append(word_hashes(text), END)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


WORDS, PAIRS, SUCCESSORS = 0, 1, 2
_PART = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TABLE = pa.schema([("kind", pa.int32()), ("low", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("levels", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())])


def _parts(texts: DataFrame, bits: int) -> DataFrame:
    """Counts of the words and pairs of blocks of documents, a row a block, kind and slice of the key space."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(it):
        _forget()  # a worker that has scored before may still hold a filter
        held, size = [], 0

        def out():
            flat = np.concatenate(held)
            held.clear()
            for kind in (WORDS, PAIRS):
                x = flat
                if kind == PAIRS:  # a document follows another's end token
                    x = np.empty_like(flat)
                    for a in range(0, len(flat), 1 << 18):
                        part = flat[a : a + (1 << 18)]
                        x[a : a + (1 << 18)] = pair_keys(np.concatenate([flat[a - 1 : a] if a else [END], part[:-1]]).astype(np.uint64), part)
                    del flat
                x = np.sort(x)
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                keys, counts = x[first], np.diff(first, append=len(x))
                del x, first
                cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                counts = counts.astype("<u4")
                own = [s for s in range(len(edges)) if cuts[s] < cuts[s + 1]]
                for a in range(0, len(own), 64):
                    part = own[a : a + 64]
                    cols = [part, [kind] * len(part), [keys[cuts[s] : cuts[s + 1]].tobytes() for s in part], [counts[cuts[s] : cuts[s + 1]].tobytes() for s in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PART, strict=True)], schema=_PART)

        for b in it:
            for t in b.column(0):
                held.append(_with_end(t.as_py()))
                size += len(held[-1])
                if size > BLOCK:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return texts.mapInArrow(run, "slice int, kind int, keys binary, counts binary")


def _merged(parts: DataFrame) -> DataFrame:
    """The counts of all blocks: words, pairs with their levels, and partial numbers of successors."""

    def table(kind, keys, counts):
        for a in range(0, len(keys), SEGMENT):
            k, c = keys[a : a + SEGMENT], counts[a : a + SEGMENT]
            levels = np.bincount(level_of(c), minlength=LEVELS + 1).tolist() if kind == PAIRS else []
            shown = level_of(c).astype(np.uint8) if kind == PAIRS else c.astype("<i8")
            cols = [[kind], [int(k[0].view(np.int64))], [int(c.sum())], [len(k)], [levels], [k.tobytes()], [shown.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _TABLE, strict=True)], schema=_TABLE)

    def run(it):
        now, held, known = None, [], []

        def merge(limit: int) -> None:
            if sum(len(k) for k, _ in held) > limit:
                held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def close():
            merge(0)
            if held:
                keys, counts = held.pop()
                if now[1] == PAIRS:
                    known.append(_summed(context_of(unmix(keys)), np.ones(len(keys), np.int64)))
                    if sum(len(k) for k, _ in known) > 4_000_000:
                        known[:] = [_summed(*(np.concatenate(x) for x in zip(*known, strict=True)))]
                        if len(known[0][0]) > 2_000_000:
                            yield from table(SUCCESSORS, *known.pop())
                yield from table(now[1], keys, counts)

        for b in it:
            for s, kind, keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if (s, kind) != now:
                    if now:
                        yield from close()
                    now = (s, kind)
                held.append((np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)))
                merge(16_000_000)
        if now:
            yield from close()
        if known:
            yield from table(SUCCESSORS, *_summed(*(np.concatenate(x) for x in zip(*known, strict=True))))

    rows = parts.repartition("slice").sortWithinPartitions("slice", "kind")
    return rows.mapInArrow(run, "kind int, low long, n long, size long, levels array<long>, keys binary, counts binary")


def _rows(merged: DataFrame, kind: int, name: str, value: str, width: str = "<i8", least: int = 0, most: int = 2**62) -> DataFrame:
    """The entries (name, value) of one kind, those with values from ``least`` to ``most``."""
    schema = pa.schema([(name, pa.int64()), (value, pa.int64())])

    def run(it):
        for b in it:
            for keys, counts in zip(*b.columns, strict=True):
                k, c = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), width).astype(np.int64)
                at = np.flatnonzero((c >= least) & (c <= most))
                for a in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[at[a : a + 100_000]]), pa.array(c[at[a : a + 100_000]])], schema=schema)

    return merged.where(F.col("kind") == kind).select("keys", "counts").mapInArrow(run, f"{name} long, {value} long")


class Model:
    """What scoring needs: totals, counts of the head, where the filter lies, and the tables behind them."""

    def __init__(self, n: int, v: int, head: tuple[np.ndarray, ...], folder: str, vocab: DataFrame, rare: DataFrame | None):
        self.n, self.v, self.head, self.folder, self.vocab, self.rare = n, v, head, folder, vocab, rare

    @property
    def total(self) -> float:
        return float((self.n + 1 * (self.v + 1)) if self.n else 1)


def _slices(texts: DataFrame) -> int:
    """Bits of the slice number, from the planner's estimate of the input's bytes; more slices, less memory a task."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(SLICE_BITS, max(4, (min(size, 1 << 50) // SLICE_BYTES).bit_length()))


def train(docs: DataFrame, text_col: str = "text", head: int = 1 << 20, max_bits: int = 1 << 30) -> Model:
    """The model of all rows of ``docs``. ``head`` and ``max_bits`` bound what a worker holds, not what is learnt."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("t"))
    merged = materialize(_merged(_parts(texts, _slices(texts))))
    total = merged.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("v")).first()
    n, v = int(total.n), int(total.v)
    successors = _rows(merged, SUCCESSORS, "x", "t").groupBy("x").agg(F.sum("t").alias("t"))
    words = _rows(merged, WORDS, "h", "c").withColumn("x", F.shiftrightunsigned("h", int(_WORD_BITS)))
    vocab = materialize(words.join(successors, "x", "left").select("h", "c", F.coalesce("t", F.lit(1)).alias("s")))
    # The head: every word whose count exceeds a bound that leaves at most ``head`` words.
    hist = vocab.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head)
    bound = used = 0
    for r in hist.toLocalIterator():
        if used + r.n > head:
            bound = r.c
            break
        used += r.n
    top = vocab.where(F.col("c") > bound).toArrow()
    keys = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    tops = (keys[order], *(top.column(c).to_numpy()[order].astype(np.int64) for c in ("c", "s")))
    by_level = {int(r.q): int(r.n) for r in merged.where(F.col("kind") == PAIRS).select(F.posexplode("levels").alias("q", "n")).groupBy("q").agg(F.sum("n").alias("n")).collect()}
    least = 1
    while least < LEVELS and BITS_AN_ITEM * sum(q * k for q, k in by_level.items() if q >= least) > max_bits:
        least += 1
    schema = pa.schema([("low", pa.int64()), ("bytes", pa.int64()), ("bits", pa.binary())])

    def build(it):
        for b in it:
            for low, keys, counts in zip(*b.columns, strict=True):
                k, q = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
                bits = build_segment(k[q >= least], q[q >= least])
                yield pa.RecordBatch.from_arrays([pa.array([low.as_py()]), pa.array([len(bits)]), pa.array([bits], pa.binary())], schema=schema)

    folder = shared_dir(docs.sparkSession)
    merged.where(F.col("kind") == PAIRS).select("low", "keys", "counts").mapInArrow(build, "low long, bytes long, bits binary").write.parquet(folder)
    rare = _rows(merged, PAIRS, "h", "q", "u1", 1, least - 1) if least > 1 else None
    return Model(n, v, tops, folder, vocab, rare)


_loaded: dict[str, Filter] = {}


def _forget() -> None:
    _loaded.clear()


def _filter(folder: str) -> Filter:
    """The filter, loaded once a worker."""
    if folder not in _loaded:
        _loaded.clear()
        _loaded[folder] = Filter.load(folder)
    return _loaded[folder]


_TAIL = pa.struct([("w", pa.int64()), ("pw", pa.float64()), ("prev", pa.int64()), ("ps", pa.float64()), ("pair", pa.int64()), ("x", pa.float64())])
_TAIL_DDL = "array<struct<w:bigint,pw:double,prev:bigint,ps:double,pair:bigint,x:double>>"


def _score(head, total: float, filt: Filter, whole: bool, docs: list[np.ndarray]):
    """Per document its known head tokens, their log10 counts and score; and the tokens that a join must complete.

    With p the word's own probability, s the previous word's successors and x the pair's
    count, log10 p(word | previous) is log10 p + log10(1 + x / (s p)) plus log10(s / (c + s))
    of the previous word. Every token but the last is the previous word of one, and the
    end token that of the first, so the last part sums over a document's own tokens.
    """
    flat = np.concatenate(docs)
    lens = np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), lens)
    uni, at = np.unique(flat, return_inverse=True)
    h_keys, h_counts, h_next = head
    k = np.minimum(np.searchsorted(h_keys, uni), max(len(h_keys) - 1, 0))
    in_head = h_keys[k] == uni if len(h_keys) else np.zeros(len(uni), bool)
    count = np.where(in_head, h_counts[k], 0) if len(h_keys) else np.zeros(len(uni), np.int64)
    after = np.where(in_head, h_next[k], 1).astype(float) if len(h_keys) else np.ones(len(uni))
    own, weight = np.log10(count + 1.0), np.where(in_head, np.log10(after / (count + after)), 0.0)
    known = np.bincount(doc, in_head[at], len(docs)).astype(np.int64)
    base = np.bincount(doc, own[at], len(docs))
    prev = np.concatenate([[END], flat[:-1]]).astype(np.uint64)
    starts = np.cumsum(lens) - lens
    prev[starts] = END
    prev_at = np.concatenate([[0], at[:-1]])
    prev_at[starts] = np.searchsorted(uni, END)
    pairs = pair_keys(prev, flat)
    x = count_of(filt.levels(pairs))
    p, s = (count[at] + 1) / total, after[prev_at]
    word_in, prev_in = in_head[at], in_head[prev_at]
    sure = word_in & prev_in & (x > 0)
    gain = np.zeros(len(flat))
    gain[sure] = np.log10(1 + x[sure] / (s[sure] * p[sure]))
    score = base + np.bincount(doc, weight[at] + gain, len(docs)) - lens * math.log10(total)
    unsure = (x > 0) & ~sure
    asked = x == 0 if not whole else np.zeros(len(flat), bool)
    tail = np.flatnonzero(~word_in | unsure | asked)

    def column(values, given, kind):
        return pa.array(values[tail], kind, mask=~given[tail])

    parts = [column(flat.view(np.int64), ~word_in, pa.int64()), column(p, word_in, pa.float64()), column(prev.view(np.int64), ~prev_in & (unsure | asked), pa.int64()), column(s, prev_in, pa.float64()), column(pairs.view(np.int64), asked, pa.int64()), column(x, unsure, pa.float64())]
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[tail], minlength=len(docs)))]).astype(np.int32)
    return known, base, score, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_TAIL)))


def _completed(scored: DataFrame, model: Model) -> DataFrame:
    """(_row, _k, _b, _s): what the tokens outside the head add to known tokens, base and score.

    Absent keys get values of their own, so they spread over the join's tasks.
    """
    t = scored.select("_row", F.posexplode("_tail").alias("i", "t")).select("_row", "i", "t.*")
    # Only the words that tails name are looked up in the vocabulary.
    none = F.xxhash64("_row", "i")
    if model.rare is not None:
        level = F.array(*[F.lit(float(c)) for c in _COUNT])
        found = model.rare.select(F.col("h").alias("_pair"), F.get(level, F.col("q").cast("int")).alias("_x"))
        t = t.join(found, F.coalesce("pair", none) == F.col("_pair"), "left").withColumn("x", F.coalesce("x", F.when(F.col("pair").isNotNull(), F.col("_x"))))
    own = model.vocab.select(F.col("h").alias("_w"), F.col("c").alias("cw"), F.col("s").alias("sw"))
    t = t.join(own, F.coalesce("w", none) == F.col("_w"), "left")
    t = t.withColumn("known", F.col("w").isNotNull() & F.col("cw").isNotNull())
    before = model.vocab.select(F.col("h").alias("_p"), F.col("s").alias("sp"))
    far = F.col("prev").isNotNull() & F.col("x").isNotNull()
    near, away = t.where(~far), t.where(far)  # few tokens have a stored pair with a rare word before
    away = away.join(before, F.col("prev") == F.col("_p"), "left").withColumn("ps", F.coalesce("ps", "sp"))
    cols = ["_row", "known", "cw", "sw", "pw", "ps", "x"]
    t = near.select(*cols).unionByName(away.select(*cols))
    p = F.coalesce("pw", (F.col("cw") + 1) / F.lit(model.total))
    gain = F.coalesce(F.log10(1 + F.col("x") / (F.col("ps") * p)), F.lit(0.0))  # none where a part is unknown to the model
    own = F.when(F.col("known"), F.log10(F.col("cw") + 1)).otherwise(0.0)
    weight = F.when(F.col("known"), F.log10(F.col("sw") / (F.col("cw") + F.col("sw")))).otherwise(0.0)
    return t.groupBy("_row").agg(F.count_if("known").alias("_k"), F.sum(own).alias("_b"), F.sum(own + weight + gain).alias("_s"))


def _pieces(b: pa.RecordBatch):
    """The batch in runs of rows of about PIECE bytes of text, which bounds the arrays of their tokens."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False)) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if a < z:
            yield b.slice(a, z - a)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to the columns of ``docs`` (without the text)."""
    small_batches(docs.sparkSession, 500)
    total, folder, whole = model.total, model.folder, model.rare is None
    handle = docs.sparkSession.sparkContext.broadcast(model.head)
    added = ("_row", "n_tokens", "_known", "_base", "_score", "_tail")
    kept = [c for c in docs.columns if c not in (text_col, *added, "n_known", "train_tokens", "base_score", "score")]
    rest = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(kept).schema), f"_row long, n_tokens long, _known long, _base double, _score double, _tail {_TAIL_DDL}"])

    def run(it):
        n, filt = TaskContext.get().partitionId() << 33, None
        for whole_batch in it:
            for b in _pieces(whole_batch):
                filt = filt or _filter(folder)
                ds = [_with_end(t.as_py()) for t in b.column("_text")]
                known, base, score, tail = _score(handle.value, total, filt, whole, ds)
                cols = [*(b.column(c) for c in kept), pa.array(np.arange(n, n + len(ds))), pa.array([len(d) for d in ds], pa.int64()), pa.array(known), pa.array(base), pa.array(score), tail]
                n += len(ds)
                yield pa.RecordBatch.from_arrays(cols, [*kept, *added])

    scored = materialize(rest.mapInArrow(run, schema))
    out = scored.drop("_tail").join(_completed(scored, model), "_row", "left")
    n_known = F.col("_known") + F.coalesce("_k", F.lit(0))
    base = F.col("_base") + F.coalesce("_b", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total))
    score = F.col("_score") + F.coalesce("_s", F.lit(0.0))
    return out.select(*kept, "n_tokens", n_known.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def score_corpus(docs: DataFrame, training: DataFrame, text_col: str = "text", **bounds) -> DataFrame:
    """Train on one table and score another; counts and filter are deleted once the scores are written."""
    with scratch(docs.sparkSession) as keep:
        return keep(score_documents(docs, train(training, text_col, **bounds), text_col))
