"""Token-id shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents as one array of unsigned 16 or 32
bit integers, and the document ends as an Elias-Fano sequence: low bits packed at
a fixed width, high bits in unary. ``select`` finds the k-th end from the stored
position of every ``SAMPLE``-th one of the unary part and a scan of the few words behind
it, so offsets come from about 2 + log2(tokens / documents) bits a document, without a
table of 64-bit offsets; readers walk a shard by such blocks. Document ids, ascending,
are a second such sequence.

File layout (little endian): magic ``GMTK2``, then per section a 8-byte length and
its bytes: header (JSON: documents, tokens, nulls, id base, width), boundaries, ids
of documents, token ids.

Defined cases: null text = empty text; every document ends in ``end_id``; null
document ids come first, repeated ids are kept side by side, ordered by text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import get_file, put_file, shared_dir, small_batches, spread

_MAGIC = b"GMTK2"
#: Ends of a block: one stored position each.
SAMPLE = 256


class EliasFano:
    """A nondecreasing sequence of integers below ``universe``."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, samples: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.samples, self.high = count, low_bits, low, samples, high

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        l = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if l and n else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, l, low, ones[::SAMPLE].astype("<u8"), np.packbits(bits, bitorder="little"))

    def _low(self, a: int, b: int) -> np.ndarray:
        """Low bits of the values a to b."""
        if not self.low_bits:
            return np.zeros(b - a, np.int64)
        first, last = a * self.low_bits, b * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 : (first & 7) + last - first]
        return (bits.reshape(b - a, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def block(self, j: int) -> np.ndarray:
        """The values j * SAMPLE and on, SAMPLE of them or what is left."""
        a, b = j * SAMPLE, min(self.count, (j + 1) * SAMPLE)
        first = int(self.samples[j]) >> 3
        last = (int(self.samples[j + 1]) + 7) >> 3 if j + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        ones = ones[ones >= int(self.samples[j])][: b - a]
        return ((ones - np.arange(a, b)) << self.low_bits) | self._low(a, b)

    def select(self, k: int) -> int:
        """The k-th value (from 0): from the sample before it, a word at a time."""
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        w = at >> 6
        word = int.from_bytes(self.high[8 * w : 8 * w + 8].tobytes(), "little") >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left -= ones
            w += 1
            word = int.from_bytes(self.high[8 * w : 8 * w + 8].tobytes(), "little")
        for _ in range(left):
            word &= word - 1
        high = w * 64 + (word & -word).bit_length() - 1 - k
        return high << self.low_bits | int(self._low(k, k + 1)[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        return np.concatenate([np.zeros(0, np.int64), *(self.block(j) for j in range(len(self.samples)))])

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.count, self.low_bits, len(self.low), len(self.samples)) + self.low.tobytes() + self.samples.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw) -> EliasFano:
        n, l, low, samples = struct.unpack_from("<QBQQ", raw)
        at = struct.calcsize("<QBQQ")
        return cls(n, l, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, "<u8", samples, at + low), np.frombuffer(raw, np.uint8, offset=at + low + 8 * samples))


def shard_bytes(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """Encode one shard; ``ids`` ascending with nulls first."""
    nulls = sum(i is None for i in ids)
    base = int(ids[nulls]) if nulls < len(ids) else 0
    known = np.array(ids[nulls:], np.int64) - base
    head = json.dumps({"documents": len(ids), "tokens": len(tokens), "nulls": nulls, "base": base, "width": tokens.dtype.itemsize}).encode()
    parts = [head, EliasFano.encode(np.cumsum(lengths), len(tokens) + 1).to_bytes(), EliasFano.encode(known, int(known[-1]) + 1 if len(known) else 1).to_bytes(), tokens.tobytes()]
    return _MAGIC + b"".join(struct.pack("<Q", len(p)) + p for p in parts)


class Shard:
    def __init__(self, raw: bytes):
        if raw[:5] != _MAGIC:
            raise ValueError("not a token shard")
        at, parts = 5, []
        view = memoryview(raw)
        for _ in range(4):
            (n,) = struct.unpack_from("<Q", raw, at)
            parts.append(view[at + 8 : at + 8 + n])
            at += 8 + n
        self.head = json.loads(bytes(parts[0]))
        self.ends, self._ids = EliasFano.from_bytes(parts[1]), EliasFano.from_bytes(parts[2])
        self.tokens = np.frombuffer(parts[3], f"<u{self.head['width']}")

    def __len__(self) -> int:
        return self.head["documents"]

    def bounds(self, k: int) -> tuple[int, int]:
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds(k)
        return self.tokens[a:b]

    def blocks(self) -> Iterator[tuple[int, list[int | None], np.ndarray]]:
        """(first place, ids, bounds) of runs of documents, by the samples of the ends; one bound more than ids."""
        nulls, at = self.head["nulls"], 0
        more = (i + self.head["base"] for j in range(len(self._ids.samples)) for i in self._ids.block(j).tolist())
        known = chain(repeat(None, nulls), more)
        for j in range(len(self.ends.samples)):
            ends = self.ends.block(j)
            yield j * SAMPLE, list(islice(known, len(ends))), np.concatenate([[at], ends])
            at = int(ends[-1])

    def ids(self) -> list[int | None]:
        return [i for _, ids, _ in self.blocks() for i in ids]


_CACHES: dict[tuple, _Encoder] = {}
#: Words of one generation of a worker's cache.
_GENERATION = 600_000
_SEPARATOR = "\x01"
#: UTF-8 of combining marks begins with these bytes.
_COMBINING = re.compile(rb"[\xcc\xcd]|\xe1[\xaa\xab\xb7]|\xe2\x83|\xef\xb8")
_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")
_BLANKS_LOWER = bytes(_BLANKS).lower()


class _Encoder:
    """The library's encoder behind a cache of words.

    Words go to the library many at a time, as one text with a separator of known id
    between them: one call instead of one a word. The cache keeps two generations, so
    frequent words outlive rare ones in bounded memory.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # Lower-case ASCII letters pass normalisation unchanged: the same model without those steps.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.tok, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        between = self._ids(_SEPARATOR)
        self.between = int(between[0]) if len(between) == 1 else None
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str, bare: bool = False) -> np.ndarray:
        return np.array((self.bare if bare else self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _whole(self, words: list[str], bare: bool = False) -> list[bytes] | None:
        """Ids of words of letters alone, each ending in one word-end token; None if that fails."""
        ids = self._ids(" ".join(words), bare)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        raw, cuts = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [raw[a:e] for a, e in zip([0, *cuts], cuts, strict=False)]

    def _parted(self, words: list[str]) -> list[bytes]:
        """Ids of any words, by a separator of known id between them."""
        if self.between is None or any(_SEPARATOR in w for w in words):
            return [self._ids(w).tobytes() for w in words]
        ids = self._ids(f" {_SEPARATOR} ".join(words))
        raw, size, ends = ids.tobytes(), self.dtype.itemsize, np.flatnonzero(ids == self.between)
        return [raw[a:e] for a, e in zip([0, *((ends + 1) * size).tolist()], [*(ends * size).tolist(), len(raw)], strict=True)]

    def _learn(self, words: set[bytes]) -> None:
        """Add words to the cache. A stop behind a letter or digit is a piece of its own."""
        stopped = [w for w in words if w.endswith((b".", b",")) and len(w) > 1 and w[:-1].decode().lower()[-1].isalnum()]
        plain = words.difference(stopped)
        plain.update(w[:-1] for w in stopped)
        plain.update((b".", b","))
        ascii_words, letters, others = [], [], []
        for w in plain.difference(self.new):
            if w.isalpha() and w.islower():  # of bytes: ASCII only
                ascii_words.append(w.decode())
            else:
                t = w.decode()
                (letters if t.isalpha() else others).append(t)
        for group, encode in ((ascii_words, lambda x: self._whole(x, True)), (letters, self._whole), (others, self._parted)):
            for a in range(0, len(group), 2000):
                part = group[a : a + 2000]
                self.new.update(zip((w.encode() for w in part), encode(part) or self._parted(part), strict=True))
        for w in stopped:
            self.new[w] = self.new[w[:-1]] + self.new[w[-1:]]

    def by_word(self, texts: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(texts), 256):
            split = []
            for t in texts[a : a + 256]:
                raw = t.encode()
                # Lower-casing before the library's own is exact without combining marks and special tokens.
                split.append(raw.translate(_BLANKS if b"<|" in raw or (not raw.isascii() and _COMBINING.search(raw)) else _BLANKS_LOWER).split(b" "))
            if len(self.new) > _GENERATION:
                self.old, self.new = self.new, {}
            miss = set().union(*split).difference(self.new)
            again = [w for w in miss if w in self.old]
            self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
            self._learn(miss.difference(again))
            get = self.new.__getitem__
            out += [b"".join(map(get, ws)) for ws in split]
        return out


def encode_texts(texts: list[str], path: str, dtype: str, by_word: bool) -> list[bytes]:
    """Ids of each text, packed. With ``by_word`` pieces between blanks are encoded once and reused.

    That is exact only for a tokenizer that lower-cases, drops white space, never merges
    across it and parts letters from stops; the caller asks for it.
    """
    key = (path, dtype)
    if key not in _CACHES:
        _CACHES[key] = _Encoder(path, dtype)
    enc = _CACHES[key]
    if by_word:
        return enc.by_word(texts)
    return [np.array(e.ids, dtype).tobytes() for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, vocab: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_word: bool = False, shard_tokens: int = 4 << 20) -> list:
    """Write shards in ascending id order; returns the manifest, one row a shard, in order.

    One range shuffle of the texts orders them; a task writes its range as shards of
    about ``shard_tokens`` tokens, each by one atomic rename.
    """
    small_batches(docs.sparkSession)
    dtype = "<u2" if vocab <= 65536 else "<u4"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    end = np.array([end_id], dtype).tobytes()
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal ids, held, size, seq
            path = f"{folder}/part-{part:06d}-{seq:05d}.tok"
            lengths = np.array([len(x) for x in held], np.int64) // np.dtype(dtype).itemsize
            put_file(path, shard_bytes(ids, lengths, np.frombuffer(b"".join(held), dtype)))
            row = {"part": part, "seq": seq, "path": path, "documents": len(ids), "tokens": int(lengths.sum())}
            ids, held, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in it:
            texts = b.column("text").to_pylist()
            for i, x in zip(b.column("id").to_pylist(), encode_texts(texts, tokenizer, dtype, by_word), strict=True):
                ids.append(i)
                held.append(x + end)
                size += len(x) + len(end)
                if size >= shard_tokens * np.dtype(dtype).itemsize:
                    yield flush()
        if ids:
            yield flush()

    return sorted(rows.mapInArrow(run, "part long, seq long, path string, documents long, tokens long").collect(), key=lambda m: (m.part, m.seq))


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, k) of every document, from the files alone.

    ``start`` counts the ids of all documents before it; ``shard`` and ``k`` address it.
    """
    work, start = [], 0
    for i, m in enumerate(manifest):
        work.append((i, m.path, start))
        start += m.tokens
    shards = spark.createDataFrame(work, "task long, path string, start long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.string()), ("k", pa.int64())])

    def run(it):
        for b in it:
            for s in b.to_pylist():
                shard = Shard(get_file(s["path"]))
                for first, ids, bounds in shard.blocks():
                    wide, cuts = shard.tokens[bounds[0] : bounds[-1]].astype("<u4"), (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(wide[a:e]) for a, e in zip(cuts, cuts[1:], strict=False)]
                    cols = [ids, bounds[:-1] + s["start"], np.diff(bounds), crc, [s["path"]] * len(ids), range(first, first + len(ids))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return spread(shards, "task").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, k long")


def encode_corpus(docs: DataFrame, tokenizer: str, vocab: int, end_id: int, by_word: bool = False, folder: str | None = None, **cols) -> DataFrame:
    """Write the token shards of ``docs`` and return their index read back from the files."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, folder or shared_dir(spark), tokenizer, vocab, end_id, by_word=by_word, **cols))
