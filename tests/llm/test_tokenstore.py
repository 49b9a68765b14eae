import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmill.llm import queries, tokenstore as ts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.int64))
    e = ts.EliasFano.from_bytes(ts.EliasFano.encode(v, int(v[-1]) + 1 if len(v) else 1).to_bytes())
    assert e.values().tolist() == v.tolist() and [e.select(k) for k in range(len(v))] == v.tolist()


def test_space_is_near_minimal():
    v = np.sort(np.random.default_rng(1).integers(0, 10**7, 10_000))
    assert len(ts.EliasFano.encode(v, 10**7).to_bytes()) * 8 / 10_000 < 2 + np.log2(1000) + 1.1


def test_shard_round_trip():
    docs = [np.arange(n, dtype="<u2") for n in (1, 5, 1, 300, 2)]
    ids = [None, None, 3, 3, 10**12]
    s = ts.Shard(ts.shard_bytes(ids, np.array([len(d) for d in docs]), np.concatenate(docs)))
    assert s.ids() == ids and all((s.document(k) == d).all() for k, d in enumerate(docs))


def test_words_equal_whole_texts():
    path = queries.tokenizer_path()
    texts = ["", "  ", "a<|endoftext|>b <|STARTOFTEXT|>. X", "H̱ , Tést. É.", "\x01 a\x01b, c", "ÀÉ, ß. İstanbul ΣΑΣ, ΣΑΣ. x²,\ny½. don't, it's. 'S. 12.5, 3,4　a b\x0b\x0cq", "»foo.«, «bar», _a_. b_, c", " ,. a.. b., c ,d", "Tabs\tand\r\nlines."]
    assert ts.encode_texts(texts, path, "<u2", True) == ts.encode_texts(texts, path, "<u2", False)


def test_query_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(5, "Hello, world. " * 50), (2, None), (9, "same"), (9, "same"), (None, "no id"), (1, "")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").write.parquet(str(tmp_path / "documents.parquet"))
    tok, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op4_token_store(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert queries.op4_token_store(spark, str(tmp_path)).count() == 0
