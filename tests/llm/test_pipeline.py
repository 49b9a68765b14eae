"""The stages on the smallest tables, each judged on its own input, and the SQL of the queries."""
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as cp
from gridmill.llm import mixing, neardup, packing, pii, queries, toxicity
from gridmill.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF))
        outs.append(docs)
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS), name
    start = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.s for r in toxicity.score_documents(start, toxicity.train(start, toxicity.training_rows(spark.read.parquet(f"{SF}/labels.parquet"))), score_col="s").collect()}
    clean, one, safe, mixed, packed = [d.collect() for d in outs]
    assert {r.doc_id for r in clean} == {i for i, s in scores.items() if s < cp.TOXIC}
    kept = {r.id for r in neardup.near_duplicates(outs[0]).where("kept").collect()}
    assert sorted(r.doc_id for r in one) == sorted(kept)
    before = {r.doc_id: r for r in one}
    for r in safe:
        t = before[r.doc_id].text
        assert r.text == pii.redact(t, pii.all_spans(t)[1]) and r.n_chars == len(r.text) and not pii.base_spans(r.text)
    copies = {r.id: r.copies for r in mixing.mix(outs[2], packing.word_count()).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: c for i, c in copies.items() if c})
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in mixed)
    assert cp.run(spark, SF).count() == len(packed)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "Some text of mine " * 9, "en", None, 3), (1, "Some text of mine " * 9, "en", None, 3), (2, None, None, "s", None), (None, "mail jo@x.org now please", "en", "s", 1), (3, "", "en", "s", 0), (4, "x y z " * 50_000, "en", "s", 0)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() >= 1
    d.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=str)
