"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, lmscore, mixing, neardup, packing, pii, tokenstore, toxicity, veclinks, warc
from .common import crc_mod, materialize, small_batches, table


def _joined(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))

    def page(c: str):
        return F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")

    return records.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def edited(text: str, after: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = fingerprint.with_next(table(spark, sf_dir, "documents"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def done(rows):
        """All rows but the last of a run of neighbours, and any that no neighbour follows in its range."""
        texts = [r[3] for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        new = [edited(texts[i], texts[i + 1]) for i in own]
        prints = fingerprint.fingerprints(texts + new)
        after = prints[len(texts) :]
        out = [(rows[i][2], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), prints[i], p, fingerprint.likeness(prints[i], p), fingerprint.likeness(prints[i], prints[i + 1])) for i, e, p in zip(own, new, after, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema) if out else None

    def run(it):
        held, size = [], 0
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= fingerprint.BLOCK_CHARS // 2:
                    if (x := done(held)) is not None:
                        yield x
                    held, size = held[-1:], len(row[3])
        if held and (x := done(held)) is not None:
            yield x

    prints = materialize(rows.select("part", "ghost", "id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
    classes = fingerprint.near_classes(prints.select(F.col("doc_id").alias("id"), "fingerprint"))
    return prints.join(classes, "fingerprint").select(*names, "near_class")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tokenstore.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path(), vocab=49_408, end_id=1, by_word=True)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", packing.word_count().alias("n"))
    return packing.pack(rows, "n")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.training_rows(labels))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), packing.word_count())
    each = mixed.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_i"), "*")
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return lmscore.score_corpus(docs, docs.where(~F.col("held_out")))


def op10_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veclinks.vector_links(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_fingerprints, op4_token_store, op5_near_dedup, op6_length_buckets, op7_toxicity, op8_mixing, op9_lm_score, op10_vector_links)}

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND payload_bytes >= 1000
""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, f.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) f ON r.b = f.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op10_vector_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([z for z in embedding if z IS NULL OR NOT isfinite(z)]) = 0
    AND len([z for z in embedding if z <> 0]) > 0),
e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q
  ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept
FROM embeddings m JOIN c ON c.a = m.vec_id
""",
}
