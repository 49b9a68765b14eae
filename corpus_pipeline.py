"""A corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
``run`` writes each stage's result as Parquet into the shared folder, rereads it and
deletes what the stage made on its way.

Defined cases: null texts count as empty and stay null; rows without an id or a source
are kept and mixed like others; rows that share an id are one document to the near
duplicates and one row of the first kind that comes; equal rows are mixed alike; an empty
table gives no rows; columns other than those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import mixing, neardup, packing, pii, toxicity
from gridmill.llm.common import materialize, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7
#: Most ids, and most rows with sources, that are broadcast (about 10 MB); more are joined by shuffles.
BROADCAST_IDS, BROADCAST_ROWS = 500_000, 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC; the model learns from the labelled training rows."""
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs.select(*COLUMNS), model, score_col="_score")
    return scored.where(F.col("_score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the least id; rows without an id all stay."""
    found = neardup.near_duplicates(docs)
    gone = materialize(found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct())
    few = gone.count() <= BROADCAST_IDS
    kept = docs.select(*COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = found.where("kept and id is not null").groupBy("id").count().where("count > 1")
    if twice.isEmpty():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks; n_chars follows the text."""
    found = pii.find_pii(docs.select(*COLUMNS), redacted_col="_clean")
    text = F.when(F.col("text").isNotNull(), F.col("_clean"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix asks for, none included."""
    docs = docs.select(*COLUMNS).withColumn("_size", packing.word_count())
    mixed = mixing.mix(docs, F.col("_size")).where("copies > 0")
    copies = materialize(mixed.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), "copies"))
    few = copies.count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source")) & (docs["_size"] == F.col("_words"))
    rows = docs.join(F.broadcast(copies) if few else copies, same)
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in length buckets and batches."""
    return packing.pack(docs.select("doc_id", packing.word_count().alias("n")), "n")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep_last:
        for _, stage in STAGES:
            with scratch(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir))
        return keep_last(docs)
