"""Ingestion of documents into the store, continuous or by batch, and session memory as streams.

The store is a folder of four append-only tables. Every run writes its rows under a
``version`` of its own, the documents last: a document's rows count from the moment its
row in ``documents`` names their version, and only those of its newest completed version
do. So a run that fails leaves nothing visible, a document that is read again loses the
tables it no longer has, and no run rewrites what others wrote.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog, chunks, search, tables
from ..operators import facts as fact_ops
from ..sources.readers import markdown_provider, recognise, upload_files


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """New PDF files as they arrive, one row a distinct content seen within a day."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_a_batch).load(path)
    s = s.select("path", "modificationTime", F.sha2("content", 256).alias("file_hash"), "content")
    return s.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["file_hash"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the store as it stands: the rows of each document's newest completed version.

    ``documents`` itself shows each document's newest row, whatever its status.
    """
    every = spark.read.parquet(f"{root}/documents")
    if name == "documents":
        newest = every.groupBy("id").agg(F.max("version").alias("version"))
        return every.join(newest, ["id", "version"])
    newest = every.where("status = 'completed'").groupBy(F.col("id").alias("document_id")).agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{root}/{name}").join(newest, ["document_id", "version"], "left_semi").drop("version")


def document_text(pages: DataFrame) -> DataFrame:
    """(document_id, markdown): a document's pages in order, under their marks."""
    own = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("number", "markdown"))).alias("_p"))
    return own.select("document_id", tables.pages_to_markdown(F.col("_p")).alias("markdown"))


def text_chunks(docs: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """Chunks of documents (document_id, source_file, markdown) with headings, page, id and vector."""
    cut = chunks.chunk_documents(docs, "markdown")
    cut = cut.withColumn("heading_context", chunks.heading_context(F.col("markdown"), F.col("start_offset")))
    spans = tables.page_spans(docs).select("document_id", "page", "page_start", "page_end")
    cut = tables.page_of_offset(cut.drop("markdown"), spans, "document_id", "start_offset")
    cut = cut.withColumns({"id": chunks.chunk_id(F.col("document_id"), F.col("chunk_id"), F.col("content")), "section": chunks.section(F.col("heading_context")), "processed_date": F.current_timestamp()})
    return search.embed(cut.withColumn("_t", chunks.embed_text(F.col("heading_context"), F.col("content"))), "_t", provider=embedder).drop("_t")


def ingest_batch(files: DataFrame, root: str, provider: Callable = markdown_provider, embedder: Callable | None = None, force: bool = False) -> None:
    """Take files (path, file_hash, content) into the store.

    Known documents are skipped unless they failed before or ``force`` is set. Text is
    recognised once; a file whose recognition fails becomes a failed document and costs
    no other. Tables become facts and registry rows, the text around them chunks.
    """
    spark, version = files.sparkSession, time.time_ns()

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/{name}/version={version}")
        return spark.read.parquet(f"{root}/{name}/version={version}")

    files = files.dropDuplicates(["file_hash"]).withColumn("id", F.col("file_hash"))
    if _exists(spark, f"{root}/documents"):
        files = catalog.register(read_table(spark, root, "documents"), files, force).where("action <> 'skip'")
    files = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    recognised = put("pages", recognise(files, provider, errors=True))
    names = put("uploads", files.select(F.col("id").alias("document_id"), "filename", "file_hash"))
    pages = recognised.where("error is null").select("document_id", "number", "markdown")
    found = put("tables", fact_ops.table_ids(tables.extract_tables(pages)).withColumn("description", fact_ops.describe(F.col("headers"))))
    cells, profiles = fact_ops.ingest_tables(found)
    cells = catalog.with_fts(fact_ops.cap_facts(cells)).repartition("table_id", F.pmod(F.col("row_index"), F.lit(16)))
    facts = put("document_facts", cells.sortWithinPartitions("table_id", "column_key", "row_index"))
    registry = fact_ops.registry(found, profiles, facts).join(names.select("document_id", F.col("filename").alias("original_filename")), "document_id", "left")
    registry = put("table_registry", registry.withColumn("created_at", F.current_timestamp()))
    prose = tables.excise(document_text(pages), found).join(names.select("document_id", F.col("filename").alias("source_file")), "document_id")
    made = put("document_chunks", text_chunks(prose.select("document_id", "source_file", "markdown"), embedder).where(F.size("embedding") > 0))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("document_id").agg(F.count("*").cast("int").alias(name))

    docs = names.join(recognised.groupBy("document_id").agg(F.max("error").alias("error_message")), "document_id", "left")
    for df, name in ((pages, "page_count"), (registry, "table_count"), (made, "chunk_count"), (facts, "fact_count")):
        docs = docs.join(count(df, name), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    status = F.when(F.col("error_message").isNull(), "completed").otherwise("failed")
    docs = docs.withColumnRenamed("document_id", "id").withColumns({"status": status, "uploaded_at": F.current_timestamp(), "completed_at": F.when(status == "completed", F.current_timestamp())})
    put("documents", docs)


def ingest_folder(spark: SparkSession, path: str, root: str, **how) -> None:
    """All PDF files below a folder."""
    ingest_batch(upload_files(spark, path), root, **how)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, provider: Callable = markdown_provider, embedder: Callable | None = None) -> StreamingQuery:
    q = file_stream(spark, source).writeStream.foreachBatch(lambda df, _: ingest_batch(df, target, provider, embedder))
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(messages: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Messages a session (session_id, ts): a session ends after ``gap`` without a message."""
    w = messages.withWatermark("ts", gap)
    return w.groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("messages")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "messages")
