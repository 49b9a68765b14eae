"""Sources and sinks: scanned documents, markdown files, chunks, facts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import fill_placeholders

MAX_BYTES = 50 << 20


class Busy(Exception):
    """A provider asks to come back later, after ``seconds`` if given."""

    def __init__(self, seconds: float | None = None):
        super().__init__("busy")
        self.seconds = seconds


def upload_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """PDF files below a folder with their hash: (path, filename, file_hash, content)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return f.where(F.col("length") <= max_bytes).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("file_hash"), "content")


def data_url(content):
    return F.concat(F.lit("data:application/pdf;base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def with_retry(call: Callable, *args, tries: int = 3, wait: float = 3.0, sleep: Callable[[float], None] = time.sleep):
    """Call again after Busy, timeouts and connection errors, waiting twice as long each time; other errors pass."""
    for n in range(tries):
        try:
            return call(*args)
        except (Busy, TimeoutError, ConnectionError) as e:
            if n + 1 == tries:
                raise
            sleep(min(60.0, getattr(e, "seconds", None) or wait * 2**n))


def markdown_provider(content: bytes) -> list[dict]:
    """Offline stand-in for text recognition: the bytes are markdown, pages part at form feeds."""
    return [{"index": i, "markdown": p, "tables": []} for i, p in enumerate(content.decode("utf-8", "replace").split("\f"))]


def recognise(files: DataFrame, provider: Callable[[bytes], list[dict]] = markdown_provider, errors: bool = False) -> DataFrame:
    """Pages (document_id, number, markdown) of files; blank pages go, table links are filled.

    A failure that outlasts the retries fails the job; with ``errors`` it becomes a row
    with the message in ``error`` and the other files go on.
    """
    schema = "document_id string, number int, markdown string, tables array<struct<id:string,content:string>>, error string"

    def pages_of(name: str, content: bytes):
        try:
            for i, p in enumerate(with_retry(provider, content)):
                yield name, (i if p.get("index") is None else p["index"]) + 1, p.get("markdown") or "", p.get("tables") or [], None
        except Exception as e:
            if not errors:
                raise
            yield name, 0, "", [], str(e)[:500] or type(e).__name__

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for name, content in zip(pdf["file_hash"], pdf["content"], strict=True) for r in pages_of(name, bytes(content))]
            yield pd.DataFrame(rows, columns=["document_id", "number", "markdown", "tables", "error"])

    pages = files.select("file_hash", "content").mapInPandas(run, schema)
    pages = pages.select("document_id", "number", fill_placeholders(F.col("markdown"), F.col("tables")).alias("markdown"), "error")
    pages = pages.where((F.trim("markdown") != "") | F.col("error").isNotNull())
    return pages if errors else pages.drop("error")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts by table, sorted for pruning by column. Of an older write only tables that come in again are replaced."""
    rows = facts.repartition("table_id", F.pmod(F.col("row_index"), F.lit(16))).sortWithinPartitions("table_id", "column_key", "row_index")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_id").parquet(path)
