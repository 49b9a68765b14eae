"""Helpers shared by the corpus operators: shared storage, lineage cuts, small maths.

Intermediate tables and binary files go below ``spark.checkpoint.dir``, the one
folder the driver and all executors share. Where it is unset a local master gets a
temporary folder of its own; a cluster gets an error, since its executors would write
to disks that no other machine sees.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of one Arrow batch handed to Python; they bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20
#: Most partitions of a work list.
MOST_TASKS = 50_000
#: A key with more than one in SHARES of a join's rows is dealt to several tasks.
SHARES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the bounds on this session's Arrow batches to what the operators plan for; never raise them."""
    conf = "spark.sql.execution.arrow."
    if not 0 < int(spark.conf.get(conf + "maxRecordsPerBatch")) <= rows:
        spark.conf.set(conf + "maxRecordsPerBatch", str(rows))
    now = spark.conf.get(conf + "maxBytesPerBatch").lower().rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(conf + "maxBytesPerBatch", f"{BATCH_BYTES}b")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete, at the end of the block, the shared folders made inside it.

    Yields a function that writes a result to a folder which stays; a block must pass
    whatever it returns through it, since plans read their inputs late.
    """
    outer, inner = _made.get(), []
    token = _made.set(inner)

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        path = inner.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _made.reset(token)
        conf = spark._jsc.hadoopConfiguration()
        for name in inner:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder, as a URI or path."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_dir(spark)
    made = _made.get()
    path = posixpath.join(root, f"gridmill-{uuid.uuid4().hex}")
    if made is not None:
        made.append(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="gridmill-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and reread it.

    A lost executor then costs a reread of that table, never a recomputation of
    the plan above it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI or absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file so that a retried task replaces it in one step."""
    fs, path = filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def get_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give each row of a work list, of distinct keys, a partition of its own, or neighbours one if they are many."""
    return df.repartitionByRange(max(1, min(df.count(), MOST_TASKS)), *keys)


def parts_of(total: int):
    """Into how many parts a key with ``_n`` of ``total`` rows is cut; more than one for a few times SHARES keys at most."""
    share = max(1, total // SHARES)
    return F.when(F.col("_n") > share, F.ceil(F.col("_n") / share)).otherwise(1).cast("int")


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], total: int, by: str) -> DataFrame:
    """``rows`` joined to ``side``, no task with more than about one in SHARES of ``total`` rows of a key.

    ``side`` has one row a key, columns without nulls, and in ``_n`` the key's rows. A key
    with more than its share is cut into parts by ``by``, its row of ``side`` repeated for
    each. Such keys are broadcast: there are at most a few times SHARES, whatever the size.
    """
    parts = parts_of(total)
    hot = parts > 1
    for c in side.columns:  # reads every column, so that both uses of ``side`` share one shuffle
        hot = hot & F.col(c).isNotNull()
    dealt = rows.join(F.broadcast(side.where(hot).select(*keys, parts.alias("_parts"))), keys, "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    side = side.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    return dealt.join(side, [*keys, "_part"]).drop("_part")


def batches(rows: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """Map each batch to columns by ``make(batch)`` and type them by ``schema``."""
    for b in rows:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(make(b), schema, strict=True)], schema=schema)


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
