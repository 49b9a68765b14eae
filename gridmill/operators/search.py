"""Embeddings and cosine search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIMENSIONS = 256
MAX_CHARS = 12_000
LIMIT, THRESHOLD, RETRY_LIMIT = 5, 0.5, 3


def hashed_embedding(text: str, dim: int = DIMENSIONS) -> list[float]:
    """Offline stand-in for a model: signed hashes of words and word pairs, of unit length."""
    words = re.findall(r"\w+", (text or "")[:MAX_CHARS].lower())
    v = np.zeros(dim)
    for g in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else []


def embed(df: DataFrame, text: str, out: str = "embedding", provider: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 32) -> DataFrame:
    """Add vectors from ``provider`` in batches; a batch that fails gets empty vectors."""
    call = provider or (lambda texts: [hashed_embedding(t) for t in texts])

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts, got = [(t or "")[:MAX_CHARS] for t in s], []
            for i in range(0, len(texts), batch):
                try:
                    got += call(texts[i : i + batch])
                except Exception:  # a provider's failure costs its batch only
                    got += [[]] * len(texts[i : i + batch])
            yield pd.Series(got)

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))  # never moved or run twice: a provider may cost


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a literal query, in generated double arithmetic."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm * F.lit(float(np.linalg.norm(query))), F.lit(0.0))


def vector_search(chunks: DataFrame, query: list[float], limit: int = LIMIT, threshold: float | None = None, where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``limit`` most similar rows with ``score``; a top-k per task, then one merge."""
    d = chunks if where is None else chunks.where(where)
    d = d.withColumn("score", cosine(F.col(vector), query)).where(F.col("score").isNotNull())
    if threshold is not None:
        d = d.where(F.col("score") >= threshold)
    return d.orderBy(F.desc("score"), id_col).limit(limit)


def search_with_retry(chunks: DataFrame, query: list[float], where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Top LIMIT at THRESHOLD or more; if there are none, the top RETRY_LIMIT of any score. One scan."""
    top = vector_search(chunks, query, LIMIT, None, where, id_col, vector)
    rank = F.row_number().over(W.orderBy(F.desc("score"), id_col))  # over at most LIMIT rows
    ranked = top.withColumns({"_r": rank, "_best": F.max("score").over(W.partitionBy())})
    keep = F.when(F.col("_best") >= THRESHOLD, F.col("score") >= THRESHOLD).otherwise(F.col("_r") <= RETRY_LIMIT)
    return ranked.where(keep).drop("_r", "_best")


def snippet(content: Column) -> Column:
    return F.when(F.length(content) > 200, F.concat(F.left(content, F.lit(200)), F.lit("..."))).otherwise(content)


def build_context(results: list[dict]) -> str:
    """Passages for a prompt, numbered as an answer may cite them, each under its headings."""
    def passage(n: int, r: dict) -> str:
        return f"({n}) {r.get('heading_context') or 'no heading'}:\n{r['content'].strip()}"

    return "\n\n".join(passage(n, r) for n, r in enumerate(results, start=1)) or "Nothing was found."
