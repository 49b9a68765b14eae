"""Chunking of prose and its headings, ids and upserts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS = 512
OVERLAP = 0.1
#: Separators from coarse to fine; the last resort is single characters.
SEPARATORS = (r"\n{2,}", r"\n", r"\t+", r"\s{2,}", r"(?<=[.!?])\s+", r"(?<=[;,:])\s+", r"\s+")


def count_words(text: str) -> int:
    return len(text.split())


def _pieces(text: str, start: int, limit: int, count: Callable[[str], int], level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` tokens, cut at the coarsest separators that suffice."""
    body = text.strip()
    if not body:
        return []
    lead = len(text) - len(text.lstrip())
    if count(text) <= limit:
        return [(start + lead, start + lead + len(body))]
    if level >= len(SEPARATORS):
        step = max(1, len(text) * limit // max(1, count(text)))
        return [(start + i, start + min(i + step, len(text))) for i in range(0, len(text), step)]
    cuts, at = [], 0
    for m in re.finditer(SEPARATORS[level], text):
        if m.end() < len(text):
            cuts.append((at, m.start()))
            at = m.end()
    if not cuts:
        return _pieces(text, start, limit, count, level + 1)
    cuts.append((at, len(text)))
    return [s for a, b in cuts for s in _pieces(text[a:b], start + a, limit, count, level + 1)]


def split_text(text: str, size: int = CHUNK_TOKENS, overlap: float = OVERLAP, count: Callable[[str], int] = count_words) -> list[tuple[int, int, str]]:
    """Chunks (start, end, content): adjacent pieces merged up to the token budget, with overlap by whole pieces."""
    spans = _pieces(text or "", 0, max(1, int(size * (1 - overlap))), count)
    out, i = [], 0
    while i < len(spans):
        j, total = i, 0
        while j < len(spans) and (j == i or total + count(text[spans[j][0] : spans[j][1]]) <= size):
            total += count(text[spans[j][0] : spans[j][1]])
            j += 1
        out.append((spans[i][0], spans[j - 1][1], text[spans[i][0] : spans[j - 1][1]]))
        if j >= len(spans):
            break
        back, kept = j, 0
        while back - 1 > i and kept + count(text[spans[back - 1][0] : spans[back - 1][1]]) <= size * overlap:
            back -= 1
            kept += count(text[spans[back][0] : spans[back][1]])
        i = back
    return out


def chunk_documents(docs: DataFrame, text: str = "text", size: int = CHUNK_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """One row a chunk: chunk_id, start_offset, end_offset, content beside the other columns."""
    kind = "array<struct<chunk_id:int,start_offset:int,end_offset:int,content:string>>"

    @F.pandas_udf(kind)
    def cut(col: pd.Series) -> pd.Series:
        return col.map(lambda t: [{"chunk_id": i, "start_offset": a, "end_offset": b, "content": c} for i, (a, b, c) in enumerate(split_text(t or "", size, overlap))])

    return docs.withColumn("_c", cut(F.col(text))).select(*docs.columns, F.inline("_c"))


def heading_context(text: Column, offset: Column) -> Column:
    """Titles of the headings in force before ``offset``, outermost first, joined by ' > '.

    A fold over the headings before the offset: a heading sets its level and clears
    deeper ones.
    """
    before = F.substring(text, F.lit(1), offset)
    found = F.regexp_extract_all(before, F.lit(r"(?m)^#{1,4}\s+.+$"), 0)
    levels = F.array(*[F.lit(None).cast("string") for _ in range(4)])

    def step(acc, h):
        level = F.length(F.regexp_extract(h, "^(#+)", 1))
        title = F.trim(F.regexp_replace(h, r"^#+\s+", ""))
        return F.transform(acc, lambda x, i: F.when(i + 1 < level, x).when(i + 1 == level, title))

    folded = F.aggregate(found, levels, step)
    return F.array_join(F.filter(folded, lambda x: x.isNotNull() & (x != "")), " > ")


def section(context: Column) -> Column:
    return F.nullif(F.get(F.split(context, " > "), F.lit(0)), F.lit(""))


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    """First 32 hex digits of a hash over source, position and the content's head."""
    return F.left(F.sha2(F.concat_ws(":", source, index.cast("string"), F.left(content, F.lit(500))), 256), F.lit(32))


def embed_text(context: Column, content: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), content)).otherwise(content)


def chunk_files(files: DataFrame, size: int = CHUNK_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """Chunks of markdown files (source_file, text) as they stand alone, with headings, section and id."""
    cut = chunk_documents(files, "text", size, overlap)
    context = heading_context(F.col("text"), F.col("start_offset"))
    cut = cut.withColumn("heading_context", context).drop("text")
    return cut.withColumns({"section": section(F.col("heading_context")), "id": chunk_id(F.col("source_file"), F.col("chunk_id"), F.col("content"))})


def upsert_chunks(current: DataFrame, chunks: DataFrame) -> DataFrame:
    """Replace all chunks of the documents that come in; chunks without a vector are left out."""
    new = chunks.where(F.size("embedding") > 0)
    return current.join(chunks.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)
