"""Catalogue search and the life of documents."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATES = 3
SAMPLE_LABELS = 5


# Full text --------------------------------------------------------------------

@cache
def stop_words() -> frozenset[str]:
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def _measure(stem: str) -> int:
    return len(re.findall(r"[aeiouy]+[^aeiouy]+", _forms(stem)))


def _forms(w: str) -> str:
    """Letters with y turned to a consonant mark where it is one."""
    return "".join("j" if c == "y" and (i == 0 or w[i - 1] in "aeiou") else c for i, c in enumerate(w))


def _has_vowel(stem: str) -> bool:
    return bool(re.search(r"[aeiouy]", _forms(stem)))


def _short(stem: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxj]$", _forms(stem)))


# Suffixes of steps 2 to 4 of the published Porter algorithm.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def stem(w: str) -> str:
    """Porter's stemmer (1980)."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def query_lexemes(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return sorted({stem(w) for w in words if w not in stop_words()})


def words_of(*parts: Column) -> Column:
    """Distinct lower-cased words of the parts, unstemmed."""
    text = F.lower(F.concat_ws(" ", *parts))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0))


def lexemes(words: Column) -> Column:
    """Stems of an array of words without stop words."""
    stops = stop_words()  # loaded on the driver

    @F.pandas_udf("array<string>")
    def stems(col: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in memo:
                memo[w] = stem(w)
            return memo[w]

        return col.map(lambda ws: sorted({one(w) for w in ws if w not in stops}) if ws is not None else None)

    return stems(words)


def with_fts(facts: DataFrame) -> DataFrame:
    """Add the stemmed lexemes of label, column name and value."""
    return facts.withColumn("fts", lexemes(words_of(F.col("row_label"), F.col("column_name"), F.col("value_text"))))


def matches(fts: Column, terms: list[str]) -> Column:
    """All terms occur; no terms match nothing."""
    return F.lit(False) if not terms else F.size(F.array_intersect(fts, F.array(*[F.lit(t) for t in terms]))) == len(terms)


def candidates(registry: DataFrame, facts: DataFrame, terms: list[str], document_ids: list[str] | None = None, limit: int = CANDIDATES) -> DataFrame:
    """Tables by the number of matching facts, then newest, at most ``limit``."""
    hits = facts.where(matches(F.col("fts"), terms)).groupBy("table_id").agg(F.count("*").alias("hits"))
    r = registry if document_ids is None else registry.where(F.col("document_id").isin(document_ids))
    return r.join(hits, "table_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).orderBy(F.desc("hits"), F.desc_nulls_last("created_at"), "table_id").limit(limit)


def sample_labels(facts: DataFrame, n: int = SAMPLE_LABELS) -> DataFrame:
    """The first labels of every table in one pass: (table_id, sample_labels)."""
    labels = facts.where(F.col("row_label").isNotNull()).select("table_id", "row_label").distinct()
    rank = F.row_number().over(W.partitionBy("table_id").orderBy("row_label"))
    return labels.withColumn("_r", rank).where(F.col("_r") <= n).groupBy("table_id").agg(F.array_sort(F.collect_list("row_label")).alias("sample_labels"))


def render_catalog(tables: list[dict]) -> str:
    """The catalogue for a prompt: a line a table with its id, origin, columns and some row labels."""
    def line(t: dict) -> str:
        pages = sorted({p for p in (t.get("page_start"), t.get("page_end")) if p})
        origin = [t.get("original_filename"), "p. " + "-".join(map(str, pages)) if pages else None, f"{t.get('row_count') or 0} rows"]
        facets = {"columns": t.get("column_keys"), "labels": t.get("sample_labels")}
        shown = [f"{name} {', '.join(values)}" for name, values in facets.items() if values]
        return f"[{t['table_id']}] " + "; ".join([t.get("semantic_description") or "no description", *filter(None, origin), *shown])

    return "\n".join(map(line, tables)) or "The catalogue is empty."


def table_list(registry: DataFrame, document_ids: list[str] | None = None) -> DataFrame:
    r = registry if document_ids is None else registry.where(F.col("document_id").isin(document_ids))
    return r.select("table_id", "document_id", "table_index")


def list_tables(registry: DataFrame, document_id: str | None = None) -> DataFrame:
    """Registry rows, newest first, with a display name and defaults for missing values."""
    r = registry if document_id is None else registry.where(F.col("document_id") == document_id)
    name = F.concat(F.lit("tbl_"), F.left(F.col("document_id").cast("string"), F.lit(8)), F.lit("_t"), F.col("table_index").cast("string"))
    return r.select("table_id", "document_id", name.alias("table_name"), "original_filename", F.coalesce("semantic_description", F.lit("")).alias("description"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "created_at").orderBy(F.desc_nulls_last("created_at"), "table_id")


# Documents ----------------------------------------------------------------------

def list_documents(documents: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): newest first, with the number of all matching documents."""
    d = documents if status is None else documents.where(F.col("status") == status)
    return d.orderBy(F.desc_nulls_last("uploaded_at"), "id").offset(offset).limit(limit), d.agg(F.count("*").alias("total"))


def get_document(documents: DataFrame, document_id) -> DataFrame:
    return documents.where(F.col("id") == document_id)


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def register(documents: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """Incoming files (id, file_hash, ...) with ``action``: insert, retry (failed before) or skip; with ``force`` replace instead.

    Of files with one hash in a batch the one with the least id counts.
    """
    first = incoming.groupBy("file_hash").agg(F.min("id").alias("_first"))
    known = documents.groupBy("file_hash").agg(F.max(F.when(F.col("status") != "failed", 1).otherwise(0)).alias("_alive"))
    j = incoming.join(first, "file_hash").join(known, "file_hash", "left")
    action = F.when(F.col("id") != F.col("_first"), "skip").when(F.col("_alive").isNull(), "insert").when(F.col("_alive") == 0, "retry").otherwise("replace" if force else "skip")
    return j.withColumn("action", action).drop("_first", "_alive")


def set_status(documents: DataFrame, document_id, status: str, now: Column | None = None, **values) -> DataFrame:
    """Documents with one row's status and other columns changed; completion is stamped."""
    hit = F.col("id") == document_id
    new = {"status": F.lit(status), **{k: F.lit(v) for k, v in values.items()}}
    if status == "completed":
        new["completed_at"] = now if now is not None else F.current_timestamp()
    return documents.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})


def force_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents in ``ids`` (document_id)."""
    return {n: d.join(ids.select(F.col("document_id").alias("id" if n == "documents" else "document_id")), "id" if n == "documents" else "document_id", "left_anti") for n, d in tables.items()}


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``current`` not in ``incoming`` by ``key``, then all of ``incoming``."""
    return current.join(incoming.select(*key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def reset(spark, prefix: str = "") -> None:
    """Empty the four tables."""
    for name in ("document_chunks", "document_facts", "table_registry", "documents"):
        if spark.catalog.tableExists(f"{prefix}{name}"):
            spark.sql(f"TRUNCATE TABLE {prefix}{name}")


def health(spark) -> dict:
    return {"status": "ok" if spark.sql("SELECT 1 AS one").first().one == 1 else "error"}
