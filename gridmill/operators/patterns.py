"""The six query patterns over facts, as DataFrame builders."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 500
LOOKUP_ROWS = 25
_AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


class PatternError(ValueError):
    """Slots that describe no query."""


def _scope(facts: DataFrame, slots: dict) -> DataFrame:
    t = slots.get("table_id")
    if not t or not isinstance(t, str):
        raise PatternError("table_id is required")
    return facts.where(F.col("table_id") == t)


def _label_like(slots: dict) -> Column | None:
    v = slots.get("row_filter")
    return F.col("row_label").ilike(f"%{v}%") if v else None


def _scoped(facts: DataFrame, slots: dict) -> DataFrame:
    d = _scope(facts, slots).where(F.col("column_key") == slots.get("column_key"))
    like = _label_like(slots)
    return d if like is None else d.where(like)


def cell_lookup(facts: DataFrame, slots: dict) -> DataFrame:
    d = _scoped(facts, slots).select("row_index", "row_label", "column_name", "value_text", "value_num", "unit", "page_number")
    return d.orderBy("row_index").limit(LOOKUP_ROWS).drop("row_index")


def scalar_aggregate(facts: DataFrame, slots: dict) -> DataFrame:
    """One row: the number, its unit and how many cells stand behind it. Years are no amounts."""
    agg = str(slots.get("agg", "SUM")).upper()
    if agg not in _AGGREGATES:
        raise PatternError(f"unsupported aggregate {agg!r}")
    d = _scoped(facts, slots).where(F.col("value_type") != "year")
    return d.agg(_AGGREGATES[agg]("value_num").alias("result"), F.min("unit").alias("unit"), F.count_if(F.col("value_num").isNotNull()).alias("parsed_cells"), F.count("*").alias("total_cells"))


def row_filter(facts: DataFrame, slots: dict) -> DataFrame:
    """All cells of the first MAX_ROWS rows whose label matches; a semi-join on the row."""
    like = _label_like(slots)
    if like is None:
        raise PatternError("row_filter is required for row_filter")
    d = _scope(facts, slots)
    rows = d.where(like).select("row_index").distinct().orderBy("row_index").limit(MAX_ROWS)
    d = d.join(F.broadcast(rows), "row_index", "left_semi")  # MAX_ROWS ids
    return d.select("row_index", "col_index", "column_name", "column_key", "value_text", "value_num", "unit", "page_number").orderBy("row_index", "col_index")


def column_series(facts: DataFrame, slots: dict) -> DataFrame:
    d = _scope(facts, slots).where((F.col("column_key") == slots.get("column_key")) & F.col("value_num").isNotNull() & F.col("row_label").isNotNull())
    d = d.groupBy(F.col("row_label").alias("label")).agg(F.max("value_num").alias("value"), F.min("unit").alias("unit"))
    order = {"asc": [F.asc_nulls_last("value"), "label"], "label": [F.asc("label")]}.get(str(slots.get("order", "desc")).lower(), [F.desc_nulls_last("value"), "label"])
    return d.orderBy(*order).limit(MAX_ROWS)


def series_names(keys: list) -> list[str]:
    out = []
    for i, k in enumerate(keys):
        name = re.sub(r"[^a-z0-9_]", "_", str(k).lower()) or f"series_{i}"
        out.append(f"y_{name}" if name[0].isdigit() else name)
    return out


def comparison(facts: DataFrame, slots: dict) -> DataFrame:
    """One column a series, by conditional aggregation: one shuffle, where a pivot takes two."""
    keys = slots.get("column_keys") or []
    if not isinstance(keys, list) or not 1 <= len(keys) <= 5:
        raise PatternError("column_keys must be a list of 1-5 column keys")
    d = _scope(facts, slots).where(F.col("column_key").isin(keys) & F.col("row_label").isNotNull())
    series = [F.max(F.when(F.col("column_key") == k, F.col("value_num"))).alias(n) for k, n in zip(keys, series_names(keys), strict=True)]
    return d.groupBy(F.col("row_label").alias("label")).agg(*series).orderBy("label").limit(MAX_ROWS)


def list_table(facts: DataFrame, slots: dict) -> DataFrame:
    d = _scope(facts, slots).where(F.col("row_index") < MAX_ROWS)
    return d.select("row_index", "col_index", "column_name", "column_key", "row_label", "value_text", "value_num", "unit", "page_number").orderBy("row_index", "col_index")


PATTERNS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {f.__name__: f for f in (cell_lookup, scalar_aggregate, row_filter, column_series, comparison, list_table)}


def needed_keys(slots: dict) -> list[str] | None:
    """The column keys that slots read; None if they read whole rows."""
    if slots["pattern"] in ("row_filter", "list_table"):
        return None
    keys = slots.get("column_keys") if slots["pattern"] == "comparison" else [slots.get("column_key")]
    return [k for k in keys if isinstance(k, str)] if isinstance(keys, list) else []


def render(facts: DataFrame | Callable[[list[str] | None], DataFrame], slots: Any) -> DataFrame:
    """The DataFrame that slots ask for; nothing of the slots becomes SQL text.

    ``facts`` may be a function of the column keys wanted, so a wide table unpivots only those.
    """
    if not isinstance(slots, dict):
        raise PatternError("slots must be an object")
    if slots.get("pattern") not in PATTERNS:
        raise PatternError(f"unknown pattern {slots.get('pattern')!r}")
    return PATTERNS[slots["pattern"]](facts(needed_keys(slots)) if callable(facts) else facts, slots)


def default_slots(question: str, tables: list[dict]) -> dict:
    """Slots by rule, for use without a model: aggregate words, then named columns, else the whole table."""
    if not tables:
        raise PatternError("no tables")
    t, q = tables[0], question.lower()
    keys = [k for k in t.get("column_keys") or [] if re.search(rf"(?<![a-z0-9]){re.escape(k.replace('_', ' '))}(?![a-z0-9])", q.replace("_", " "))]
    label = next((x for x in t.get("sample_labels") or [] if x and x.lower() in q), None)
    words = {"SUM": r"total|sum", "AVG": r"average|mean", "MIN": r"min(imum)?|lowest|smallest", "MAX": r"max(imum)?|highest|largest", "COUNT": r"how many|count"}
    agg = next((a for a, w in words.items() if re.search(rf"\b({w})\b", q)), None)
    base = {"table_id": t["table_id"]}
    if agg and keys:
        return base | {"pattern": "scalar_aggregate", "agg": agg, "column_key": keys[0], "row_filter": label}
    if len(keys) > 1:
        return base | {"pattern": "comparison", "column_keys": keys[:5]}
    if keys and label:
        return base | {"pattern": "cell_lookup", "column_key": keys[0], "row_filter": label}
    if keys:
        return base | {"pattern": "column_series", "column_key": keys[0], "order": "desc"}
    if label:
        return base | {"pattern": "row_filter", "row_filter": label}
    return base | {"pattern": "list_table"}


def pin_table(slots: dict, tables: list[dict]) -> dict:
    """Replace a table id that is in no catalogue by the best candidate's."""
    known = {t["table_id"] for t in tables}
    return slots if slots.get("table_id") in known or not tables else slots | {"table_id": tables[0]["table_id"]}
