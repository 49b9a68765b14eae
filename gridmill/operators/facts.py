"""From tables to facts: one row a cell, typed by cell and reconciled by column."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import YEAR, european_sign, header_unit_scale, parse_cells, sanitize_keys, strip
from ..schema import FACT_COLUMNS, NUMBER

AGREEMENT = 0.70
EUROPEAN = 0.60
LABEL_DISTINCT = 0.90
TABLE_CAP = 200_000


def table_ids(tables: DataFrame) -> DataFrame:
    """Add a content-free, repeatable table_id from document and position."""
    return tables.withColumn("table_id", F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.col("table_index").cast("string")), 256))


def cells(tables: DataFrame) -> DataFrame:
    """One row a cell of tables (document_id, table_id, table_index, headers, rows, row_pages, page_start)."""
    t = tables.withColumn("_k", sanitize_keys(F.col("headers")))
    r = t.select("document_id", "table_id", "table_index", "headers", "_k", "row_pages", "page_start", F.posexplode("rows").alias("row_index", "_row"))
    page = F.when(F.size("row_pages") > F.col("row_index"), F.nullif(F.get("row_pages", F.col("row_index")), F.lit(0))).otherwise(F.col("page_start"))
    r = r.withColumn("page_number", page)
    c = r.select("*", F.posexplode(F.slice("_row", 1, F.size("headers"))).alias("col_index", "raw"))
    return c.select("document_id", "table_id", "table_index", "row_index", "col_index", "page_number", F.get("headers", F.col("col_index")).alias("column_name"), F.get("_k", F.col("col_index")).alias("column_key"), "raw", (F.size("_row") < F.size("headers")).alias("ragged"))


def profiles(typed: DataFrame) -> DataFrame:
    """One row a column of cells with ``cell``: type by vote, unit, scale, coverage, label flag."""
    kind, key = F.col("cell.value_type"), ["table_id", "col_index"]
    known = kind != "empty"
    votes = typed.groupBy(*key, kind.alias("kind")).agg(
        F.count("*").alias("n"), F.min("row_index").alias("first"), F.count_if(F.col("cell.value_num").isNotNull()).alias("numeric"),
        F.min(F.when(known & (F.col("cell.unit") != ""), F.struct("row_index", "cell.unit"))).alias("unit"),
        F.any_value("column_name").alias("column_name"), F.any_value("column_key").alias("column_key"),
    )
    real = F.col("kind") != "empty"
    cols = votes.groupBy(*key).agg(
        F.max(F.when(real, F.struct("n", (-F.col("first")).alias("f"), "kind"))).alias("best"),
        F.sum(F.when(real, F.col("n"))).alias("non_empty"), F.sum("n").alias("cells"), F.sum("numeric").alias("numeric"),
        F.min("unit")["unit"].alias("cell_unit"), F.any_value("column_name").alias("name"), F.any_value("column_key").alias("key"),
    )
    text = strip(F.coalesce(F.col("raw"), F.lit("")))
    distinct = typed.groupBy(*key).agg(F.count_distinct(F.when(text != "", text)).alias("distinct"))
    cols = cols.join(distinct, key)
    cols = cols.withColumn("_h", header_unit_scale(F.col("name"))).withColumns({
        "type": F.when(F.col("best").isNull(), "text").when(F.col("best.n") / F.col("non_empty") >= AGREEMENT, F.col("best.kind")).otherwise("text"),
        "unit": F.coalesce("cell_unit", F.col("_h.unit")), "scale": F.col("_h.scale"), "numeric_coverage": F.col("numeric") / F.col("cells"),
    })
    rows = typed.groupBy("table_id").agg((F.max("row_index") + 1).alias("rows"))
    cols = cols.join(rows, "table_id")
    w = W.partitionBy("table_id")
    label = F.coalesce(F.min(F.when((F.col("type") == "text") & (F.col("distinct") >= LABEL_DISTINCT * F.col("rows")), F.col("col_index"))).over(w), F.lit(0))
    return cols.withColumn("is_label", F.col("col_index") == label).select(*key, "name", "key", "type", "unit", "scale", "numeric_coverage", "distinct", "is_label", "rows")


def european_columns(cell_rows: DataFrame) -> DataFrame:
    """(table_id, col_index, european): whether most telling cells use a decimal comma."""
    sign = european_sign(F.col("raw"))
    return cell_rows.groupBy("table_id", "col_index").agg(F.coalesce(F.avg(sign) >= EUROPEAN, F.lit(False)).alias("european"))


def reconcile(typed: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells after their column's decisions, as facts without labels."""
    j = typed.join(cols.select("table_id", "col_index", F.col("type").alias("_type"), F.col("unit").alias("_unit"), F.col("scale").alias("_scale"), "is_label"), ["table_id", "col_index"])
    c = F.col
    clear = (c("_type") == "text") & c("cell.value_type").isin("number", "date", "year")
    inherits = ~clear & c("cell.value_type").isin("number", "year")
    scales = inherits & c("cell.scale_factor").isNull() & c("_scale").isNotNull() & c("cell.value_num").isNotNull()
    note = F.when(clear, F.coalesce(c("cell.parse_note"), F.lit("column_is_text"))).otherwise(c("cell.parse_note"))
    return j.select(
        "document_id", "table_id", "table_index", "row_index", "col_index", "page_number", "column_name", "column_key", "is_label",
        c("cell.value_text").alias("value_text"),
        F.when(clear, None).when(scales, (c("cell.value_num") * c("_scale").cast("decimal(17,4)")).cast(NUMBER)).otherwise(c("cell.value_num")).alias("value_num"),
        F.when(~clear, c("cell.value_date")).alias("value_date"),
        F.when(clear, None).when(inherits, F.coalesce(c("cell.unit"), c("_unit"))).otherwise(c("cell.unit")).alias("unit"),
        F.when(clear, None).when(scales, c("_scale")).otherwise(c("cell.scale_factor")).cast(NUMBER).alias("scale_factor"),
        F.when(clear, "text").otherwise(c("cell.value_type")).alias("value_type"),
        F.when(c("ragged"), F.concat_ws("; ", note, F.lit("ragged_row"))).otherwise(note).alias("parse_note"),
    )


def label_rows(facts: DataFrame) -> DataFrame:
    """Copy each row's label cell onto all its cells, at most TABLE_CAP facts a table.

    The label meets its row by a window over the row alone, so a large table spreads
    over many tasks.
    """
    w = W.partitionBy("table_id", "row_index")
    label = F.max(F.when(F.col("is_label"), F.col("value_text"))).over(w)
    return facts.withColumn("row_label", F.nullif(label, F.lit(""))).select(*FACT_COLUMNS)


#: Rows of a range in which a table's cut is looked for.
CAP_RANGE = 4096


def cap_cuts(facts: DataFrame, cap: int = TABLE_CAP) -> DataFrame:
    """(table_id, facts, kept, cut): tables of more than ``cap`` facts, what a cut at whole rows keeps and the first row it drops.

    Sums of row ranges find the range in which the cap falls, then only that range's rows
    are summed one by one, so no task ranks a whole table's rows.
    """
    at = F.floor(F.col("row_index") / CAP_RANGE).alias("range")
    ranges = facts.groupBy("table_id", at).agg(F.count("*").alias("n"))
    large = ranges.groupBy("table_id").agg(F.sum("n").alias("facts")).where(F.col("facts") > cap)
    running = ranges.join(large, "table_id").withColumn("run", F.sum("n").over(W.partitionBy("table_id").orderBy("range")))
    crossed = running.where((F.col("run") > cap) & (F.col("run") - F.col("n") <= cap)).select("table_id", "range", "facts", (F.col("run") - F.col("n")).alias("before"))
    widths = facts.groupBy("table_id", "row_index").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("row_index") / CAP_RANGE))
    inside = widths.join(crossed, ["table_id", "range"])
    inside = inside.withColumn("run", F.col("before") + F.sum("n").over(W.partitionBy("table_id").orderBy("row_index")))
    kept = F.coalesce(F.max(F.when(F.col("run") <= cap, F.col("run"))), F.max("before"))
    return inside.groupBy("table_id").agg(F.max("facts").alias("facts"), kept.alias("kept"), F.min(F.when(F.col("run") > cap, F.col("row_index"))).alias("cut"))


def cap_facts(facts: DataFrame, cap: int = TABLE_CAP) -> DataFrame:
    """Whole rows of each table up to ``cap`` facts; ``cap_cuts`` tells what that leaves out."""
    cuts = cap_cuts(facts, cap).select("table_id", "cut")
    return facts.join(cuts, "table_id", "left").where(F.col("cut").isNull() | (F.col("row_index") < F.col("cut"))).drop("cut")


def ingest_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, profiles) of extracted tables with a table_id."""
    raw = cells(tables)
    typed = parse_cells(raw.join(european_columns(raw), ["table_id", "col_index"]), european="european")
    cols = profiles(typed)
    return label_rows(reconcile(typed, cols)), cols


def registry(tables: DataFrame, cols: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a table with its headers, keys and column profiles."""
    prof = cols.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("col_index", "key", "name", "type", "unit", F.col("scale").cast("string").alias("scale"), F.round("numeric_coverage", 3).alias("numeric_coverage"), "distinct", "is_label"))).alias("_p"),
        F.max(F.when(F.col("is_label"), F.col("key"))).alias("label_column_key"),
    )
    counts = facts.groupBy("table_id").agg(F.count("*").cast("int").alias("fact_count"))
    strip_index = F.transform("_p", lambda p: F.struct(p["key"], p["name"], p["type"], p["unit"], p["scale"], p["numeric_coverage"], p["distinct"], p["is_label"]))
    return tables.join(prof, "table_id", "left").join(counts, "table_id", "left").select(
        "table_id", "document_id", "table_index", "headers", sanitize_keys(F.col("headers")).alias("column_keys"), strip_index.alias("column_profiles"), "label_column_key",
        F.size("rows").alias("row_count"), F.coalesce("fact_count", F.lit(0)).alias("fact_count"), "page_start", "page_end", describe(F.col("headers")).alias("semantic_description"),
    )


def describe(headers):
    """The description that needs no model: the headers, at most 100 characters."""
    return F.left(F.concat(F.lit("Table with columns: "), F.array_join(headers, ", ")), F.lit(100))


def melt(df: DataFrame, table_id: str, label: str, values: list[str], row_order: str, keys: list[str] | None = None) -> DataFrame:
    """Facts of a wide table whose rows are already typed, of the columns named by ``keys`` only, if given.

    row_index is the value of ``row_order``, any unique number, so no row needs to know
    its rank. Columns unpivot by a generator of column numbers, without a shuffle; the
    cells are expressions above it, so those that nobody asks for are never made.
    """
    wanted = [i for i, c in enumerate(values) if keys is None or _key(c) in keys]
    kinds = dict(df.dtypes)
    numeric = {c: kinds[c] in ("int", "bigint", "double", "float", "smallint") or kinds[c].startswith("decimal") for c in values}
    one = F.lit(wanted[0]) if len(wanted) == 1 else F.explode(F.array(*[F.lit(i) for i in wanted]) if wanted else F.array().cast("array<int>"))
    d = df.select(F.col(label).alias("_label"), F.col(row_order).cast("long").alias("row_index"), *[F.col(values[i]).alias(f"_v{i}") for i in wanted], one.alias("col_index"))

    def cell(value, kind: str):
        return F.coalesce(*[F.when(F.col("col_index") == i, value(i, values[i])) for i in wanted], F.lit(None).cast(kind)) if len(wanted) != 1 else value(wanted[0], values[wanted[0]])

    return d.select(
        F.lit(table_id).alias("table_id"), "row_index", F.col("_label").alias("row_label"), "col_index", cell(lambda i, c: F.lit(c), "string").alias("column_name"), cell(lambda i, c: F.lit(_key(c)), "string").alias("column_key"),
        cell(lambda i, c: F.col(f"_v{i}").cast("string"), "string").alias("value_text"), cell(lambda i, c: (F.col(f"_v{i}") if numeric[c] else F.lit(None)).cast(NUMBER), NUMBER).alias("value_num"),
        cell(lambda i, c: F.when(F.col(f"_v{i}").isNull(), "empty").otherwise("number" if numeric[c] else "text"), "string").alias("value_type"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("page_number"),
    )


def _key(name: str) -> str:
    """``sanitize_key`` of one name, on the driver."""
    key = re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"
    return f"c_{key}" if key[0].isdigit() and not re.fullmatch(YEAR, key) else key
