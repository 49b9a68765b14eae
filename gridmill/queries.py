"""Registered queries over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.cells import header_unit_scale, parse_cells, sanitize_key, sanitize_keys
from .operators import catalog, chunks, facts, patterns, search, shape, tables
from .plans import route, validate
from .streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Facts of wide tables -------------------------------------------------------------

def customer_facts(spark, sf, keys=None) -> DataFrame:
    return facts.melt(_t(spark, sf, "customer"), "customer", "c_name", ["c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey", keys)


def lineitem_facts(spark, sf, keys=None) -> DataFrame:
    d = _t(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return facts.melt(d, "lineitem", "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "row", keys)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in cols})


@query("SELECT c_name AS row_label, 'c_acctbal' AS column_name, round(c_acctbal, 2) AS value_num, CAST(NULL AS VARCHAR) AS unit FROM customer WHERE c_name ILIKE '%000000012%' ORDER BY c_custkey LIMIT 25")
def cell_lookup(spark, sf):
    d = patterns.render(partial(customer_facts, spark, sf), {"pattern": "cell_lookup", "table_id": "customer", "column_key": "c_acctbal", "row_filter": "000000012"})
    return _rounded(d.select("row_label", "column_name", "value_num", "unit"), "value_num")


def _aggregate(agg: str, column: str, table: str):
    def run(spark, sf):
        f = partial(lineitem_facts if table == "lineitem" else customer_facts, spark, sf)
        return _rounded(patterns.render(f, {"pattern": "scalar_aggregate", "table_id": table, "agg": agg, "column_key": column}), "result")

    return run


for _agg, _col, _table in (("SUM", "l_extendedprice", "lineitem"), ("AVG", "l_quantity", "lineitem"), ("MIN", "c_acctbal", "customer"), ("MAX", "c_acctbal", "customer"), ("COUNT", "c_mktsegment", "customer")):
    _name = f"scalar_aggregate_{_agg.lower()}"
    QUERIES[_name] = _aggregate(_agg, _col, _table)
    _value = f"{_agg}({_col})" if _agg != "COUNT" else "0"
    ORACLE_SQL[_name] = f"SELECT round(CAST({_value} AS DOUBLE), 2) AS result, CAST(NULL AS VARCHAR) AS unit, {'0::BIGINT' if _agg == 'COUNT' else f'count({_col})'} AS parsed_cells, count(*) AS total_cells FROM {_table}"


@query("SELECT round(sum(c_acctbal), 2) AS result, CAST(NULL AS VARCHAR) AS unit, count(c_acctbal) AS parsed_cells, count(*) AS total_cells FROM customer WHERE c_name ILIKE '%9%'")
def scalar_aggregate_filtered(spark, sf):
    return _rounded(patterns.render(partial(customer_facts, spark, sf), {"pattern": "scalar_aggregate", "table_id": "customer", "agg": "SUM", "column_key": "c_acctbal", "row_filter": "9"}), "result")


@query("SELECT round(sum(o_totalprice), 2) AS result, CAST(NULL AS VARCHAR) AS unit, count(*) AS parsed_cells, count(*) AS total_cells FROM orders WHERE NOT (o_totalprice = floor(o_totalprice) AND o_totalprice BETWEEN 1900 AND 2099)")
def scalar_year_exclusion(spark, sf):
    d = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"), F.regexp_replace(F.format_number("o_totalprice", 2), r",|\.00$", "").alias("raw"))
    d = parse_cells(d).select(F.lit("orders").alias("table_id"), F.col("label").alias("row_label"), F.lit("price").alias("column_key"), "cell.value_num", "cell.unit", "cell.value_type")
    return _rounded(patterns.render(d, {"pattern": "scalar_aggregate", "table_id": "orders", "agg": "SUM", "column_key": "price"}), "result")


@query("""
WITH m AS (SELECT p_partkey FROM part WHERE p_name ILIKE '%widget%' ORDER BY p_partkey LIMIT 500)
SELECT CAST(p_partkey AS BIGINT) AS row_index, col_index, column_key, round(value_num, 2) AS value_num FROM (
  SELECT p_partkey, 0 AS col_index, 'p_brand' AS column_key, CAST(NULL AS DOUBLE) AS value_num FROM part
  UNION ALL SELECT p_partkey, 1, 'p_size', CAST(p_size AS DOUBLE) FROM part
  UNION ALL SELECT p_partkey, 2, 'p_retailprice', p_retailprice FROM part)
WHERE p_partkey IN (SELECT p_partkey FROM m)""")
def row_filter(spark, sf):
    f = facts.melt(_t(spark, sf, "part"), "part", "p_name", ["p_brand", "p_size", "p_retailprice"], "p_partkey")
    d = patterns.render(f, {"pattern": "row_filter", "table_id": "part", "row_filter": "widget"})
    return _rounded(d.select("row_index", "col_index", "column_key", "value_num"), "value_num")


def _series(order: str, sql_order: str):
    def run(spark, sf):
        return _rounded(patterns.render(partial(customer_facts, spark, sf), {"pattern": "column_series", "table_id": "customer", "column_key": "c_acctbal", "order": order}), "value")

    QUERIES[f"column_series_{order}"] = run
    ORACLE_SQL[f"column_series_{order}"] = f"SELECT c_name AS label, round(max(c_acctbal), 2) AS value, CAST(NULL AS VARCHAR) AS unit FROM customer WHERE c_acctbal IS NOT NULL GROUP BY c_name ORDER BY {sql_order} LIMIT 500"


for _o, _s in (("desc", "max(c_acctbal) DESC, label"), ("asc", "max(c_acctbal), label"), ("label", "label")):
    _series(_o, _s)


@query("SELECT l_returnflag AS label, round(max(l_quantity), 2) AS l_quantity, round(max(l_extendedprice), 2) AS l_extendedprice, round(max(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 500")
def comparison(spark, sf):
    d = patterns.render(partial(lineitem_facts, spark, sf), {"pattern": "comparison", "table_id": "lineitem", "column_keys": ["l_quantity", "l_extendedprice", "l_tax"]})
    return _rounded(d, "l_quantity", "l_extendedprice", "l_tax")


def _nation_facts(spark, sf):
    return facts.melt(_t(spark, sf, "nation"), "nation", "n_name", ["n_name", "n_regionkey"], "n_nationkey")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS row_index, 0 AS col_index, 'n_name' AS column_key, n_name AS row_label, n_name AS value_text FROM nation
UNION ALL SELECT n_nationkey, 1, 'n_regionkey', n_name, CAST(n_regionkey AS VARCHAR) FROM nation""")
def list_table(spark, sf):
    return patterns.render(_nation_facts(spark, sf), {"pattern": "list_table", "table_id": "nation"}).select("row_index", "col_index", "column_key", "row_label", "value_text")


@query("SELECT CAST(s_suppkey AS BIGINT) AS row_index, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def pivot_long(spark, sf):
    f = facts.melt(_t(spark, sf, "supplier"), "supplier", "s_name", ["s_name", "s_nationkey", "s_acctbal"], "s_suppkey")
    return _rounded(shape.pivot_long(f), "s_nationkey", "s_acctbal")


@query("""
SELECT 'supplier' AS table_id, CAST(s_suppkey AS BIGINT) AS row_index, s_name AS row_label, 0 AS col_index, 's_nationkey' AS column_key, CAST(s_nationkey AS DOUBLE) AS value_num, 'number' AS value_type FROM supplier
UNION ALL SELECT 'supplier', s_suppkey, s_name, 1, 's_acctbal', round(s_acctbal, 2), 'number' FROM supplier
UNION ALL SELECT 'supplier', s_suppkey, s_name, 2, 's_name', NULL, 'text' FROM supplier""")
def melt_facts(spark, sf):
    f = facts.melt(_t(spark, sf, "supplier"), "supplier", "s_name", ["s_nationkey", "s_acctbal", "s_name"], "s_suppkey")
    return _rounded(f.select("table_id", "row_index", "row_label", "col_index", "column_key", "value_num", "value_type"), "value_num")


# Tables printed from the driver's rows ----------------------------------------------

def printed_tables(spark, sf, european_odd: bool = False) -> DataFrame:
    """One table a nation: its suppliers with balances as printed numbers."""
    plain = F.format_number("s_acctbal", 2)
    eu = F.translate(plain, ",.", ".,")
    money = F.when(F.col("s_nationkey") % 2 == 1, eu).otherwise(plain) if european_odd else plain
    row = F.array(F.col("s_name"), money, F.concat(F.col("s_suppkey").cast("string"), F.lit("%")))
    d = _t(spark, sf, "supplier").select("s_nationkey", F.struct("s_suppkey", row.alias("r")).alias("o"))
    g = d.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("o")).alias("o"))
    heads = F.array(F.lit("Supplier"), F.lit("Balance ($)"), F.lit("Share"))
    return g.select(F.lit("doc").alias("document_id"), F.col("s_nationkey").cast("string").alias("table_id"), F.col("s_nationkey").cast("int").alias("table_index"), heads.alias("headers"), F.transform("o", lambda x: x["r"]).alias("rows"), F.transform("o", lambda x: F.lit(1)).alias("row_pages"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))


@query("""
WITH n AS (SELECT s_nationkey, count(*) AS n, count(DISTINCT round(s_acctbal, 2)) AS b FROM supplier GROUP BY 1)
SELECT CAST(s_nationkey AS VARCHAR) AS table_id, 0 AS col_index, 'supplier' AS key, 'text' AS type, CAST(NULL AS VARCHAR) AS unit, 0.0 AS numeric_coverage, n AS "distinct", true AS is_label FROM n
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 1, 'balance', 'number', 'USD', 1.0, b, false FROM n
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 2, 'share', 'number', '%', 1.0, n, false FROM n""")
def profile_columns(spark, sf):
    return facts.ingest_tables(printed_tables(spark, sf))[1].select("table_id", "col_index", "key", "type", "unit", F.col("numeric_coverage").cast("double").alias("numeric_coverage"), "distinct", "is_label")


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT CAST(s_nationkey AS VARCHAR) AS table_id, CAST(i AS INT) AS row_index, s_name AS row_label, column_key, value_num, unit FROM (
  SELECT *, 'supplier' AS column_key, CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS unit FROM o
  UNION ALL SELECT *, 'balance', round(s_acctbal, 2), 'USD' FROM o
  UNION ALL SELECT *, 'share', CAST(s_suppkey AS DOUBLE), '%' FROM o)""")
def row_label_copy(spark, sf):
    f, _ = facts.ingest_tables(printed_tables(spark, sf))
    return _rounded(f.select("table_id", "row_index", "row_label", "column_key", "value_num", "unit"), "value_num")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS table_id, c AS col_index, c = 1 AND s_nationkey % 2 = 1 AS european FROM (SELECT DISTINCT s_nationkey FROM supplier), (VALUES (0), (1), (2)) v(c)")
def european_vote(spark, sf):
    return facts.european_columns(facts.cells(printed_tables(spark, sf, True)))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS table_id, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1""")
def european_facts(spark, sf):
    f, _ = facts.ingest_tables(printed_tables(spark, sf, True))
    return _rounded(f.where("column_key = 'balance'").groupBy("table_id").agg(F.sum("value_num").alias("total")), "total")


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS table_id, ['supplier', 'balance', 'share'] AS column_keys, 'supplier' AS label_column_key, CAST(count(*) AS INT) AS row_count, CAST(3 * count(*) AS INT) AS fact_count, 'Table with columns: Supplier, Balance ($), Share' AS semantic_description FROM supplier GROUP BY 1""")
def table_registry(spark, sf):
    t = printed_tables(spark, sf)
    f, p = facts.ingest_tables(t)
    return facts.registry(t, p, facts.cap_facts(f)).select("table_id", "column_keys", "label_column_key", "row_count", "fact_count", "semantic_description")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN -round(p_retailprice, 2) WHEN 3 THEN p_size WHEN 4 THEN p_size * 1000 ELSE round(p_retailprice, 2) END::DOUBLE AS value_num,
  CASE p_partkey % 5 WHEN 2 THEN 'USD' WHEN 3 THEN '%' END AS unit, 'number' AS value_type FROM part""")
def parse_cell(spark, sf):
    money = F.format_number("p_retailprice", 2)
    kinds = [money, F.concat(F.lit("("), money, F.lit(")")), F.concat(F.lit("$"), money), F.concat(F.col("p_size").cast("string"), F.lit("%")), F.concat(F.col("p_size").cast("string"), F.lit("k"))]
    raw = F.get(F.array(*kinds), (F.col("p_partkey") % 5).cast("int"))
    d = parse_cells(_t(spark, sf, "part").select("p_partkey", raw.alias("raw")))
    return _rounded(d.select("p_partkey", "cell.value_num", "cell.unit", "cell.value_type"), "value_num")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'ambiguous' ELSE 'number' END AS value_type,
  CASE WHEN p_partkey % 5 = 3 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 5 = 4 THEN CAST(p_size AS DOUBLE) END AS value_num,
  CASE p_partkey % 5 WHEN 1 THEN 'range' WHEN 2 THEN 'inequality' WHEN 3 THEN 'approximate' WHEN 4 THEN 'multi_value' END AS parse_note FROM part""")
def parse_unsure_cells(spark, sf):
    """Cells that name nothing, a range, a bound, an estimate or several values."""
    n = F.col("p_size").cast("string")
    kinds = [F.lit("n/a"), F.concat(n, F.lit("-"), (F.col("p_size") + 1).cast("string")), F.concat(F.lit("<"), n), F.concat(F.lit("~"), n), F.concat(n, F.lit(" / "), (F.col("p_size") + 1).cast("string"))]
    raw = F.get(F.array(*kinds), (F.col("p_partkey") % 5).cast("int"))
    d = parse_cells(_t(spark, sf, "part").select("p_partkey", raw.alias("raw")))
    return _rounded(d.select("p_partkey", "cell.value_type", "cell.value_num", "cell.parse_note"), "value_num")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS value_date, 'date' AS value_type FROM orders""")
def parse_dates(spark, sf):
    forms = ["yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "yyyy/M/d"]
    raw = F.get(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % len(forms)).cast("int"))
    return parse_cells(_t(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))).select("o_orderkey", "cell.value_date", "cell.value_type")


@query("SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM part")
def sanitize_column_keys(spark, sf):
    return _t(spark, sf, "part").select("p_type").distinct().withColumn("key", sanitize_key(F.col("p_type")))


@query("""
WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_partkey // 40, p_brand ORDER BY p_partkey) AS i FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || CASE WHEN i > 1 THEN '_' || i ELSE '' END AS key FROM k""")
def sanitize_keys_numbered(spark, sf):
    """All parts' brands as headers, a table of 40 columns for each run of 40 keys."""
    heads = _t(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("t")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_brand"))).alias("c"))
    keyed = heads.select("c", sanitize_keys(F.transform("c", lambda x: x["p_brand"])).alias("k"))
    z = F.explode(F.arrays_zip(F.col("c.p_partkey").alias("p"), F.col("k").alias("k"))).alias("z")
    return keyed.select(z).select(F.col("z").getField("p").cast("long").alias("p_partkey"), F.col("z").getField("k").alias("key"))


@query("SELECT DISTINCT c_mktsegment, 'INR' AS unit, 10000000.0 AS scale FROM customer")
def header_units(spark, sf):
    h = F.concat("c_mktsegment", F.lit(" (INR crore)"))
    d = _t(spark, sf, "customer").select("c_mktsegment").distinct().withColumn("h", header_unit_scale(h))
    return d.select("c_mktsegment", "h.unit", F.col("h.scale").cast("double").alias("scale"))


# Markdown ---------------------------------------------------------------------------

def region_pages(spark, sf) -> DataFrame:
    """A document a region: its nations as a table over two pages, then a second table."""
    n = _t(spark, sf, "nation").withColumn("_r", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    n = n.withColumn("number", F.when(F.col("_r") <= 3, 1).otherwise(2))
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    g = n.groupBy("n_regionkey", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    table = F.concat(F.when(F.col("number") == 1, "| Nation | Key |").otherwise("| nation |  KEY |"), F.lit("\n| --- | :-: |\n"), "body", F.lit("\n"))
    other = F.when(F.col("number") == 2, "\nAlso:\n\n| Year | Total |\n|---|---|\n| 2020 | 5 |\n").otherwise("")
    return g.select(F.col("n_regionkey").cast("string").alias("document_id"), "number", F.concat(F.lit("Nations follow.\n\n"), table, other).alias("markdown"))


@query("""
SELECT CAST(n_regionkey AS VARCHAR) AS document_id, 0 AS table_index, 'Nation,Key' AS headers, CAST(count(*) AS INT) AS n_rows, 1 AS page_start, 2 AS page_end, string_agg(n_name, ',' ORDER BY n_nationkey) AS labels FROM nation GROUP BY 1
UNION ALL SELECT DISTINCT CAST(n_regionkey AS VARCHAR), 1, 'Year,Total', 1, 2, 2, '2020' FROM nation""")
def stitch_tables(spark, sf):
    t = tables.extract_tables(region_pages(spark, sf))
    return t.select("document_id", "table_index", F.array_join("headers", ",").alias("headers"), F.size("rows").alias("n_rows"), "page_start", "page_end", F.array_join(F.transform("rows", lambda r: F.get(r, F.lit(0))), ",").alias("labels"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS document_id, CAST(i AS INT) AS row_index, CASE WHEN i < 3 THEN 1 ELSE 2 END AS page_number, n_name AS row_label, CAST(n_nationkey AS DOUBLE) AS value_num FROM r""")
def table_extract(spark, sf):
    f, _ = facts.ingest_tables(facts.table_ids(tables.extract_tables(region_pages(spark, sf))))
    return _rounded(f.where("column_key = 'key'").select("document_id", "row_index", "page_number", "row_label", "value_num"), "value_num")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS document_id, CAST(2 + count(*) + 3 AS INT) AS table_lines, 2 AS table_blocks FROM nation GROUP BY 1")
def stitch_markdown(spark, sf):
    pages = region_pages(spark, sf).withColumn("markdown", F.regexp_replace("markdown", "Nations follow.\n\n", "")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("number", "markdown"))).alias("p"))
    docs = pages.select("document_id", tables.pages_to_markdown(F.col("p")).alias("markdown"))
    b = tables.blocks(tables.stitch_markdown(docs))
    return b.where("is_table").groupBy("document_id").agg(F.sum(F.size("lines")).cast("int").alias("table_lines"), F.count("*").cast("int").alias("table_blocks"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS document_id, CAST(2 AS BIGINT) AS stubs, CAST(0 AS BIGINT) AS rules, count(*) > 2 AS more FROM nation GROUP BY 1""")
def excise_stubs(spark, sf):
    pages = region_pages(spark, sf)
    t = facts.table_ids(tables.extract_tables(pages)).withColumn("description", facts.describe(F.col("headers")))
    docs = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("number", "markdown"))).alias("p")).select("document_id", tables.pages_to_markdown(F.col("p")).alias("markdown"))
    out = tables.excise(docs, t)
    return out.select("document_id", F.regexp_count("markdown", F.lit(r"\[TABLE ")).cast("long").alias("stubs"), F.regexp_count("markdown", F.lit(r"\| *:?-")).cast("long").alias("rules"), F.contains("markdown", F.lit("...\n")).alias("more"))


@query("""
WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
o AS (SELECT doc_id, n, unnest(range(0, n, 700)) AS "offset" FROM d)
SELECT doc_id, CAST("offset" AS INT) AS "offset", CAST("offset" // 1000 + 1 AS INT) AS page_number FROM o""")
def page_offset_join(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    spans = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000).cast("int"))).alias("p"), "n").select("doc_id", (F.col("p") + 1).alias("page"), (F.col("p") * 1000).alias("page_start"), F.least((F.col("p") + 1) * 1000, "n").alias("page_end"))
    offsets = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(700))).alias("offset"))
    return tables.page_of_offset(offsets, spans, "doc_id")


_HEADS = "regexp_extract(translate(replace(html, chr(10), ' '), '#', ''), '<{0}>(.*?)</{0}>', 1)"


@query(f"""
WITH h AS (SELECT page_id, trim({_HEADS.format('title')}) AS t, trim({_HEADS.format('h1')}) AS h FROM pages)
SELECT page_id, concat_ws(' > ', nullif(t, ''), nullif(h, '')) AS heading_context, split_part(concat_ws(' > ', nullif(t, ''), nullif(h, '')), ' > ', 1) AS section FROM h""")
def heading_context(spark, sf):
    """Whole pages with titles and headings as markdown; the headings in force at their ends."""
    md = F.translate(F.replace(F.coalesce("html", F.lit("")), F.lit("\n"), F.lit(" ")), "#", "")
    for tag, mark in (("title", "# "), ("h1", "## ")):
        md = F.replace(F.replace(md, F.lit(f"<{tag}>"), F.lit(f"\n{mark}")), F.lit(f"</{tag}>"), F.lit("\n"))
    d = _t(spark, sf, "pages").select("page_id", md.alias("md"))
    d = d.select("page_id", chunks.heading_context(F.col("md"), F.length("md")).alias("heading_context"))
    return d.withColumn("section", chunks.section(F.col("heading_context")))


@query("""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, 1 AS page, CAST(15 AS INT) AS page_start, CAST(15 + n AS INT) AS page_end FROM d
UNION ALL SELECT doc_id, 2, CAST(30 + n AS INT), CAST(30 + 2 * n AS INT) FROM d""")
def page_spans(spark, sf):
    text = F.coalesce("text", F.lit(""))
    d = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("<!-- PAGE 1 -->"), text, F.lit("<!-- PAGE 2 -->"), text).alias("markdown"))
    return tables.page_spans(d).select("doc_id", F.col("page").cast("int").alias("page"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"))


@query("SELECT conv_id, turn, CASE WHEN role <> '' THEN role || chr(10) || chr(10) || text ELSE text END AS embedded FROM conversations")
def embedded_text(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", chunks.embed_text(F.col("role"), F.col("text")).alias("embedded"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
f AS (SELECT n_regionkey, 0 AS table_index, i AS row_index, n_name AS row_label, CAST(n_nationkey AS DOUBLE) AS value_num, CASE WHEN i < 3 THEN 1 ELSE 2 END AS page_number FROM r
  UNION ALL SELECT DISTINCT n_regionkey, 1, 0, '2020', 5.0, 2 FROM nation),
n AS (SELECT n_regionkey, CAST(2 * (count(*) + 1) AS INT) AS fact_count FROM nation GROUP BY 1)
SELECT 'region' || n_regionkey AS document_id, table_index, CAST(row_index AS INT) AS row_index, row_label, value_num, page_number, 'completed' AS status, 2 AS page_count, 2 AS table_count, fact_count,
  n_regionkey || '.pdf' AS original_filename FROM f JOIN n USING (n_regionkey)""")
def ingest_end_to_end(spark, sf):
    """A file a region through the whole ingest: recognised, extracted, typed, registered, chunked; read back from the store."""
    pages = region_pages(spark, sf).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("number", "markdown"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["markdown"]), "\f")
    files = pages.select(F.concat(F.lit("/in/"), "document_id", F.lit(".pdf")).alias("path"), F.concat(F.lit("region"), "document_id").alias("file_hash"), F.encode(body, "UTF-8").alias("content"))
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/store-{uuid.uuid4().hex}"
    ingest.ingest_batch(files, root)
    f, reg, docs = (ingest.read_table(spark, root, n) for n in ("document_facts", "table_registry", "documents"))
    cells = f.where("column_key in ('key', 'total')").select("document_id", "table_id", "table_index", "row_index", "row_label", "value_num", "page_number")
    cells = cells.join(reg.select("table_id", "original_filename"), "table_id").join(docs.select(F.col("id").alias("document_id"), "status", "page_count", "table_count", "fact_count"), "document_id")
    return _rounded(cells.drop("table_id"), "value_num")


# Catalogue and documents --------------------------------------------------------------

def document_registry(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").groupBy(F.col("source").alias("table_id")).agg(F.count("*").alias("row_count"), F.max("doc_id").alias("created_at"))


@query("""
WITH h AS (SELECT source, count(*) AS hits FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'with']) GROUP BY 1),
r AS (SELECT source, count(*) AS row_count, max(doc_id) AS created_at FROM documents GROUP BY 1)
SELECT r.source AS table_id, row_count, coalesce(hits, 0) AS hits FROM r LEFT JOIN h USING (source) ORDER BY hits DESC, created_at DESC LIMIT 3""")
def catalog_candidates(spark, sf):
    f = _t(spark, sf, "documents").select(F.col("source").alias("table_id"), catalog.words_of(F.col("text")).alias("fts"))
    return catalog.candidates(document_registry(spark, sf), f, ["the", "with"]).select("table_id", "row_count", "hits")


@query()
def catalog_candidates_stemmed(spark, sf):
    f = catalog.with_fts(customer_facts(spark, sf))
    reg = f.groupBy("table_id").agg(F.max("row_index").alias("created_at"), F.lit(None).cast("string").alias("document_id"))
    return catalog.candidates(reg, f, catalog.query_lexemes("all the buildings")).select("table_id", "hits")


@query("SELECT p_brand AS table_id, list_sort(list(DISTINCT p_name))[1:5] AS sample_labels FROM part GROUP BY 1")
def sample_labels(spark, sf):
    return catalog.sample_labels(_t(spark, sf, "part").select(F.col("p_brand").alias("table_id"), F.col("p_name").alias("row_label")))


@query("SELECT source AS table_id, source AS document_id, 'tbl_' || left(source, 8) || '_t0' AS table_name, '' AS description, count(*) AS row_count, max(doc_id) AS created_at FROM documents GROUP BY 1")
def registry_list(spark, sf):
    r = document_registry(spark, sf).withColumns({"document_id": F.col("table_id"), "table_index": F.lit(0), "original_filename": F.lit(None).cast("string"), "semantic_description": F.lit(None).cast("string")})
    return catalog.list_tables(r).select("table_id", "document_id", "table_name", "description", "row_count", "created_at")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def list_documents_page(spark, sf):
    d = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("uploaded_at"))
    return catalog.list_documents(d, "F", 50, 100)[0].select("id", "status")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def list_documents_total(spark, sf):
    d = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("uploaded_at"))
    return catalog.list_documents(d, "F")[1]


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id = 7")
def get_document(spark, sf):
    return catalog.get_document(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), 7)


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_by_hash(spark, sf):
    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", catalog.file_hash(F.col("text")).alias("file_hash"))
    return d.groupBy("file_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))


@query("""
WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
k AS (SELECT h, max(CASE WHEN lang <> 'de' THEN 1 ELSE 0 END) AS alive FROM d WHERE lang <> 'fr' GROUP BY 1),
f AS (SELECT h, min(doc_id) AS first FROM d GROUP BY 1)
SELECT doc_id AS id, CASE WHEN doc_id <> first THEN 'skip' WHEN alive IS NULL THEN 'insert' WHEN alive = 0 THEN 'retry' ELSE 'skip' END AS action
FROM d JOIN f USING (h) LEFT JOIN k USING (h)""")
def register_new(spark, sf):
    d = _t(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), catalog.file_hash(F.col("text")).alias("file_hash"), "lang")
    known = d.where("lang <> 'fr'").select("file_hash", F.when(F.col("lang") == "de", "failed").otherwise("completed").alias("status"))
    return catalog.register(known, d.drop("lang")).select("id", "action")


@query("""
SELECT doc_id, 'document' AS origin, n_chars AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'label', CAST(quality AS BIGINT) FROM labels""")
def upsert_merge(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.lit("document").alias("origin"), F.col("n_chars").alias("value"))
    return catalog.upsert(d, _t(spark, sf, "labels").select("doc_id", F.lit("label").alias("origin"), F.col("quality").cast("long").alias("value")), ["doc_id"])


@query("""
SELECT 'documents' AS name, count(*) AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'facts', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def force_delete(spark, sf):
    labels = _t(spark, sf, "labels")
    gone = labels.where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    left = catalog.force_delete({"documents": _t(spark, sf, "documents").select(F.col("doc_id").alias("id")), "facts": labels.select(F.col("doc_id").alias("document_id"))}, gone)
    return left["documents"].agg(F.lit("documents").alias("name"), F.count("*").alias("kept")).unionByName(left["facts"].agg(F.lit("facts").alias("name"), F.count("*").alias("kept")))


@query("SELECT doc_id AS id, CASE WHEN doc_id = 3 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN doc_id = 3 THEN 5 ELSE 0 END AS chunk_count FROM documents")
def set_status(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("pending").alias("status"), F.lit(0).alias("chunk_count"), F.lit(None).cast("timestamp").alias("completed_at"))
    return catalog.set_status(d, 3, "completed", chunk_count=5).select("id", "status", "chunk_count")


@query("SELECT source AS table_id, source AS document_id, CAST(0 AS INT) AS table_index FROM documents WHERE source IN (SELECT max(source) FROM documents) GROUP BY 1")
def registry_of_document(spark, sf):
    r = document_registry(spark, sf).withColumns({"document_id": F.col("table_id"), "table_index": F.lit(0)})
    last = _t(spark, sf, "documents").agg(F.max("source")).first()[0]
    return catalog.table_list(r, [last])


@query("""
WITH h AS (SELECT source, count(*) AS hits FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the']) GROUP BY 1),
r AS (SELECT source, count(*) AS row_count, max(doc_id) AS created_at FROM documents WHERE source IN (SELECT max(source) FROM documents) GROUP BY 1)
SELECT r.source AS table_id, row_count, coalesce(hits, 0) AS hits FROM r LEFT JOIN h USING (source)""")
def catalog_of_document(spark, sf):
    f = _t(spark, sf, "documents").select(F.col("source").alias("table_id"), catalog.words_of(F.col("text")).alias("fts"))
    r = document_registry(spark, sf).withColumn("document_id", F.col("table_id"))
    last = _t(spark, sf, "documents").agg(F.max("source")).first()[0]
    return catalog.candidates(r, f, ["the"], [last]).select("table_id", "row_count", "hits")


# Chunks and vectors -------------------------------------------------------------------

@query("SELECT doc_id, left(sha256(source || ':0:' || left(text, 500)), 32) AS id FROM documents WHERE text IS NOT NULL")
def chunk_ids(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", chunks.chunk_id(F.col("source"), F.lit(0), F.col("text")).alias("id"))


@query()
def chunk_documents(spark, sf):
    return chunks.chunk_documents(_t(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "chunk_id", "start_offset", "end_offset", F.length("content").alias("n_chars"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM conversations")
def source_snippet(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", search.snippet(F.col("text")).alias("snippet"))


@query()
def embed_offline(spark, sf):
    """Vectors of all documents; the embedding itself takes a text's first 12,000 characters, as models do."""
    return search.embed(_t(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").alias("dimensions"))


def _vector(spark, sf) -> list[float]:
    """The vector of the least id stands for a question."""
    return list(_t(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_COS = "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score, label FROM embeddings"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"SELECT id, score FROM ({_COS}) ORDER BY score DESC, id LIMIT 5")
def vector_topk(spark, sf):
    return _hits(search.vector_search(_vectors(spark, sf), _vector(spark, sf)))


@query(f"SELECT id, score FROM ({_COS}) WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 20")
def vector_threshold(spark, sf):
    return _hits(search.vector_search(_vectors(spark, sf), _vector(spark, sf), 20, 0.3))


@query(f"SELECT id, score FROM ({_COS}) WHERE label IN (1, 2) ORDER BY score DESC, id LIMIT 5")
def vector_filtered(spark, sf):
    return _hits(search.vector_search(_vectors(spark, sf), _vector(spark, sf), where=F.col("label").isin(1, 2)))


@query(f"WITH t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r, max(score) OVER () AS best FROM ({_COS}) WHERE label = 3) SELECT id, score FROM t WHERE (best >= 0.5 AND score >= 0.5 AND r <= 5) OR (best < 0.5 AND r <= 3)")
def vector_retry(spark, sf):
    return _hits(search.search_with_retry(_vectors(spark, sf), _vector(spark, sf), where=F.col("label") == 3))


# Shapes -----------------------------------------------------------------------------------

@query("""
SELECT 0 AS position, 'p_partkey' AS name, 'numeric' AS kind, count(*) AS "rows", count(*) - count(p_partkey) AS nulls, coalesce(min(p_partkey) = max(p_partkey), false) AS constant, count(DISTINCT p_partkey) AS "distinct", 0 AS decimals FROM part
UNION ALL SELECT 1, 'p_brand', 'categorical', count(*), count(*) - count(p_brand), coalesce(min(p_brand) = max(p_brand), false), count(DISTINCT p_brand), 0 FROM part
UNION ALL SELECT 2, 'p_size', 'numeric', count(*), count(*) - count(p_size), coalesce(min(p_size) = max(p_size), false), count(DISTINCT p_size), 0 FROM part""")
def describe_columns(spark, sf):
    return shape.column_stats(_t(spark, sf, "part").select("p_partkey", "p_brand", "p_size"))


_BARS = "CASE WHEN n < 2 THEN 'R14_default' WHEN n <= 25 THEN 'R8_bar' WHEN n <= 60 THEN 'R9_bar_horizontal' ELSE 'R9_too_many_categories' END"
_GROUPED = "CASE WHEN n < 2 THEN 'R14_default' WHEN n <= 15 THEN 'R10_bar_grouped' ELSE 'R10_grouped_too_large' END"
_LINE = "CASE WHEN n < 2 THEN 'R14_default' WHEN n > 500 THEN 'R6_too_many_points' ELSE 'R6_temporal_line' END"
_SIZES = (
    ("few", "count(DISTINCT o_orderpriority) AS n FROM orders", _BARS), ("some", "count(DISTINCT c_nationkey || '-' || (c_acctbal > 4500)) AS n FROM customer", _BARS),
    ("many", "count(DISTINCT c_nationkey || '-' || c_mktsegment) AS n FROM customer", _BARS), ("years", "count(DISTINCT date_trunc('year', o_orderdate)) AS n FROM orders", _LINE),
    ("days", "count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders", _LINE), ("pairs", "count(DISTINCT o_orderpriority) AS n FROM orders", _GROUPED),
    ("wide pairs", "count(DISTINCT c_nationkey) AS n FROM customer", _GROUPED), ("dots", "count(DISTINCT c_nationkey) AS n FROM customer", "CASE WHEN n >= 10 THEN 'R12_scatter' ELSE 'R14_default' END"),
    ("dots of five", "count(DISTINCT n_regionkey) AS n FROM nation", "CASE WHEN n >= 10 THEN 'R12_scatter' ELSE 'R14_default' END"),
    ("long text", "length(string_agg(DISTINCT c_name, ', ')) AS n FROM customer", "CASE WHEN n > 200 THEN 'R2_scalar_too_long' ELSE 'R2_scalar' END"),
)
_FIXED = (("one", "R2_scalar"), ("cut", "R5_unordered_truncation"), ("top", "R8_bar"), ("none", "R1_empty"), ("six lines", "R7_series_cap"), ("wide", "R3_too_wide"), ("names", "R13_no_measures"))


@query(" UNION ALL ".join([f"SELECT '{k}' AS shape, {rule} AS rule FROM (SELECT {n})" for k, n, rule in _SIZES] + [f"SELECT '{k}', '{rule}'" for k, rule in _FIXED]))
def classify_shapes(spark, sf):
    """Results of whole tables that call each rule; which one follows from their sizes."""
    o, n, c = _t(spark, sf, "orders"), _t(spark, sf, "nation"), _t(spark, sf, "customer")
    total, balance = F.sum("o_totalprice").alias("total"), F.sum("c_acctbal").alias("balance")
    year, day = F.trunc("o_orderdate", "year").alias("year"), F.to_date("o_orderdate").alias("day")
    mean = F.avg("c_acctbal").alias("mean")
    cases = {
        "few": o.groupBy("o_orderpriority").agg(total), "some": c.groupBy(F.concat_ws("-", "c_nationkey", F.col("c_acctbal") > 4500).alias("kind")).agg(balance), "many": c.groupBy(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("kind")).agg(balance),
        "years": o.groupBy(year).agg(total), "days": o.groupBy(day).agg(total), "six lines": o.groupBy(year).agg(*[F.sum(F.col("o_totalprice") * i).alias(f"m{i}") for i in range(1, 7)]),
        "pairs": o.groupBy("o_orderpriority").agg(total, F.avg("o_totalprice").alias("mean")), "wide pairs": c.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("kind")).agg(balance, mean),
        "dots": c.groupBy("c_nationkey").agg(balance, mean).drop("c_nationkey"), "dots of five": n.groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("a"), F.max("n_nationkey").alias("b")).drop("n_regionkey"),
        "long text": c.agg(F.array_join(F.collect_set("c_name"), ", ").alias("names")), "one": o.agg(total), "wide": o.agg(*[F.sum(F.col("o_totalprice") * i).alias(f"m{i}") for i in range(13)]), "names": n.select("n_name", F.upper("n_name").alias("upper")),
        "cut": n.select("n_name", F.col("n_regionkey").alias("v")).limit(5), "top": n.select("n_name", F.col("n_nationkey").alias("v")).orderBy("n_name").limit(5), "none": n.where("n_nationkey < 0").select("n_name"),
    }
    rows = [(k, a["classifier"]["rule"]) for k, d in cases.items() for a in shape.build_artifact(d)]
    return spark.createDataFrame(rows, "shape string, rule string")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, CAST(row_number() OVER (ORDER BY sum(o_totalprice) DESC) - 1 AS INT) AS place FROM orders GROUP BY 1")
def artifact_records(spark, sf):
    """The records of a bar chart, in its order."""
    (a,) = shape.build_artifact(_t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total")))
    return spark.createDataFrame([(r["o_orderpriority"], float(r["total"]), i) for i, r in enumerate(a["data"])], "o_orderpriority string, total double, place int")


@query("""
SELECT 0 AS position, 'p_brand' AS name, 'dimension' AS role, count(*) AS n FROM part
UNION ALL SELECT 1, 'row_index', 'identifier', count(*) FROM part
UNION ALL SELECT 2, 'p_size', CASE WHEN min(p_size) = max(p_size) THEN 'constant' ELSE 'measure' END, count(*) FROM part
UNION ALL SELECT 3, 'one', 'constant', count(*) FROM part UNION ALL SELECT 4, 'nothing', 'empty_measure', count(*) FROM part""")
def column_roles(spark, sf):
    d = _t(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("row_index"), "p_size", F.lit(1).alias("one"), F.lit(None).cast("int").alias("nothing"))
    stats = shape.column_stats(d, exact=False).collect()
    return spark.createDataFrame([(r.position, r.name, shape.role_of(r.name, r.kind, r.rows, r.nulls, r.constant), r.rows) for r in stats], "position int, name string, role string, n long")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000")
def row_cap(spark, sf):
    """The outermost cap on free-form results; the cap is the feature."""
    return validate.enforce_limit(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, false), (7, true)) t(id, ok)")
def validate_queries(spark, sf):
    cases = [
        "SELECT value_num FROM document_facts WHERE table_id = 'x'", "SELECT value_num FROM document_facts", "DROP TABLE documents",
        "WITH m AS (SELECT row_index FROM document_facts WHERE table_id = 'x') SELECT * FROM m", "SELECT * FROM parquet.`/x` WHERE table_id = 'x'",
        "SELECT reflect('java.lang.System', 'exit', 0) FROM document_facts WHERE table_id = 'x'", "SELECT update FROM document_facts WHERE document_id = 'd';",
    ]
    return spark.createDataFrame([(i, validate.validate_sql(spark, c)[0]) for i, c in enumerate(cases, 1)], "id int, ok boolean")


# Routing and memory ----------------------------------------------------------------------

def _sql_count(words) -> str:
    return " + ".join(f"CAST(regexp_matches(t, '{route.word_pattern(w)}') AS INT)" for w in words)


_B, _E = route._B, route._E


@query(f"""
WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
s AS (SELECT conv_id, turn, {_sql_count(route.SQL_WORDS)} + CAST(regexp_matches(t, '{_B}(value[sd]?){_E}.*{_B}(in){_E}|{_B}(value[sd]?)[^\\p{{L}}\\p{{N}}_](in){_E}') AS INT) AS sql, {_sql_count(route.RAG_WORDS)} AS rag, {_sql_count(route.VIZ_WORDS)} AS viz,
  ({_sql_count(route.PRINTED_WORDS)}) > 0 OR regexp_matches(t, '{_B}figure\\s*[0-9]') AS printed, ({_sql_count(route.STRONG_WORDS)}) > 0 AS strong FROM c)
SELECT conv_id, turn, sql, rag, viz, CASE WHEN sql >= 2 AND rag = 0 THEN 'SQL' WHEN rag >= 2 AND sql = 0 THEN 'RAG' WHEN sql = 1 AND rag = 0 AND strong THEN 'SQL' WHEN viz > 0 AND sql >= 1 AND rag = 0 AND NOT printed THEN 'SQL' END AS route FROM s""")
def route_signals(spark, sf):
    d = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return route.with_route(d, "text").select("conv_id", "turn", "sql", "rag", "viz", "route")


def _sql_any(words) -> str:
    return f"regexp_matches(t, '{route.word_pattern('|'.join(words))}')"


@query(f"""
WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
SELECT conv_id, turn, NOT (({_sql_any(route.STANDALONE_WORDS)} OR regexp_matches(t, '{_B}explain{_E}.*(the|a){_E}')) AND NOT ({_sql_any(route.FOLLOWUP_WORDS)} OR regexp_matches(t, '^(how|why|when|where)'))) AS followup FROM c""")
def followups(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", route.is_followup(F.col("text")).alias("followup"))


@query("SELECT session_id, turn, role, left(content, 2000) AS content FROM (SELECT conv_id AS session_id, turn, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 12")
def memory_last_n(spark, sf):
    d = _t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    return route.append_messages(d.limit(0), d)


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count("*").alias("n"))
