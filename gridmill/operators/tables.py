"""Markdown tables: pages, scanning, stitching over page breaks, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A header line, a rule line and at least one body line.
TABLE = r"(\|[^\n]+\|\n\|[-:\s|]+\|\n(?:\|[^\n]+\|\n?)+)"
RULE = r"^[\s|:-]*-[\s|:-]*$"
MARK = r"<!-- PAGE ([0-9]+) -->"


def pages_to_markdown(pages: Column) -> Column:
    """An array of struct(number, markdown) as one text with page marks."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("<!-- PAGE "), p["number"].cast("string"), F.lit(" -->\n\n"), p["markdown"])), "\n\n")


def fill_placeholders(markdown: Column, tables: Column) -> Column:
    """Put the content of struct(id, content) tables in place of their [id](id) links."""
    return F.aggregate(tables, markdown, lambda m, t: F.replace(m, F.concat(F.lit("["), t["id"], F.lit("]("), t["id"], F.lit(")")), t["content"]))


def page_spans(df: DataFrame, text: str = "markdown") -> DataFrame:
    """One row a page: number, start, end (half-open, code points). A text without marks is page 1."""
    c = F.col(text)
    parts = F.split(c, MARK)
    numbers = F.transform(F.regexp_extract_all(c, F.lit(MARK), 1), lambda n: n.cast("int"))
    marks = F.regexp_extract_all(c, F.lit(MARK), 0)
    lengths = F.transform(parts, lambda p: F.length(p))
    # A page runs from the end of its mark to the start of the next one.
    starts = F.transform(marks, lambda m, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(marks, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    spans = F.transform(numbers, lambda n, i: F.struct(n.alias("number"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.get(lengths, i + 1)).alias("end")))
    whole = F.array(F.struct(F.lit(1).alias("number"), F.lit(0).alias("start"), F.length(c).alias("end")))
    return df.withColumn("_s", F.explode(F.when(F.size(marks) > 0, spans).otherwise(whole))).select(*df.columns, F.col("_s.number").alias("page"), F.col("_s.start").alias("page_start"), F.col("_s.end").alias("page_end"))


def page_of_offset(offsets: DataFrame, spans: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """Page of each offset: the span that holds it, else the last page before it.

    Spans of a document are nested into one sorted array, so the range join is an
    equi-join on the document; a document's pages are few beside its offsets.
    """
    per = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_start", "page_end", "page"))).alias("_p"))
    inside = F.filter("_p", lambda p: (p["page_start"] <= F.col(offset)) & (F.col(offset) < p["page_end"]))
    page = F.coalesce(F.get(inside, F.lit(0))["page"], F.get(F.col("_p"), F.size("_p") - 1)["page"])
    return offsets.join(per, key, "left").select(*offsets.columns, page.alias("page_number"))


def split_row(line: Column) -> Column:
    body = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(body, r"\|"), lambda x: F.trim(x))


def column_count(line: Column) -> Column:
    """Columns of a table line: pipes - 1 if enclosed, else pipes + 1."""
    t = F.trim(line)
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return F.when(F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|")), pipes - 1).otherwise(pipes + 1)


def parse_table(raw: Column) -> tuple[Column, Column]:
    """(headers, rows): rows after the first rule; blank rows go, wide ones are cut, short ones stay."""
    lines = F.filter(F.split(F.trim(raw), "\n"), lambda x: F.trim(x) != "")
    headers = split_row(F.get(lines, F.lit(0)))
    rule = F.array_position(F.transform(lines, lambda x: x.rlike(RULE)), True).cast("int")
    body = F.slice(lines, rule + 1, F.size(lines))
    rows = F.transform(body, lambda x: F.slice(split_row(x), 1, F.size(headers)))
    return headers, F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))


def extract_tables(pages: DataFrame, doc: str = "document_id") -> DataFrame:
    """Tables of pages (doc, number, markdown), stitched over page breaks.

    A fragment continues its predecessor if it stands on the same or the next page and
    has equal headers up to case and blanks. Comparing with the preceding fragment
    is exact, as it carries the page end of what was merged so far.
    """
    found = pages.select(doc, F.col("number").alias("page"), F.posexplode(F.regexp_extract_all("markdown", F.lit(TABLE), 1)).alias("_i", "raw"))
    headers, rows = parse_table(F.col("raw"))
    found = found.withColumns({"headers": headers, "rows": rows})
    norm = F.transform("headers", lambda h: F.regexp_replace(F.lower(F.trim(h)), r"\s+", " "))
    found = found.withColumn("_h", norm)
    order = W.partitionBy(doc).orderBy("page", "_i")
    new = ~F.coalesce(F.lag("_h").over(order).eqNullSafe(F.col("_h")) & (F.col("page") - F.lag("page").over(order)).between(0, 1) & (F.size("_h") > 0), F.lit(False))
    found = found.withColumn("_new", new.cast("int")).withColumn("table_index", F.sum("_new").over(order) - 1)
    item = F.struct("page", "_i", "rows", "raw", "headers")
    g = found.groupBy(doc, "table_index").agg(F.sort_array(F.collect_list(item)).alias("_f"))
    return g.select(
        doc,
        F.col("table_index").cast("int").alias("table_index"),
        F.get(F.col("_f"), F.lit(0))["headers"].alias("headers"),
        F.flatten(F.transform("_f", lambda f: f["rows"])).alias("rows"),
        F.flatten(F.transform("_f", lambda f: F.array_repeat(f["page"], F.size(f["rows"])))).alias("row_pages"),
        F.get(F.col("_f"), F.lit(0))["page"].alias("page_start"),
        F.get(F.col("_f"), F.size("_f") - 1)["page"].alias("page_end"),
        F.transform("_f", lambda f: f["raw"]).alias("fragments"),
        F.array_join(F.transform("_f", lambda f: f["raw"]), "\n").alias("raw_markdown"),
    )


def extract_from_text(docs: DataFrame, doc: str = "document_id", text: str = "markdown") -> DataFrame:
    """Tables of whole texts with page marks: the marks cut them into pages, so rows keep theirs."""
    size = F.col("page_end") - F.col("page_start")
    pages = page_spans(docs.select(doc, text), text).select(doc, F.col("page").alias("number"), F.substring(text, F.col("page_start") + 1, size).alias("markdown"))
    return extract_tables(pages, doc)


def blocks(docs: DataFrame, doc: str = "document_id", text: str = "markdown") -> DataFrame:
    """Runs of table lines and of other lines: (doc, block, is_table, lines)."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("is_table", F.startswith(F.trim("line"), F.lit("|")))
    order = W.partitionBy(doc).orderBy("line_no")
    change = (~F.lag("is_table").over(order).eqNullSafe(F.col("is_table"))).cast("int")
    rows = rows.withColumn("_c", change).withColumn("block", F.sum("_c").over(order) - 1)
    g = rows.groupBy(doc, "block").agg(F.first("is_table").alias("is_table"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return g.select(doc, "block", "is_table", F.transform("_l", lambda x: x["line"]).alias("lines"))


def is_empty_gap(text: Column) -> Column:
    """Only blanks, page marks, rules or a bare page number."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)<!--\s*PAGE\s*[0-9]+\s*-->|---+|^\s*[0-9]+\s*$", ""), r"\s+", " ")) == ""


def stitch_markdown(docs: DataFrame, doc: str = "document_id", text: str = "markdown") -> DataFrame:
    """The text with tables joined over empty gaps; repeated headers and rules of the later part go.

    Tables at either side of an empty gap join if their first lines have equal column
    counts; chains join because a merged table keeps its first line's count.
    """
    b = blocks(docs, doc, text).withColumn("cols", F.when(F.col("is_table"), column_count(F.get(F.col("lines"), F.lit(0)))))
    order = W.partitionBy(doc).orderBy("block")
    gap = is_empty_gap(F.array_join(F.lag("lines").over(order), "\n"))
    b = b.withColumn("_join", F.coalesce(F.col("is_table") & gap & (F.lag("cols", 2).over(order) == F.col("cols")), F.lit(False)))
    b = b.withColumn("_drop", ~F.col("is_table") & F.coalesce(F.lead("_join").over(order), F.lit(False)))
    b = b.where(~F.col("_drop")).withColumn("_g", F.sum((~F.col("_join")).cast("int")).over(order))
    first = F.first("lines").over(W.partitionBy(doc, "_g").orderBy("block"))
    b = b.withColumn("_head", F.get(first, F.lit(0)))

    def norm(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")

    later = F.filter("lines", lambda x, i: ~((i == 0) & (norm(x) == norm(F.col("_head")))) & ~x.rlike(RULE))
    b = b.withColumn("lines", F.when(F.col("_join"), later).otherwise(F.col("lines")))
    g = b.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("block", "lines"))).alias("_b"))
    return g.select(doc, F.array_join(F.flatten(F.transform("_b", lambda x: x["lines"])), "\n").alias(text))


def stub(t) -> Column:
    """The text that stands for an excised table; t has the columns of the registry and rows."""
    pages = F.when(t["page_start"].isNull(), "").when(t["page_start"] == t["page_end"], F.concat(F.lit(" | page "), t["page_start"].cast("string"))).otherwise(F.concat(F.lit(" | pages "), t["page_start"].cast("string"), F.lit("-"), t["page_end"].cast("string")))
    preview = F.array_join(F.transform(F.slice(t["rows"], 1, 2), lambda r: F.array_join(r, " | ")), "\n")
    more = F.when(F.size(t["rows"]) > 2, "...\n").otherwise("")
    return F.concat(F.lit("[TABLE "), t["table_index"].cast("string"), F.lit(" — "), t["description"], pages, F.lit(" | table_id="), t["table_id"], F.lit("]\ncolumns: "), F.array_join(t["headers"], ", "), F.lit(" | "), F.size(t["rows"]).cast("string"), F.lit(" rows\n"), preview, F.lit("\n"), more)


def excise(docs: DataFrame, tables: DataFrame, doc: str = "document_id", text: str = "markdown") -> DataFrame:
    """Put a stub in place of each table's first fragment and drop the others (first occurrences)."""
    t = tables.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("table_index", "table_id", "description", "headers", "rows", "page_start", "page_end", "fragments"))).alias("_t"))

    def cut(md, piece, by):
        at = F.instr(md, piece)
        return F.when((F.length(piece) > 0) & (at > 0), F.concat(F.substring(md, F.lit(1), at - 1), by, F.substring(md, at + F.length(piece), F.length(md)))).otherwise(md)

    def fold(md, one):
        start = F.struct(md.alias("md"), stub(one).alias("by"))

        def step(acc, fragment):
            piece = F.trim(F.regexp_replace(fragment, r"^\s+|\s+$", ""))
            hit = (F.length(piece) > 0) & F.contains(acc["md"], piece)
            return F.struct(cut(acc["md"], piece, acc["by"]).alias("md"), F.when(hit, F.lit("")).otherwise(acc["by"]).alias("by"))

        return F.aggregate(one["fragments"], start, step)["md"]

    joined = docs.join(t, doc, "left")
    return joined.select(*[c for c in docs.columns if c != text], F.when(F.col("_t").isNull(), F.col(text)).otherwise(F.aggregate("_t", F.col(text), fold)).alias(text))
