from pyspark.sql import functions as F

from gridmill.operators import facts, tables

HEAD = "| A | B |\n|---|---|\n"


def _pages(spark, *pages):
    return spark.createDataFrame([("d", n, m) for n, m in pages], "document_id string, number int, markdown string")


def _extract(spark, *pages):
    return tables.extract_tables(_pages(spark, *pages)).orderBy("table_index").collect()


def test_stitching(spark):
    one = _extract(spark, (1, f"x\n\n{HEAD}| 1 | 2 |\n"), (2, f"{HEAD.lower()}| 3 | 4 |\n"), (3, f"{HEAD}| 5 | 6 |\n\nend"))
    assert len(one) == 1 and one[0].rows == [["1", "2"], ["3", "4"], ["5", "6"]] and one[0].row_pages == [1, 2, 3] and (one[0].page_start, one[0].page_end) == (1, 3)
    assert len(_extract(spark, (1, f"{HEAD}| 1 | 2 |\n"), (3, f"{HEAD}| 3 | 4 |\n"))) == 2  # a page between
    assert len(_extract(spark, (1, f"{HEAD}| 1 | 2 |\n"), (2, "| A | C |\n|---|---|\n| 3 | 4 |\n"))) == 2  # other header
    assert len(_extract(spark, (1, f"{HEAD}| 1 | 2 |\n\ntext\n\n{HEAD}| 3 | 4 |\n"))) == 1  # same page, same header


def test_ragged_blank_and_wide_rows(spark):
    (t,) = _extract(spark, (1, f"{HEAD}| 1 |\n|  |  |\n| 1 | 2 | 3 |\n"))
    assert t.rows == [["1"], ["1", "2"]] and t.headers == ["A", "B"]


def test_no_table(spark):
    assert _extract(spark, (1, "| no | rule |\n| a | b |\n")) == []


def test_string_stitcher(spark):
    md = f"intro\n{HEAD}| 1 | 2 |\n\n<!-- PAGE 2 -->\n\n{HEAD}| 3 | 4 |\n---\n{HEAD}| 5 | 6 |\nprose\n| x |\n|---|\n| y |"
    out = tables.stitch_markdown(spark.createDataFrame([("d", md)], "document_id string, markdown string")).first().markdown
    assert out == "intro\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |\nprose\n| x |\n|---|\n| y |"


def test_stubs(spark):
    p = _pages(spark, (1, f"before\n\n{HEAD}| 1 | 2 |\n| 3 | 4 |\n"), (2, f"{HEAD}| 5 | 6 |\n\nafter"))
    t = facts.table_ids(tables.extract_tables(p)).withColumn("description", F.lit("numbers"))
    md = p.groupBy("document_id").agg(tables.pages_to_markdown(F.sort_array(F.collect_list(F.struct("number", "markdown")))).alias("markdown"))
    out = tables.excise(md, t).first().markdown
    assert out.count("[TABLE 0 — numbers | pages 1-2 | table_id=") == 1 and "columns: A, B | 3 rows\n1 | 2\n3 | 4\n..." in out
    assert "| 5 | 6 |" not in out and "before" in out and "after" in out


def test_page_spans_and_offsets(spark):
    d = spark.createDataFrame([(1, "<!-- PAGE 1 -->abc<!-- PAGE 2 -->de"), (2, "plain")], "id int, markdown string")
    spans = tables.page_spans(d)
    assert [(r.id, r.page, r.page_start, r.page_end) for r in spans.orderBy("id", "page").collect()] == [(1, 1, 15, 18), (1, 2, 33, 35), (2, 1, 0, 5)]
    off = spark.createDataFrame([(1, 15), (1, 34), (1, 99), (2, 3)], "id int, offset int")
    assert sorted((r.id, r.offset, r.page_number) for r in tables.page_of_offset(off, spans.drop("markdown"), "id").collect()) == [(1, 15, 1), (1, 34, 2), (1, 99, 2), (2, 3, 1)]


def test_placeholders(spark):
    d = spark.sql("select 'see [tbl-0](tbl-0)' md, array(named_struct('id', 'tbl-0', 'content', '|a|')) t")
    assert d.select(tables.fill_placeholders(F.col("md"), F.col("t")).alias("m")).first().m == "see |a|"
