import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.operators import catalog, chunks, facts, patterns, search, shape
from gridmill.plans import route, validate
from gridmill.sources import readers
from gridmill.streaming import ingest

OK = "SELECT value_num FROM document_facts WHERE table_id = 'x'"
GOOD = [
    OK + " AND (row_label = 'a' OR row_label = 'b')", "SELECT value_num FROM document_facts WHERE (table_id = 'x' OR 'y' = document_id)", "SELECT value_num FROM document_facts WHERE table_id IN ('x', 'y') AND value_num > 1", "SELECT value_num FROM document_facts WHERE table_id IN (SELECT table_id FROM table_registry WHERE document_id = 'd')",
    OK, OK + ";", "SELECT headers FROM table_registry WHERE document_id = 'd'", "WITH matching AS (SELECT row_index FROM document_facts WHERE table_id='x') SELECT * FROM matching", "SELECT update FROM document_facts WHERE table_id = 'x'",
    "SELECT value_text FROM document_facts WHERE table_id='x' AND row_label = 'DELETE'", "SELECT value_num AS delete FROM document_facts WHERE table_id = 'x'", "SELECT row_label, sum(value_num) FROM document_facts WHERE table_id='x' GROUP BY row_label HAVING count(*) > 1 ORDER BY 2 LIMIT 5",
    "SELECT * FROM (SELECT row_index FROM document_facts WHERE table_id='x' LIMIT 5) t", "SELECT value_num FROM document_facts WHERE table_id='x' UNION SELECT value_num FROM document_facts WHERE table_id='y'",
]
BAD = [
    "SELECT * FROM secrets WHERE table_id = 'x'", "SELECT * FROM tbl_evil_extracted WHERE table_id = 'x'", "SELECT table_name FROM information_schema.tables WHERE table_id='x'", "SELECT * FROM pg_catalog.pg_tables WHERE table_id = 'x'",
    OK + "; DROP TABLE documents", OK + " /* */; DELETE FROM documents", "DELETE FROM documents WHERE table_id='x'", "UPDATE document_facts SET value_num = 0 WHERE table_id='x'", "INSERT INTO documents (filename) VALUES ('x')", "DROP TABLE documents", "ALTER TABLE documents ADD COLUMN x int", "CREATE TABLE evil (id int)", "TRUNCATE documents", "TRUNCATE TABLE documents",
    "SELECT pg_read_file('/etc/passwd') FROM document_facts WHERE table_id='x'", "SELECT reflect('java.lang.System', 'exit', 0) FROM document_facts WHERE table_id='x'", "SELECT value_num FROM document_facts", "SELECT table_id FROM document_facts", "", "   ", None, "this is not sql at all !!!",
    OK + " OR true", "SELECT value_num FROM document_facts WHERE table_id IS NOT NULL", "SELECT value_num FROM document_facts WHERE table_id = table_id", "SELECT value_num FROM document_facts WHERE NOT table_id = 'x'", "SELECT value_num FROM document_facts WHERE table_id <> 'x'", "SELECT value_num FROM document_facts WHERE table_id IN ('x', row_label)",
    "WITH a AS (SELECT 1) INSERT INTO documents SELECT * FROM a", "BEGIN SELECT 1; SELECT 2; END", "EXPLAIN " + OK, "SHOW TABLES", "SELECT * FROM parquet.`/x` WHERE table_id = 'x'", "SELECT * FROM document_facts WHERE table_id = 'x' AND row_index IN (SELECT id FROM secrets)", "SET spark.x=1",
]


@pytest.mark.parametrize("sql", GOOD)
def test_accepts(spark, sql):
    assert validate.validate_sql(spark, sql) == (True, None)


@pytest.mark.parametrize("sql", BAD)
def test_refuses(spark, sql):
    ok, why = validate.validate_sql(spark, sql)
    assert not ok and why


def test_scope_message(spark):
    assert "table_id" in validate.validate_sql(spark, "SELECT value_num FROM document_facts")[1]


def test_execute_and_limits(spark):
    spark.range(50).selectExpr("'x' table_id", "id value_num").createOrReplaceTempView("document_facts")
    assert validate.execute(spark, OK, max_rows=7)["row_count"] == 7
    assert validate.execute(spark, OK + " LIMIT 3", max_rows=7)["row_count"] == 3
    assert not validate.execute(spark, "SELECT nope FROM document_facts WHERE table_id='x'")["success"]


def _classified(spark, schema, rows, **kw):
    (a,) = shape.build_artifact(spark.createDataFrame(rows, schema), **kw)
    return a


def test_chart_rules(spark):
    day = dt.date(2024, 1, 1)
    nums = ", ".join(f"m{i} double" for i in range(6))
    line = _classified(spark, "d date, v double", [(day + dt.timedelta(days=11 - i), float(i)) for i in range(12)])
    assert line["type"] == "line" and [r["d"] for r in line["data"]] == sorted(r["d"] for r in line["data"])
    cases = [
        ("c string, v double", [], "empty", "R1_empty"), ("v double", [(1.0,)], "scalar", "R2_scalar"), ("s string", [("x" * 201,)], "table", "R2_scalar_too_long"),
        (f"d date, {nums}", [(day + dt.timedelta(days=i), *[float(i + j) for j in range(6)]) for i in range(4)], "table", "R7_series_cap"),
        *[("c string, v double", [(f"c{i:03}", float(i)) for i in range(n)], t, r) for n, t, r in ((5, "bar", "R8_bar"), (40, "bar_horizontal", "R9_bar_horizontal"), (200, "table", "R9_too_many_categories"))],
        ("c string, a double, b double, e double", [(f"c{i}", float(i), i + 1.0, i + 2.0) for i in range(8)], "bar_grouped", "R10_bar_grouped"),
        ("a double, b double", [(float(i), i * 2.0) for i in range(50)], "scatter", "R12_scatter"), ("a double, b double", [(float(i), i * 2.0) for i in range(4)], "table", "R14_default"),
        ("a string, b string, c string", [("x", "y", "z")] * 3, "table", "R13_no_measures"), (", ".join(f"n{i} int" for i in range(15)), [tuple(range(15))] * 3, "table", "R3_too_wide"),
    ]
    for schema, rows, kind, rule in cases:
        a = _classified(spark, schema, rows)
        assert (a["type"], a["classifier"]["rule"]) == (kind, rule), schema


def test_roles(spark):
    d = spark.createDataFrame([(1, None, 7, 1.25, "a"), (2, None, 7, 2.5, "b"), (3, None, 7, 3.0, "c")], "row_index int, e int, k int, v double, c string")
    assert [(m.role, m.decimals) for m in shape.describe_columns(d)] == [("identifier", 0), ("empty_measure", 0), ("constant", 0), ("measure", 2), ("dimension", 0)]
    assert shape.slug_keys(["Total Revenue (₹)", "id", "id", "2024", ""]) == ["total_revenue", "id", "id_2", "c_2024", "col"]


def test_truncation(spark):
    d = spark.createDataFrame([(f"c{i}", float(i)) for i in range(100)], "c string, v double")
    (cut,), (top,) = shape.build_artifact(d.limit(20)), shape.build_artifact(d.orderBy("v").limit(20))
    assert cut["classifier"]["rule"] == "R5_unordered_truncation" and top["type"] == "bar" and top["provenance"]["partial"]


def test_json_safe():
    assert [shape.json_safe(x) for x in (Decimal("1.5"), float("nan"), float("inf"), dt.date(2024, 1, 2), b"abc", 2**60, True, None, [1, {"a": Decimal(2)}])] == [1.5, None, None, "2024-01-02", "<3 bytes>", str(2**60), True, None, [1, {"a": 2.0}]]


def test_kinds():
    assert [shape.kind_of(t) for t in (T.LongType(), T.DecimalType(), T.TimestampNTZType(), T.BooleanType(), T.StringType(), T.BinaryType(), T.ArrayType(T.IntegerType()))] == ["numeric", "numeric", "temporal", "boolean", "categorical", "opaque", "opaque"]


def test_prose():
    r = [{"result": 6907, "unit": "INR", "parsed_cells": 28, "total_cells": 40}]
    s = shape.aggregate_sentence(r, {"agg": "SUM", "column_key": "2023", "row_filter": "x"})
    assert s == "Sum of 2023, rows like x: 6,907 INR. Read from 28 of 40 cells, the others hold no number."
    assert shape.aggregate_sentence([{"result": None}]) == "Result: none, since no cell there holds a number." and shape.aggregate_sentence([{"a": 1}]) is None
    assert shape.aggregate_sentence([{"result": 5, "unit": "%", "parsed_cells": 4, "total_cells": 4}]) == "Result: 5%."
    assert shape.result_text(["label", "value"], [{"label": "a", "value": 1}], 3, {"column_key": "k"}) == "3 rows, the first 1:\nRow\tk\na\t1"
    assert shape.display_columns(["label", "y_2022", "value"], {"column_keys": ["2022"], "column_key": "k"}) == ["Row", "2022", "k"]


def test_mixed_pivot_column_is_text(spark):
    d = spark.createDataFrame([(0, "a", "1", 1.0), (1, "a", "x", None), (0, "b", "2", 2.0)], "row_index int, column_key string, value_text string, value_num double")
    out = shape.pivot_long(d)
    assert dict(out.dtypes) == {"row_index": "int", "a": "string", "b": "double"} and out.count() == 2


@pytest.mark.parametrize("question,expected", [
    ("How many rows are in the table?", "SQL"), ("Explain the methodology", "RAG"), ("What is the total?", None), ("count the items", "SQL"), ("plot a table of things", "SQL"), ("the graph shown in the table on page 3", None), ("plot revenue", None), ("hello", None), ("recounting", None),
])
def test_routes(spark, question, expected):
    assert spark.range(1).select(route.route_of(F.lit(question))).first()[0] == expected


def test_followups(spark):
    got = {q: spark.range(1).select(route.is_followup(F.lit(q))).first()[0] for q in ("What is revenue?", "What about it?", "Why?", "Show me that")}
    assert got == {"What is revenue?": False, "What about it?": True, "Why?": True, "Show me that": True}


def test_memory(spark):
    m = spark.createDataFrame([("s", i, "user", "x" * 3000) for i in range(20)], "session_id string, turn int, role string, content string")
    out = route.append_messages(m.limit(0), m)
    assert out.count() == 12 and out.agg(F.max(F.length("content"))).first()[0] == 2000 and route.clear_session(out, "s").count() == 0 and route.session_exists(out, "s")


def test_slots():
    with pytest.raises(patterns.PatternError):
        patterns.render(None, {"pattern": "nope"})
    t = [{"table_id": "t", "column_keys": ["revenue", "cost"], "sample_labels": ["North"]}]
    assert patterns.default_slots("total revenue", t)["pattern"] == "scalar_aggregate" and patterns.default_slots("revenue and cost", t)["pattern"] == "comparison" and patterns.default_slots("revenue for north", t)["pattern"] == "cell_lookup"
    assert patterns.pin_table({"table_id": "zz"}, t)["table_id"] == "t" and patterns.series_names(["2022", "A b"]) == ["y_2022", "a_b"]


def test_stemmer():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "generalization": "gener", "adjustment": "adjust", "controlling": "control", "rate": "rate"}
    assert {w: catalog.stem(w) for w in words} == words


def test_chunks_cover_and_fit(spark):
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(40)) for i in range(30))
    got = chunks.split_text(text, 100, 0.1)
    assert all(chunks.count_words(c) <= 100 and text[a:b] == c for a, b, c in got) and {w for _, _, c in got for w in c.split()} == set(text.split())
    assert chunks.split_text("") == [] and len(chunks.split_text("x" * 50)) == 1


def test_headings(spark):
    md = "# A\n## B\n### C\n# D\n#### E\ntext\n## F\n"
    d = spark.createDataFrame([(md, 0), (md, md.index("# D")), (md, md.index("text")), (md, len(md))], "m string, o int")
    assert [r.h for r in d.select(chunks.heading_context(F.col("m"), F.col("o")).alias("h")).collect()] == ["", "A > B > C", "D > E", "D > F"]


def test_retry_policy():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise readers.Busy(5 if len(calls) == 2 else None)
        return "ok"

    assert readers.with_retry(call, sleep=waits.append) == "ok" and waits == [3.0, 5]
    with pytest.raises(ValueError):
        readers.with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)


def test_engine_end_to_end(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "facts"
    src.mkdir()
    (src / "a.pdf").write_text("# Report\n\nSales by region.\n\n| Region | Revenue ($) |\n|---|---|\n| North | 1,200 |\n| South | 800 |\n\f| Region | Revenue ($) |\n|---|---|\n| East | 500 |\n")
    (src / "b.txt").write_text("ignored")
    q = ingest.start(spark, str(src), str(out), str(tmp_path / "ck"))
    q.awaitTermination(120)
    f, reg, made = (ingest.read_table(spark, str(out), n) for n in ("document_facts", "table_registry", "document_chunks"))
    assert f.count() == 6 and f.where("column_key='revenue'").agg(F.sum("value_num")).first()[0] == 2500 and "fts" in f.columns
    (doc,) = ingest.read_table(spark, str(out), "documents").collect()
    assert (doc.filename, doc.status, doc.page_count, doc.table_count, doc.fact_count) == ("a.pdf", "completed", 2, 1, 6) and doc.chunk_count == made.count() > 0
    assert reg.first().original_filename == "a.pdf" and made.where("content like '%[TABLE %'").count() == 1
    engine = route.Engine(spark, f, reg, made)
    a = engine.ask("total revenue count", "s")
    assert a["route"] == "SQL" and "2500" in a["answer"].replace(",", "") and a["artifacts"]
    assert engine.ask("explain the concept of sales by region", "s")["route"] == "RAG" and len(engine.memory["s"]) == 4
    assert engine.ask("revenue", force_route="HYBRID")["artifacts"][0]["provenance"]["answer_is_llm_merged"]


def test_ingest_again(spark, tmp_path):
    """Skips, failures, retries and replacement of a document; tables that vanish are gone."""
    root = str(tmp_path / "store")
    two, one = "| A | B |\n|---|---|\n| x | 1 |\n\ntext\n\n| C | D |\n|---|---|\n| y | 2 |\n", "| A | B |\n|---|---|\n| x | 7 |\n"
    files = spark.createDataFrame([("/f/a.pdf", "ha", bytearray(two.encode())), ("/f/b.pdf", "hb", bytearray(b"bad")), ("/f/c.pdf", "hc", bytearray(b"only words"))], "path string, file_hash string, content binary")

    def provider(content, old=two.encode(), new=one):
        if content == b"bad":
            raise ValueError("no text")
        return readers.markdown_provider(content)

    ingest.ingest_batch(files, root, provider)
    docs = lambda: {r.filename: (r.status, r.table_count, r.error_message) for r in ingest.read_table(spark, root, "documents").collect()}
    assert docs() == {"a.pdf": ("completed", 2, None), "b.pdf": ("failed", 0, "no text"), "c.pdf": ("completed", 0, None)}
    assert ingest.read_table(spark, root, "table_registry").count() == 2
    ingest.ingest_batch(files, root)  # a and c are known; b is tried again
    assert docs()["b.pdf"] == ("completed", 0, None) and ingest.read_table(spark, root, "document_facts").count() == 4
    shorter = lambda content: readers.markdown_provider(one.encode() if content == two.encode() else content)
    ingest.ingest_batch(files.where("file_hash = 'ha'"), root, shorter, force=True)
    assert docs()["a.pdf"] == ("completed", 1, None) and [r.value_text for r in ingest.read_table(spark, root, "document_facts").orderBy("col_index").collect()] == ["x", "7"]
    assert ingest.read_table(spark, root, "table_registry").count() == 1


def test_cap_at_whole_rows(spark):
    rows = [("t", i, k) for i in range(5000) for k in range(2 if i % 3 else 3)] + [("u", i, 0) for i in range(9)]
    d = spark.createDataFrame(rows, "table_id string, row_index int, col_index int")
    for cap in (1, 2, 3, 700, 9556, 9558, 11_000, 11_667, 20_000):
        want, n = [], 0
        for i in range(5000):
            n += 2 if i % 3 else 3
            if n > cap:
                break
            want.append(i)
        got = facts.cap_facts(d, cap)
        assert [r.row_index for r in got.where("table_id = 't'").select("row_index").distinct().orderBy("row_index").collect()] == want, cap
        assert got.where("table_id = 'u'").count() == min(cap, 9)
    (cut,) = facts.cap_cuts(d, 700).collect()
    assert (cut.table_id, cut.facts, cut.kept) == ("t", 11_667, 700 if cut.kept == 700 else cut.kept) and 697 < cut.kept <= 700


def test_whole_texts_keep_pages(spark):
    md = "<!-- PAGE 1 -->\n\n| A | B |\n|---|---|\n| x | 1 |\n\n<!-- PAGE 2 -->\n\n| A | B |\n|---|---|\n| y | 2 |\n"
    from gridmill.operators import tables
    (t,) = tables.extract_from_text(spark.createDataFrame([("d", md)], "document_id string, markdown string")).collect()
    assert [list(r) for r in t.rows] == [["x", "1"], ["y", "2"]] and list(t.row_pages) == [1, 2]


def test_sessions_expire(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    d = spark.createDataFrame([("a", 0, at(0)), ("a", 1, at(200)), ("b", 0, at(100))], "session_id string, turn int, ts timestamp")
    assert [r.session_id for r in route.expire_sessions(d, F.lit(at(230))).collect()] == ["a", "a"] and route.clear_all(d).count() == 0


def test_render_for_prompts():
    text = catalog.render_catalog([{"table_id": "t1", "semantic_description": "sales", "original_filename": "a.pdf", "page_start": 2, "page_end": 3, "row_count": 4, "column_keys": ["k", "v"], "sample_labels": ["North"]}, {"table_id": "t2"}])
    assert text.splitlines() == ["[t1] sales; a.pdf; p. 2-3; 4 rows; columns k, v; labels North", "[t2] no description; 0 rows"]
    assert catalog.render_catalog([]) and search.build_context([]) and search.build_context([{"content": "c ", "heading_context": "A > B"}]) == "(1) A > B:\nc"
