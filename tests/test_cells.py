import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridmill.functions.cells import european_sign, header_unit_scale, parse_cells, sanitize_keys
from gridmill.operators import facts

CASES = [
    ("1234", "number", 1234, None, None), ("1,234", "number", 1234, None, None), ("1,234.56", "number", "1234.56", None, None), ("-42", "number", -42, None, None), ("+42", "number", 42, None, None), ("0.5", "number", "0.5", None, None),
    ("1,23,456", "number", 123456, None, None), ("1.234,56", "number", "1234.56", None, None), ("(1,234)", "number", -1234, None, None), ("(45)", "number", -45, None, None),
    ("45.2%", "number", "45.2", "%", None), ("1.2M", "number", 1200000, None, None), ("3bn", "number", 3 * 10**9, None, None), ("5k", "number", 5000, None, None), ("2 crore", "number", 2 * 10**7, None, None), ("1.5 lakh", "number", 150000, None, None), ("20 bps", "number", "0.002", None, None),
    ("₹1,200", "number", 1200, "INR", None), ("$99.50", "number", "99.5", "USD", None), ("€10", "number", 10, "EUR", None), ("Rs. 5", "number", 5, "INR", None),
    *[(x, "empty", None, None, None) for x in ("", "-", "–", "N/A", "n.a.", "nil", "NULL", None)],
    ("12-15", "ambiguous", None, None, "range"), (">1000", "ambiguous", None, None, "inequality"), ("≥ 5", "ambiguous", None, None, "inequality"), ("2024-01", "ambiguous", None, None, "range"), ("2022-23", "ambiguous", None, None, "range"),
    ("1,234 (5.6%)", "number", 1234, None, "multi_value"), ("~500", "number", 500, None, "approximate"), ("l23", "text", None, None, None), ("Revenue (1)", "text", None, None, None),
    ("1,234[1]", "number", 1234, None, None), ("1,234†", "number", 1234, None, None), ("1,234*", "number", 1234, None, None), ("(1.5) crore", "number", -15000000, None, None), ("1,5", "number", 15, None, None), ("**12**", "number", 12, None, None), ("1 234", "number", 1, None, "multi_value"),
]


def test_cells_one_by_one(spark):
    got = parse_cells(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")).orderBy("i").collect()
    for r, (raw, kind, num, unit, note) in zip(got, CASES, strict=True):
        c = r.cell
        assert (c.value_type, c.unit, c.parse_note) == (kind, unit, note), raw
        assert c.value_num == (None if num is None else Decimal(str(num))), raw
        assert c.value_text == (raw or "").strip()


@pytest.mark.parametrize("raw,date", [("2024-01-31", (2024, 1, 31)), ("2024-1-5", (2024, 1, 5)), ("3/4/2021", (2021, 4, 3)), ("13 March 2020", (2020, 3, 13)), ("Mar 2020", (2020, 3, 1)), ("jan 2, 2020", (2020, 1, 2))])
def test_dates_day_before_month(spark, raw, date):
    c = parse_cells(spark.createDataFrame([(raw,)], "raw string")).first().cell
    assert (c.value_type, c.value_date) == ("date", dt.date(*date))


def test_year_is_no_amount(spark):
    c = parse_cells(spark.createDataFrame([("2023",)], "raw string")).first().cell
    assert (c.value_type, c.value_num, c.value_date) == ("year", 2023, dt.date(2023, 1, 1))


def test_european_hint(spark):
    d = spark.createDataFrame([("1,5", True), ("1.234", True), ("1.234", False), ("1.234,5", True)], "raw string, eu boolean")
    assert [r.cell.value_num for r in parse_cells(d, european="eu").collect()] == [Decimal("1.5"), 1234, Decimal("1.234"), Decimal("1234.5")]
    s = spark.createDataFrame([("1,25",), ("1,234",), ("1.234,5",), ("1,234.5",), ("7",)], "raw string").select(european_sign(F.col("raw")).alias("s")).collect()
    assert [r.s for r in s] == [1, 0, 1, 0, None]


def test_headers(spark):
    heads = ["Revenue (INR crore)", "Share (%)", "Growth %", "Width (cm)", "Sales (in millions)", "Sales (millions)", "Plain", None, "Cost ($)"]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string").orderBy("i").select(header_unit_scale(F.col("h")).alias("x")).collect()
    assert [(r.x.unit, r.x.scale and int(r.x.scale)) for r in got] == [("INR", 10**7), ("%", None), ("%", None), ("cm", None), (None, None), ("millions", None), (None, None), (None, None), ("USD", None)]


def test_keys(spark):
    d = spark.createDataFrame([(["Total Revenue (₹)", "2024", "", "Total", "Total", "3d", "Total"],)], "h array<string>")
    assert d.select(sanitize_keys(F.col("h")).alias("k")).first().k == ["total_revenue", "2024", "column", "total", "total_2", "c_3d", "total_3"]


def _tables(spark, *tables):
    rows = [("d", str(i), i, h, r, [1] * len(r), 1, 1) for i, (h, r) in enumerate(tables)]
    return spark.createDataFrame(rows, "document_id string, table_id string, table_index int, headers array<string>, rows array<array<string>>, row_pages array<int>, page_start int, page_end int")


def test_column_decisions(spark):
    t = _tables(
        spark,
        (["Item", "Notes"], [["a", "see p. 4"], ["b", "12"], ["c", "unchanged"], ["d", "7"], ["e", "n/a"]]),
        (["Segment", "Revenue (INR crore)"], [["Consumer", "1204"], ["Enterprise", "3880"]]),
        (["Segment", "2022", "2023"], [["Consumer", "1", "2"], ["Enterprise", "3", "4"], ["Other", "5", "6"]]),
        (["a", "b", "c"], [["1", "2", "3"], ["4", "5"]]),
        (["x"], [["1"], ["2"], ["bad"], ["4"]]),
        (["k", "v"], [["p", "1,5"], ["q", "2,25"], ["r", "3"]]),
    )
    f, p = facts.ingest_tables(t)
    prof = {(r.table_id, r.col_index): r for r in p.collect()}
    cell = {(r.table_id, r.row_index, r.col_index): r for r in f.collect()}
    assert prof["0", 1].type == "text" and all(cell["0", i, 1].value_num is None for i in range(5))
    assert cell["0", 1, 1].parse_note == "column_is_text"
    assert prof["1", 1].unit == "INR" and cell["1", 0, 1].value_num == 1204 * 10**7 and cell["1", 0, 1].unit == "INR"
    assert [prof["2", i].is_label for i in range(3)] == [True, False, False]
    assert len([k for k in cell if k[0] == "3"]) == 5 and cell["3", 1, 0].parse_note == "ragged_row"
    assert prof["4", 0].numeric_coverage == 0.75
    assert cell["5", 0, 1].value_num == Decimal("1.5")
    assert cell["1", 1, 1].row_label == "Enterprise"


def test_cap_keeps_whole_rows(spark):
    f, _ = facts.ingest_tables(_tables(spark, (["a", "b"], [[str(i), "x"] for i in range(10)])))
    assert facts.cap_facts(f, 7).count() == 6 and facts.cap_facts(f, 20).count() == 20
