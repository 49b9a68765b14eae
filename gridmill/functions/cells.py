"""Typing of printed cells as column expressions.

The policy is to leave a number out rather than to guess one. Each step of the parser
is bound once by ``let`` and then referred to, so the expression stays linear in size
and the optimiser may move it through filters without multiplying it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NUMBER

# The vocabulary of cells. Order matters for currency marks.
NULLISH = ("", "-", "--", "---", "–", "—", "n/a", "na", "n.a.", "n.a", "nil", "none", "null", "not available", "not applicable", ".", "..", "...")
CURRENCIES = (("₹", "INR"), ("rs.", "INR"), ("rs", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY"))
SCALES = (("trillion", "1000000000000"), ("tn", "1000000000000"), ("billion", "1000000000"), ("bn", "1000000000"), ("crore", "10000000"), ("cr", "10000000"), ("million", "1000000"), ("mn", "1000000"), ("m", "1000000"), ("lakh", "100000"), ("lakhs", "100000"), ("lac", "100000"), ("thousand", "1000"), ("k", "1000"), ("bps", "0.0001"))
DATE_PATTERNS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-M")

BLANK = r"[\s\x1c-\x1f\x85\p{Z}​]"
NUMERIC = r"^[+-]?[0-9.,]*[0-9][0-9.,]*$"
YEAR = r"^(19|20)[0-9]{2}$"
FACTOR = "decimal(17,4)"


def strip(c: Column, chars: str = BLANK) -> Column:
    return F.regexp_replace(c, f"^{chars}+|{chars}+$", "")


def clean(raw: Column) -> Column:
    """Without marks, footnotes and repeated blanks."""
    c = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\*\*|__|`|~~", "")
    c = F.trim(F.regexp_replace(c, f"{BLANK}+", " "))
    c = F.trim(F.regexp_replace(c, r"\[[0-9]+\]|[†‡]+$", ""))
    c = F.regexp_replace(c, r"^(.*[^ ]) *\([0-9]+\)$", "$1")  # "(45)" alone is a number
    return F.regexp_replace(c, r"^(.*[^*])\*+$", "$1").alias("clean")


def _scale_map() -> Column:
    return F.create_map(*[x for t, f in SCALES for x in (F.lit(t), F.lit(f).cast(FACTOR))])


def to_number(body: Column, european: Column) -> Column:
    """Separators read by the column's convention; NULL if it is no number."""
    comma, dot = F.contains(body, F.lit(",")), F.contains(body, F.lit("."))
    plain = F.replace(body, F.lit(","), F.lit(""))
    decimal_comma = F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    no_dots = F.replace(body, F.lit("."), F.lit(""))
    eu = F.coalesce(european, F.lit(False))
    last_is_comma = body.rlike(r",[^.]*$")
    two = body.rlike(r"^[^,]*,[^,]*$") & ~body.rlike(r",[^,]{3}$")
    text = (
        F.when(comma & dot, F.when(last_is_comma, decimal_comma).otherwise(plain))
        .when(comma, F.when(eu & two, F.replace(body, F.lit(","), F.lit("."))).otherwise(plain))
        .when(dot, F.when((eu & body.rlike(r"^[^.]*\.[^.]{3}$")) | body.rlike(r"\..*\."), no_dots).otherwise(body))
        .otherwise(body)
    )
    return F.when(body.rlike(NUMERIC), text.try_cast(NUMBER))


def to_date(text: Column) -> Column:
    """First of the listed patterns that fits, day before month."""
    return F.when(text.rlike("[0-9]"), F.coalesce(*[F.try_to_date(text, p) for p in DATE_PATTERNS]))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transform of an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _peel_currency(b: Column) -> Column:
    none = F.lit(None).cast("string")
    low = F.lower(b)
    hit = reduce(lambda w, x: w.when(F.startswith(low, F.lit(x[0])), F.struct(F.lit(x[1]).alias("u"), F.lit(len(x[0])).alias("n"))), CURRENCIES[1:], F.when(F.startswith(low, F.lit(CURRENCIES[0][0])), F.struct(F.lit(CURRENCIES[0][1]).alias("u"), F.lit(1).alias("n"))))
    return let(F.coalesce(hit, F.struct(none.alias("u"), F.lit(0).alias("n"))), lambda c: F.struct(c["u"].alias("unit"), F.trim(F.substring(b, c["n"] + 1, F.length(b))).alias("body")))


def _peel_percent(x: Column) -> Column:
    percent = F.endswith(x["body"], F.lit("%"))
    return F.struct(F.when(percent, F.lit("%")).otherwise(x["unit"]).alias("unit"), F.when(percent, F.trim(F.regexp_replace(x["body"], "%$", ""))).otherwise(x["body"]).alias("body"))


def _peel_scale(x: Column) -> Column:
    """struct(unit, body, scale): a magnitude word after a numeric core is taken off."""
    low = F.replace(F.lower(x["body"]), F.lit(" "), F.lit(""))
    parts = F.struct(F.regexp_extract(low, "([a-z]+)$", 1).alias("word"), strip(F.regexp_replace(low, "[a-z]+$", ""), "[ .]").alias("core"))
    found = let(parts, lambda p: F.struct(F.when((p["word"] != "") & p["core"].rlike(NUMERIC), F.try_element_at(_scale_map(), p["word"])).alias("scale"), p["core"].alias("core")))
    return let(found, lambda f: F.struct(x["unit"].alias("unit"), F.when(f["scale"].isNotNull(), f["core"]).otherwise(x["body"]).alias("body"), f["scale"].alias("scale")))


def parse_cell(raw: Column, european: Column | None = None) -> Column:
    """struct(value_text, value_num, value_date, unit, scale_factor, value_type, parse_note) of a printed cell."""
    eu = european if european is not None else F.lit(False)
    none = F.lit(None).cast("string")
    shown = strip(F.coalesce(raw, F.lit("")))

    def from_text(t: Column) -> Column:
        head = F.struct(
            F.lower(t).isin(*NULLISH).alias("empty"),
            t.rlike(r"(?i)^[+-]?[0-9.,]+\s*(?:-|–|—|to)\s*[+-]?[0-9.,]+$").alias("range"),
            t.rlike("^[<>≤≥]").alias("unequal"),
            t.rlike("^[~≈]").alias("about"),
            F.trim(F.regexp_replace(t, "^[~≈]", "")).alias("b"),
        )
        return let(head, lambda h: from_head(t, h))

    def from_head(t: Column, h: Column) -> Column:
        wrapped = r"^\(([^)]+)\)\s*(.*)$"
        paren = F.struct(F.trim(F.regexp_extract(h["b"], wrapped, 1)).alias("inner"), F.trim(F.regexp_extract(h["b"], wrapped, 2)).alias("rest"))
        signed = let(paren, lambda p: F.struct(((p["inner"] != "") & ~p["inner"].rlike(r"^\p{L}")).alias("neg"), F.trim(F.concat_ws(" ", p["inner"], p["rest"])).alias("b")))
        return let(signed, lambda s: let(_peel_currency(F.when(s["neg"], s["b"]).otherwise(h["b"])), lambda c: let(_peel_percent(c), lambda u: let(_peel_scale(u), lambda x: from_parts(t, h, s["neg"], x)))))

    def from_parts(t: Column, h: Column, neg: Column, x: Column) -> Column:
        plain = ~(h["empty"] | h["range"] | h["unequal"])
        first = F.regexp_extract(x["body"], r"^([+-]?[0-9.,]*[0-9][0-9.,]*)\b", 1)
        state = F.struct(x["body"].rlike(NUMERIC).alias("numeric"), first.alias("first"), F.when(plain, to_date(t)).alias("date"))
        return let(state, lambda n: from_state(h, neg, x, n))

    def from_state(h: Column, neg: Column, x: Column, n: Column) -> Column:
        multi = ~n["numeric"] & (n["first"] != "")
        body = F.when(multi, n["first"]).otherwise(x["body"])
        note = F.when(h["about"], "approximate").when(multi, "multi_value")
        value = let(body, lambda b: F.struct((b.rlike(YEAR) & x["scale"].isNull() & x["unit"].isNull()).alias("year"), to_number(b, eu).alias("num")))
        return let(value, lambda v: let(kind_of(h, n, v), lambda k: result(h, neg, x, n, v, k, note)))

    def kind_of(h: Column, n: Column, v: Column) -> Column:
        return (
            F.when(h["empty"], "empty").when(h["range"] | h["unequal"], "ambiguous").when(~n["numeric"] & n["date"].isNotNull(), "date")
            .when(v["year"], "year").when(v["num"].isNotNull(), "number").when(n["date"].isNotNull(), "date").otherwise("text")
        )

    def result(h: Column, neg: Column, x: Column, n: Column, v: Column, kind: Column, note: Column) -> Column:
        number, year = kind == "number", kind == "year"
        signed = F.when(neg, -v["num"]).otherwise(v["num"])
        scaled = F.when(x["scale"].isNotNull(), signed * x["scale"]).otherwise(signed).cast(NUMBER)
        early = (kind == "date") & ~n["numeric"]
        return F.struct(
            shown.alias("value_text"),
            F.when(number, scaled).when(year, v["num"]).alias("value_num"),
            F.when(year, F.make_date(v["num"].cast("int"), F.lit(1), F.lit(1))).when(kind == "date", n["date"]).alias("value_date"),
            F.when(number, x["unit"]).alias("unit"),
            F.when(number, x["scale"].cast(NUMBER)).alias("scale_factor"),
            kind.alias("value_type"),
            F.when(h["empty"], none).when(h["range"], "range").when(h["unequal"], "inequality").when(early & ~h["about"], none).otherwise(note).alias("parse_note"),
        )

    return let(clean(raw), from_text)


def parse_cells(df: DataFrame, raw: str = "raw", european: str | None = None, out: str = "cell") -> DataFrame:
    """Add ``out``, the parsed cell."""
    return df.withColumn(out, parse_cell(F.col(raw), F.col(european) if european else None))


def european_sign(raw: Column) -> Column:
    """1 for a cell that shows a decimal comma, 0 for one that shows a decimal point, else NULL."""
    t = clean(raw)
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    return (
        F.when(comma & dot, t.rlike(r",[^.]*$").cast("int"))
        .when(comma & t.rlike(r"^[^,]*,[^,]{1,2}$"), 1)
        .when(comma & t.rlike(r"^[^,]*(,[^,]{3})+$"), 0)
    )


def header_unit_scale(header: Column) -> Column:
    """struct(unit, scale) of a header such as 'Revenue (INR crore)'."""
    h = F.coalesce(header, F.lit(""))
    # All kinds of brackets as round ones; the last pair must close the header.
    even = F.rtrim(F.translate(h, "\uff08[\uff09]", "(())"))
    tail = F.substring_index(F.left(even, F.length(even) - 1), "(", -1)
    closed = F.endswith(even, F.lit(")")) & F.contains(even, F.lit("(")) & ~F.contains(tail, F.lit(")"))
    inside = F.lower(F.trim(tail))

    def word(t: str) -> Column:
        return inside.rlike(rf"(^|[^\p{{L}}\p{{N}}_])\Q{t}\E([^\p{{L}}\p{{N}}_]|$)") if t[-1].isalpha() else inside.rlike(rf"(^|[^\p{{L}}\p{{N}}_])\Q{t}\E[\p{{L}}\p{{N}}_]") if t[0].isalpha() else F.contains(inside, F.lit(t))

    unit = reduce(lambda w, x: w.when(word(x[0]), F.lit(x[1])), CURRENCIES, F.when(F.lit(False), F.lit(None).cast("string")))
    unit = F.coalesce(unit, F.when(F.contains(inside, F.lit("%")) | F.contains(inside, F.lit("percent")), F.lit("%")))
    scale = reduce(lambda w, x: w.when(word(x[0]), F.lit(x[1]).cast(NUMBER)), SCALES, F.when(F.lit(False), F.lit(None).cast(NUMBER)))
    bare = F.when(unit.isNull() & scale.isNull() & inside.rlike(r"^\p{L}{1,12}$"), inside)
    none = F.lit(None)
    return F.when(closed, F.struct(F.coalesce(unit, bare).alias("unit"), scale.alias("scale"))).otherwise(
        F.struct(F.when(F.contains(h, F.lit("%")), F.lit("%")).otherwise(none.cast("string")).alias("unit"), none.cast(NUMBER).alias("scale"))
    )


def sanitize_key(name: Column) -> Column:
    """Header to identifier; bare years stay, other leading digits get a prefix."""
    key = strip(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "_"), "_")
    return F.when(key == "", "column").when(key.rlike("^[0-9]") & ~key.rlike(YEAR), F.concat(F.lit("c_"), key)).otherwise(key)


def sanitize_keys(headers: Column) -> Column:
    """Keys of an array of headers, repeats numbered _2, _3, ..."""
    keys = F.transform(headers, sanitize_key)
    return F.transform(keys, lambda k, i: F.when(F.size(F.filter(F.slice(keys, 1, i + 1), lambda x: x == k)) > 1, F.concat_ws("_", k, F.size(F.filter(F.slice(keys, 1, i + 1), lambda x: x == k)).cast("string"))).otherwise(k))
