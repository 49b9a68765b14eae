"""Personal data in whole texts, found through offset-preserving deobfuscation.

Two passes over each text:

1. *Base*: emails, IPv4 addresses, payment cards and phone numbers as written.
2. *Disguised*: a chain of transducers rewrites the text (look-alike letters and
   full-width forms to ASCII, invisible characters to nothing, spelled digits to
   digits, at/dot wordings to ``@`` and ``.``). Every rewritten character carries
   the source span it came from, so what the detectors find in the rewritten text
   maps back to source characters.

Base spans always stay; a disguised span is added unless a base span of the same
kind already covers it. Offsets count code points, ends are exclusive.

Defined cases: null text = empty text = no spans; repeated rows are scanned each on
their own; other columns pass through ``find_pii`` untouched unless they bear the
name of an output column, which then wins. All scans are linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its head only: from its middle the same tail would fail again.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
            at = text.find("@", done)
        else:
            done = at + 1  # no local part may reach over this sign
            at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as in KINDS, then by start."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that are drawn like Latin ones.
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсѕухԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινρ" "∂ıɡ", "ABESIJKMHOPCTYXaeijopcsyxdqw" "ABEZHIKMNOPTYXaoivp" "dig", strict=True))
_INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_DASHES = "‐‑‒–−"
_SUSPECT = re.compile("[" + "".join(_LOOKALIKES) + _INVISIBLE + _DASHES + " ․⁰-⁹₀-₉①-⒛。٠-٩۰-۹०-९﹒﹫！-～｡\U0001d400-\U0001d7ff]")
_SPELLED = {w: str(i) for i, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))} | {"oh": "0", "nought": "0"}
_WORDS = "|".join(_SPELLED)
_GAP = r"[ \t\n,.-]{1,3}"
_SPELLED_RUN = re.compile(rf"(?i)(?<![A-Za-z])(?:plus{_GAP})?(?:{_WORDS}|(?<![0-9])[0-9]++)(?:{_GAP}(?:(?:double|triple){_GAP})?(?:{_WORDS}|dot|point|[0-9]++))+(?![A-Za-z])")
_SPELLED_ITEM = re.compile(rf"(?i)plus|double|triple|dot|point|{_WORDS}|[0-9]+")
_SPELLED_HINT = re.compile(rf"(?i)\b(?:{_WORDS})\b")
# Endings that an address in words must have besides two-letter ones.
_TLD = r"(?:[A-Za-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|example|test|invalid|localhost|app|dev|xyz|online|site)"
_L, _R = r"[\[({<]", r"[\])}>]"
_AT_MARK = re.compile(rf"(?i)[ \t]?{_L}[ \t]?(?:at|@|arobase)[ \t]?{_R}[ \t]?|[ \t]@[ \t]|[ \t]?_at_[ \t]?")
_DOT_MARK = re.compile(rf"(?i)[ \t]?{_L}[ \t]?(?:dot|\.|point|punkt|punto)[ \t]?{_R}[ \t]?|[ \t]?_dot_[ \t]?")
# An address in words: a chain of words is read once, then what follows its at.
_CHAIN = re.compile(r"(?i)(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]++(?:(?: dot (?!at )|\.)[A-Za-z0-9_%+-]++)*+")
_TO_DOMAIN = re.compile(rf"(?i)(?: at |@)(?:[A-Za-z0-9-]++(?: dot |\.))+{_TLD}(?![A-Za-z0-9-])")
_WORD_SIGN = re.compile(r"(?i) at | dot ")


class Mapped:
    """A rewritten text and, for each of its characters, the source span behind it."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def replace(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply ordered, disjoint edits (from, to, new text); what an edit writes stands for all it replaces."""
        if not edits:
            return self
        text, cuts, at = [], [], 0  # cuts: (length, first and last character behind it, whether it is kept)
        for a, b, new in edits:
            text += [self.text[at:a], new]
            cuts += [(a - at, at, 0, 1), (len(new), a, b - 1, 0)]
            at = b
        text.append(self.text[at:])
        cuts.append((len(self.text) - at, at, 0, 1))
        size, first, last, kept = np.array(cuts, np.int64).T
        cut = np.repeat(np.arange(len(cuts)), size)
        inside = np.arange(len(cut)) - np.repeat(np.cumsum(size) - size, size)
        here = first[cut] + inside * kept[cut]
        return Mapped("".join(text), self.start[here], self.end[np.where(kept[cut] == 1, here, last[cut])])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


@cache
def _fold(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in "。｡":
        return "."
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


def _spelled_edits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Edits of spelled digit runs, and those that make a bare number of 9 to 19 digits."""
    edits, bare = [], []
    for m in _SPELLED_RUN.finditer(text):
        items = [x.lower() for x in _SPELLED_ITEM.findall(m[0])]
        spelled = sum(x in _SPELLED for x in items)
        if spelled < 3:
            continue
        out, times = [], 1
        for x in items:
            if x in ("double", "triple"):
                times = 2 if x == "double" else 3
            else:
                out.append({"plus": "+", "dot": ".", "point": "."}.get(x, _SPELLED.get(x, x)) * times)
                times = 1
        new = "".join(out)
        edits.append((m.start(), m.end(), new))
        if spelled >= 7 and new.isdigit() and 9 <= len(new) <= 19:
            bare.append(edits[-1])
    return edits, bare


def _marked(text: str) -> bool:
    """Whether an at/dot transducer would edit the text; asks the transducers themselves."""
    if " dot " in text.lower():
        return True
    return any(c in text for c in "[({<@_") and bool(_AT_MARK.search(text) or _DOT_MARK.search(text))  # each form holds one of these


def _worded_signs(text: str) -> Iterator[tuple[int, int]]:
    """Where at and dot stand for signs: in addresses that spell a dot, read from left to right."""
    low, at = text.lower(), 0
    if " dot " not in low:
        return
    while chain := _CHAIN.search(text, at):
        at = chain.end()
        if not (rest := _TO_DOMAIN.match(text, at)):
            continue
        at = rest.end()
        if " dot " in text[chain.start() : at].lower():
            yield from (x.span() for x in _WORD_SIGN.finditer(text, chain.start(), at))


def disguised_spans(text: str) -> list[Span]:
    """Spans in source offsets that show only in the rewritten text."""
    odd = bool(_SUSPECT.search(text))
    low = text.lower()
    marks = _marked(text)
    spelled = bool(_SPELLED_HINT.search(low))
    if not (odd or marks or spelled):
        return []
    m = Mapped(text)
    if odd:
        m = m.replace([(x.start(), x.end(), _fold(x[0])) for x in _SUSPECT.finditer(text) if _fold(x[0]) != x[0]])
    found: list[Span] = []
    edits, bare = _spelled_edits(m.text) if odd or spelled else ([], [])
    for a, b, d in bare:
        if len(d) >= 13 and _luhn(d):
            found.append(("card", *m.source(a, b)))
        elif len(d) <= 15:
            found.append(("phone", *m.source(a, b)))
    m = m.replace(edits)
    if odd or marks:
        m = m.replace([(x.start(), x.end(), "@") for x in _AT_MARK.finditer(m.text)])
        m = m.replace([(x.start(), x.end(), ".") for x in _DOT_MARK.finditer(m.text)])
        worded = [(a, b, "@" if "at" in m.text[a:b].lower() else ".") for a, b in _worded_signs(m.text)]
        m = m.replace(worded)
    for kind, a, b in base_spans(m.text):
        found.append((kind, *m.source(a, b)))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans); each by kind, then start."""
    base = base_spans(text)
    starts = {k: [b[1] for b in base if b[0] == k] for k in KINDS}
    ends = {k: [b[2] for b in base if b[0] == k] for k in KINDS}

    def covered(kind: str, a: int, b: int) -> bool:
        """By a base span of its kind; those are disjoint and ascend, so the last that begins no later decides."""
        i = bisect_right(starts[kind], a) - 1
        return i >= 0 and b <= ends[kind][i]

    more = [s for s in disguised_spans(text) if not covered(*s)]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *more}, key=lambda s: (order[s[0]], s[1], s[2]))


def redact(text: str, spans: list[Span]) -> str:
    """Replace the union of the spans; each joined stretch takes the mark of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = "base_spans array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>"


def find_pii(docs: DataFrame, text_col: str = "text", redacted_col: str | None = None) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of kind, start, end) to each row.

    With ``redacted_col`` the redacted text is returned under that name too. One
    narrow pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    added = {"base_spans", "spans"} | ({redacted_col} if redacted_col else set())
    keep = docs.select([c for c in docs.columns if c not in added or c == text_col])
    kept = [c for c in keep.columns if c not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name in kept), _SCHEMA, *([f"`{redacted_col}` string"] if redacted_col else [])])

    def run(it):
        def spans(x):
            return [dict(zip(("kind", "start", "end"), s, strict=True)) for s in x]

        for b in it:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            both = [all_spans(t) for t in texts]
            cols = [b.column(c) for c in kept] + [pa.array([spans(x) for x, _ in both], pa.list_(_SPAN)), pa.array([spans(x) for _, x in both], pa.list_(_SPAN))]
            if redacted_col:
                cols.append(pa.array([redact(t, s) if s else t for t, (_, s) in zip(texts, both, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*kept, "base_spans", "spans", *([redacted_col] if redacted_col else [])])

    return keep.mapInArrow(run, schema)
