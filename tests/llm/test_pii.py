import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    s = [int(c) for c in d][::-1]
    return sum(s[0::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def brute(t):
    """The contract's patterns, as written."""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = [(m.span(), re.sub("[^0-9]", "", m[0])) for m in CARD.finditer(t)]
    out += [("card", *s) for s, d in digits if 13 <= len(d) <= 19 and plain_luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", ".", "x.co", "-", "%", " ", "1", "25", "256", "0", "4111111111111111", "4111 1111-1111 1111", "+", "(", ")", "é", "\n", "_", "１"]), max_size=40).map("".join))
def test_base_is_the_contract(t):
    assert pii.base_spans(t) == brute(t)
    base, every = pii.all_spans(t)
    assert set(base) <= set(every)


def found(t):
    return {(k, t[a:b]) for k, a, b in pii.all_spans(t)[1]}


def test_disguises_map_back_to_source():
    assert ("email", "jane (at) mail (dot) example (dot) com") in found("write jane (at) mail (dot) example (dot) com now")
    assert ("email", "jane.doe at example dot com") in found("to jane.doe at example dot com, please")
    assert ("email", "jane[at]example.com") in found("x jane[at]example.com y")
    assert ("email", "jоhn@example.com") in found("mail jоhn@example.com")  # Cyrillic o
    assert ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ") in found("é ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")
    assert ("email", "ja​ne@exa​mple.com") in found("ja​ne@exa​mple.com")
    assert ("phone", "five five five one two three four five six seven") in found("call five five five one two three four five six seven today")
    assert ("phone", "plus one four one five five five five two six seven one") in found("plus one four one five five five five two six seven one")
    assert ("card", "four double one one one one one one one one one one one one one one") in found("card four double one one one one one one one one one one one one one one ok")
    assert ("ip", "１９２.168.0.1") in found("at １９２.168.0.1")


def test_gate_is_as_wide_as_the_transducers(monkeypatch):
    blanks = [(a, b) for a in ("", " ", "\t") for b in ("", " ", "\t")]
    pairs = [(x, y) for x in "[({<" for y in "])}>"]
    at = [f"{a}{x}{b}{w}{b}{y}{a}" for a, b in blanks for x, y in pairs for w in ("at", "AT", "@", "arobase")]
    at += [f"{a}{m}{b}" for a, b in blanks for m in ("_at_", "_At_")] + [" @ ", "\t@ ", " @\t", "\t@\t"]
    dot = [f"{a}{x}{b}{w}{b}{y}{a}" for a, b in blanks for x, y in pairs for w in ("dot", "DOT", ".", "point", "punkt", "punto")]
    dot += [f"{a}{m}{b}" for a, b in blanks for m in ("_dot_", "_Dot_")]
    texts = [f"mail jo{m}example.com" for m in at] + [f"mail jo@example{m}com" for m in dot] + ["mail jo at example dot com", "mail jo@example dot com", "mail jo AT example DOT com"]
    gated = [pii.all_spans(t) for t in texts]
    monkeypatch.setattr(pii, "_marked", lambda t: True, raising=False)
    for t, got in zip(texts, gated, strict=True):
        assert got == pii.all_spans(t) and ("email", 5, len(t)) in got[1], t


def test_clean_text_stays_clean():
    for t in ("", "Look at the polka dot dress at noon.", "one two buckle my shoe", "We arrive at example dot", "naïve café at 10", "version 1.2.3", "Über ж мир", "between one and ten at most"):
        assert pii.all_spans(t)[1] == [], t


MB = 1_000_000
LONG = ["a" * MB, "1" * MB, "1." * (MB // 2), "+1" * (MB // 2), "one " * (MB // 4), "a@" * (MB // 2), "@" * MB, "0" * MB + ".1.2.3", "a dot " * (MB // 6), "a at " * (MB // 5), "x at " + "b dot " * (MB // 6)]
LONG += ["1" * MB + " one two three", "one two three four five six seven eight nine x " * (MB // 47), "jo@x.org " * (MB // 9) + "a at b dot com", "one " + " ." * (MB // 2), "+1" + "(" * MB, "(at)" * (MB // 4), "\u0430" * MB]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:12])
def test_long_texts_stay_linear(text):
    start = time.perf_counter()
    pii.all_spans(text)
    assert time.perf_counter() - start < 8  # quadratic scans take minutes


def test_leading_zeros():
    t = "0" * 5000 + ".1.2.3 and " + "0" * 5000 + "256.1.2.3"
    assert pii.base_spans(t) == [("ip", 0, 5006)]


_OLD = re.compile(rf"(?i)(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]+(?:(?: dot |\.)[A-Za-z0-9_%+-]+)*(?: at |@)(?:[A-Za-z0-9-]+(?: dot |\.))+{pii._TLD}(?![A-Za-z0-9-])")


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["jo", "x", "com", "org", " dot ", " DOT ", ".", " at ", "@", " ", "-", "\n", "com1", "é"]), max_size=24).map("".join))
def test_scanner_equals_the_pattern_tried_everywhere(t):
    """A pattern tried at every place finds the same addresses, if slowly."""
    want = [y.start() + x.start() for x in _OLD.finditer(t) if " dot " in x[0].lower() for y in pii._WORD_SIGN.finditer(x[0])]
    assert [a for a, _ in pii._worded_signs(t)] == want


def test_words_that_look_like_signs():
    assert ("email", "Dot at example dot com") in found("write to Dot at example dot com")


def test_redaction():
    t = "a jo@x.org b +1 (456) 555-2186 c"
    assert pii.redact(t, pii.all_spans(t)[1]) == "a [EMAIL] b [PHONE] c"
    assert pii.redact("abcdef", [("email", 1, 4), ("phone", 2, 5)]) == "a[EMAIL]f"


def test_rows(spark):
    d = spark.createDataFrame([(1, None, 7), (1, "jo@x.org", 8), (1, "jo@x.org", 8), (None, "", 9)], "doc_id long, text string, spans int")
    got = pii.find_pii(d, redacted_col="clean").collect()
    assert [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans], r.clean) for r in got] == [(1, [], ""), (1, [("email", 0, 8)], "[EMAIL]"), (1, [("email", 0, 8)], "[EMAIL]"), (None, [], "")]
    assert pii.find_pii(d.limit(0)).count() == 0
