import hashlib
import random
import re

import pytest

from shelfwatch.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    parts = ["@", ".", "a", "b.c", "@x.y", "1", "25", "300", "-", " ", "+", "4111 1111 1111 1111", "(", ")", "é", "1.2.3.4",
             "+49 30 1234567", "x@y.z", "%", "..", "@@", "4111-1111-1111-1111", "0", "00000000000000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("write to jane (at) example (dot) com today", "email", "jane (at) example (dot) com"),
        ("jane.doe[AT]mail.example[DOT]org", "email", "jane.doe[AT]mail.example[DOT]org"),
        ("jane dot doe at example dot org", "email", "jane dot doe at example dot org"),
        ("аnnа@ехаmple.com", "email", "аnnа@ехаmple.com"),
        ("ａｎｎａ＠example.com", "email", "ａｎｎａ＠example.com"),
        ("call plus four nine three zero one two three four five six", "phone",
         "plus four nine three zero one two three four five six"),
        ("+49 30 １２３４５６７", "phone", "+49 30 １２３４５６７"),
        ("at ١٩٢.١٦٨.١.١ now", "ip", "١٩٢.١٦٨.١.١"),
        ("one nine two dot one six eight dot one two dot one three", "ip",
         "one nine two dot one six eight dot one two dot one three"),
        ("four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("jane\u200b@exam\u200bple.com", "email", "jane\u200b@exam\u200bple.com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, hidden):
    spans = pii.all_spans(text, pii.plain_spans(text))
    assert [text[a:b] for a, b in spans[kind]] == [hidden]


def test_base_spans_stay_and_clean_prose_has_none():
    text = "a@b.co and four five six; жук, 12 – 15, at the dot"
    base = pii.plain_spans(text)
    assert pii.all_spans(text, base) == base and base["email"] == [(0, 6)]
    assert not any(pii.all_spans(t, pii.plain_spans(t))[k] for k in pii.KINDS for t in
                   ("It was one of the two or three at that point.", "Он был там в 1999 году.", "eins zwei Polizei"))


def test_contract(docs_of, awkward, empty):
    rows = pii.find_personal_data(docs_of([(1, "x@y.zz 1.2.3.4"), (2, None)])).collect()
    assert rows[0].spans == "email:0:6,ip:7:14" and (rows[0].n_email, rows[0].n_ip, rows[0].n_card) == (1, 1, 0)
    assert rows[0].base_sha256 == hashlib.sha256(rows[0].spans.encode()).hexdigest()
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""
    assert pii.find_personal_data(awkward).count() == 13
    assert pii.find_personal_data(empty).count() == 0


def test_what_looks_plain_needs_no_transducer():
    """Spans with the test for disguises are those without it."""
    rng = random.Random(12)
    words = [*pii.SPELLED, "plus", "dot", "point", "at", "(at)", "[dot]", "bob", "example", "com", "@", ".", "plain", "\u200b", "е", "7", "-", "ſeven"]
    disguised = 0
    for _ in range(3000):
        text = rng.choice(["", " ", "  "]).join(rng.choice(words) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randrange(1, 14)))
        base = pii.plain_spans(text)
        spans = pii.all_spans(text, base)
        if not pii.is_disguised(text):
            assert pii.normalised(text).text == text and spans == base
        disguised += spans != base
    assert disguised > 5
    for text, kind in (("bob@example point com", "email"), ("plus acht eins null acht eins null acht eins null acht", "phone"), ("zero oh " * 7, "card")):
        assert pii.all_spans(text, pii.plain_spans(text))[kind]
