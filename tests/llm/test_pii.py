"""Base spans against plain patterns, and disguises mapped back to the source."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    tests = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text) if tests[k](m[0])]


PIECES = ["a", "b.", "@", "@@", ".", "..", "c-d", "12", "255", "256", "0", "1.2.3.4", " ", "-", "+", "+1", "(", ")",
          "4111111111111111", "4111 1111 1111 1111", "é", "x@y.z", "%", "\n", "007"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text, kind, source", [
    ("mail jo.doe (at) mail (dot) example.com now", "email", "jo.doe (at) mail (dot) example.com"),
    ("mail jo at mail dot org now", "email", "jo at mail dot org"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
    ("call plus one two zero two five five five zero one four three today", "phone",
     "plus one two zero two five five five zero one four three"),
    ("card four one one one one one one one one one one one one one one one end", "card",
     "four one one one one one one one one one one one one one one one"),
    ("ip １０.0.0.７ x", "ip", "１０.0.0.７"),
    ("at one nine two dot one six eight dot zero dot one !", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguises(text, kind, source):
    spans = pii.spans_of(text)
    assert [(s[0], text[s[1]:s[2]], s[3]) for s in spans] == [(kind, source, "disguised")]


@pytest.mark.parametrize("text, kind, source, base", [
    ("x jоhn@example.com y", "email", "jоhn@example.com", "hn@example.com"),
    ("x john@example.cоm y", "email", "john@example.cоm", "john@example.c"),
    ("x john​.smith@example.com y", "email", "john​.smith@example.com", ".smith@example.com"),
    ("x john@mail.example dot com y", "email", "john@mail.example dot com", "john@mail.example"),
    ("call +1 202 555 014３ now", "phone", "+1 202 555 014３", "+1 202 555 014"),
    ("ip 192 dot one six eight dot 0 dot 1 x", "ip", "192 dot one six eight dot 0 dot 1", None),
    ("ip 192.168.0.one x", "ip", "192.168.0.one", None),
    ("mail jean point dupont arobase poste point fr merci", "email", "jean point dupont arobase poste point fr", None),
    ("an jo [at] post [punkt] de bitte", "email", "jo [at] post [punkt] de", None),
    ("tel más tres cuatro nueve uno dos tres cuatro cinco seis siete ya", "phone",
     "más tres cuatro nueve uno dos tres cuatro cinco seis siete", None),
    ("ruf plus vier neun drei null 1 2 3 4 5 6 an", "phone", "plus vier neun drei null 1 2 3 4 5 6", None),
])
def test_wider_disguises_stand_beside_base_spans(text, kind, source, base):
    got = [(s[0], text[s[1]:s[2]], s[3]) for s in pii.spans_of(text)]
    assert sorted(got) == sorted([(kind, source, "disguised"), *([(kind, base, "base")] if base else [])])
    assert pii.redacted(text) == text.replace(source, f"[{kind.upper()}]")


def test_invisible_characters_leave_nothing_behind():
    assert pii.redacted("x jo\u200bhn@example.com y") == "x [EMAIL] y"
    for unit in ("1 ", "1 one ", "1.one", "1" + " " * 50, "one\t\t", " point a@", " arobase a"):
        pii.spans_of(unit * 30_000)


@pytest.mark.parametrize("text", [
    "look at example.com and dot your i", "one two three go", "meet at noon (at) home", "they dot the i at noon", ""])
def test_plain_prose_has_none(text):
    assert pii.spans_of(text) == []


def test_long_texts_take_linear_time():
    for unit in ("a.", "1", "1.", "+1", "@a", "one ", " at a dot", "(at)", "а"):
        pii.spans_of(unit * 100_000)


def test_frame(spark):
    schema = "doc_id bigint, text string, spans string"
    rows = [(1, "a@b.co and +1 202 555 0143", "x"), (1, "a@b.co and +1 202 555 0143", "x"), (2, None, None), (None, "", "y")]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, len(r.spans)) for r in pii.find_pii(docs).collect()}
    assert got == {(1, 2), (2, 0), (None, 0)}
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == ["", "None", "[EMAIL] and [PHONE]", "[EMAIL] and [PHONE]"]
    assert pii.find_pii(docs.limit(0)).count() == 0
