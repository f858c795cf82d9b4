"""Personal data against the plain patterns, and what the method adds."""

import random
import re

import pytest

from leasegrain.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(p.lstrip("0") == "" or len(p.lstrip("0")) < 4 and int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plainly(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if valid(kind, m.group())]
    return sorted(found)


def base(found):
    return [tuple(s) for s in found if s.kind < len(personal.BASE)]


@pytest.fixture(scope="module")
def anchors():
    return personal.automaton()


def test_base_spans_equal_the_patterns_on_random_text(anchors):
    r = random.Random(4)
    pieces = ["a", "@", "b.c", ".", "1", "25", "255.", "256", "-", " ", "+1", "+", "(", ")", "4111111111111111", "5500 0000 0000 0004", "1.2.3.4", "_", "%", "é", "٣", "\n", "0", "49 30 1234567", "x@y.zz", "@d.e"]
    for _ in range(30_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert base(personal.spans(text, anchors)) == plainly(text), text


def test_very_long_runs_are_walked_once(anchors):
    # the plain patterns take quadratic time here, so they see short runs
    for part, tail in (("a", "@"), ("9", ".1"), ("a@", ""), ("1.", ""), ("+1-", ""), ("1 ", ""), ("@b.", ""), ("+1" + "-" * 40, "")):
        assert base(personal.spans(part * 500 + tail, anchors)) == plainly(part * 500 + tail)
        assert len(personal.spans(part * 100_000 + tail, anchors)) <= 100_000


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("see https://ann:s3cret@db.example.org/x now", "login", "https://ann:s3cret@db.example.org"),
        ("IBAN: GB82 WEST 1234 5698 7654 32 and", "account", "GB82 WEST 1234 5698 7654 32"),
        ("iban DE89370400440532013000.", "account", "DE89370400440532013000"),
        ("my account number: 12345678, thanks", "account", "12345678"),
        ("SSN 078-05-1120", "account", "078-05-1120"),
        ("at 221 Old Baker Street in", "address", "221 Old Baker Street"),
        ("au 12 rue de la Paix, Paris", "address", "12 rue de la Paix"),
        ("Calle de Alcalá 45 en", "address", "Calle de Alcalá 45"),
        ("wohnt Hauptstraße 7b in", "address", "Hauptstraße 7b"),
    ],
)
def test_the_method_adds_spans(anchors, text, kind, value):
    found = {(personal.KINDS[s.kind], text[s.start : s.end]) for s in personal.spans(text, anchors)}
    assert (kind, value) in found


@pytest.mark.parametrize("text", ["https://example.org/a@b", "on account of 3 things", "the Street of 1000 Lights", "IBAN: GB82 WEST 1234 5698 7654 33", "Lane 5", "account 12", "recount 12345678"])
def test_lookalikes_are_left_alone(anchors, text):
    assert not [s for s in personal.spans(text, anchors) if s.kind >= len(personal.BASE)]


def test_whole_tables_and_redaction(spark, docs, rows, none):
    got = {(r.doc_id, tuple((s.start, personal.KINDS.index(s.kind), s.end) for s in r.spans)) for r in personal.scan(docs).collect()}
    assert got == {(r[0], tuple(plainly(r[1]))) for r in rows}
    assert personal.scan(none).count() == 0 and personal.redact(none).count() == 0
    frame = spark.createDataFrame([(1, "Mail é a@b.cc or 10.0.0.1!", "x"), (2, None, "y"), (2, "", None)], "doc_id long, text string, spans string")
    kept = {tuple(r) for r in personal.redact(frame).collect()}
    assert kept == {(1, "Mail é [email] or [ip]!", "x"), (2, None, "y"), (2, "", None)}
