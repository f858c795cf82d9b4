"""Personal data found by anchors.

One Aho-Corasick pass over a text finds anchors: at-signs, a dot or a plus before a
digit, digits, schemes and cue words. Each anchor has a parser that walks from it to
the left and right, as far as its kind allows, and checks what it found (part
sizes, digit counts, check digits). A parser goes on from where its last find
ended, so every character is walked a bounded number of times.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without
overlap within a kind. The method adds ``login`` (a user name or password in an
address with a scheme), ``account`` (IBANs by their check digits; numbers behind a
cue word) and ``address`` (a street with its house number).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrain.llm.common import map_arrow, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "address")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: user[:password]@host behind a scheme
USER = re.compile(r"[^\s/?#@:\"'<>]{1,256}(?::[^\s/?#@\"'<>]{0,256})?@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: What may stand between a cue word and its number, and the number.
NUMBER = re.compile(r"[\x20\t]{0,3}(?:(?:no|nr|num|number|id|numéro|nummer|número)\b\.?)?[\x20\t]{0,3}[:#=]?[\x20\t]{0,3}([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,19})(?![0-9A-Za-z])", re.IGNORECASE)
#: Street names: before the street word (with the house number first), behind it, and with the number last.
BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]?\x20(?:[A-ZÀ-Þ][\w'.-]{0,30}\x20){1,4}$")
NUMBERED = re.compile(r"(?<![\w.,-])[0-9]{1,5}(?:\x20?(?:bis|ter))?,?\x20$")
NAMES = re.compile(r"(?:\x20[\w'’-]{1,30}){0,4}\x20[A-ZÀ-Þ][\w'’-]{1,30}")
NAMES_AND_NUMBER = re.compile(r"(?:\x20[\w'’-]{1,30}){0,4}\x20[A-ZÀ-Þ][\w'’-]{1,30},?\x20(?:n[.º°]\x20?)?[0-9]{1,5}(?![\w.,-]?[0-9])")
STEM = re.compile(r"[A-ZÀ-Þ][\w-]{1,40}$")
HOUSE = re.compile(r"\x20[0-9]{1,4}[a-z]?(?![\w.,-]?[0-9])")
REACH = 160

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "git://", "postgres://", "mysql://", "redis://", "amqp://", "smb://")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "ssn", "passport", "reisepass", "passeport", "pasaporte")
#: street word -> where name and number stand
STREET_CUES = {
    **dict.fromkeys(("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Court", "Square", "Terrace"), "number name word"),
    **dict.fromkeys((" rue", " avenue", " boulevard", " impasse", " quai"), "number word name"),
    **dict.fromkeys(("Calle", "Avenida", "Plaza", "Paseo"), "word name number"),
    **dict.fromkeys(("straße", "strasse", "gasse", "allee", "platz"), "stem number"),
}


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Finder:
    """The parsers over one text; ``ends`` keeps how far each has come."""

    def __init__(self, text: str) -> None:
        self.text, self.found = text, []
        self.ends = dict.fromkeys((*KINDS, "dotted", "digits"), 0)

    def keep(self, kind: str, start: int, end: int) -> None:
        self.found.append(Span(start, KINDS.index(kind), end))

    def at_sign(self, at: int) -> None:
        start, least = at, self.ends["email"]
        while start > least and self.text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(self.text, at + 1) if start < at else None
        if domain:
            self.keep("email", start, domain.end())
            self.ends["email"] = domain.end()

    def dot(self, at: int) -> None:
        """A chain of numbers with dots between; every four in a row are one candidate."""
        if at < self.ends["dotted"]:
            return
        start, least = at, self.ends["dotted"]
        while start > least and self.text[start - 1] in DIGITS:
            start -= 1
        if start == at:
            return
        chain = DOTTED.match(self.text, start)
        self.ends["dotted"] = chain.end()
        parts = chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                self.keep("ip", start, start + size)
            start += size + 1

    def digit(self, at: int) -> None:
        if at < self.ends["digits"]:
            return
        run = SPACED_DIGITS.match(self.text, at)
        self.ends["digits"] = run.end() if run else at + 1
        if run:
            digits = run.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                self.keep("card", at, run.end())

    def plus(self, at: int) -> None:
        run = PHONE.match(self.text, at)
        if run and 9 <= sum(c in DIGITS for c in run.group()) <= 15:
            self.keep("phone", at, run.end())

    def scheme(self, at: int, end: int) -> None:
        user = USER.match(self.text, end)
        if user and at >= self.ends["login"]:
            self.keep("login", at, user.end())
            self.ends["login"] = user.end()

    def account(self, at: int, end: int) -> None:
        """An account number behind its cue word, or an IBAN there."""
        if at and self.text[at - 1].isalnum() or at < self.ends["account"]:
            return
        gap = re.compile(r"[\s:#=]{0,4}").match(self.text, end).end()
        long = IBAN.match(self.text, gap)
        # of what could belong to it, the longest part with right check digits
        while long and not iban(long.group()):
            shorter = long.group().rstrip()[:-1].rstrip()
            long = IBAN.fullmatch(self.text, gap, gap + len(shorter)) if len(shorter) >= 15 else None
        if long:
            self.keep("account", gap, long.end())
            self.ends["account"] = long.end()
            return
        number = NUMBER.match(self.text, end)
        if number:
            self.keep("account", number.start(1), number.end(1))
            self.ends["account"] = number.end(1)

    def street(self, at: int, end: int, form: str) -> None:
        text, least = self.text, max(self.ends["address"], at - REACH)
        if end < len(text) and text[end].isalpha():
            return
        span = None
        if form == "number name word":
            left = BEFORE.search(text[least:at])
            span = left and (least + left.start(), end)
        elif form == "number word name":
            left, right = NUMBERED.search(text[least : at + 1]), NAMES.match(text, end, end + REACH)
            span = left and right and (least + left.start(), right.end())
        elif form == "word name number":
            right = NAMES_AND_NUMBER.match(text, end, end + REACH) if not (at and text[at - 1].isalpha()) else None
            span = right and (at, right.end())
        else:
            left, right = STEM.search(text[least:at]), HOUSE.match(text, end, end + REACH)
            span = left and right and (least + left.start(), right.end())
        if span:
            self.keep("address", *span)
            self.ends["address"] = span[1]


def automaton():
    import ahocorasick

    words: dict[str, tuple] = {"@": ("at_sign",)}
    for d in "0123456789":
        words |= {d: ("digit",), "." + d: ("dot",), "+" + d: ("plus",)}
    words |= {s: ("scheme",) for s in SCHEMES}
    words |= {form: ("account",) for w in ACCOUNT_CUES for form in (w, w.capitalize(), w.upper())}
    words |= {w: ("street", form) for w, form in STREET_CUES.items()}
    out = ahocorasick.Automaton()
    for word, (parser, *rest) in words.items():
        out.add_word(word, (parser, len(word), *rest))
    out.make_automaton()
    return out


def spans(text: str, anchors) -> list[Span]:
    """All spans of a text, by start, then kind."""
    finder = Finder(text)
    for last, (parser, size, *rest) in anchors.iter(text):
        at = last - size + 1
        if parser in ("scheme", "account", "street"):
            getattr(finder, parser)(at, last + 1, *rest)
        else:
            getattr(finder, parser)(at)
    return sorted(finder.found)


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    anchors = automaton()
    for batch in slices(batches, "text"):
        sizes, kinds, starts, ends, values = [0], [], [], [], []
        for text in batch.column("text").to_pylist():
            for start, kind, end in spans(text, anchors) if text else ():
                kinds.append(KINDS[kind])
                starts.append(start)
                ends.append(end)
                values.append(text[start:end])
            sizes.append(len(kinds))
        flat = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())], ["kind", "start", "end", "value"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["doc_id", "spans"])


def _redact(batches: Iterator) -> Iterator:
    import pyarrow as pa

    anchors = automaton()
    for batch in slices(batches, "text"):
        out = [t and redacted(t, spans(t, anchors)) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def redacted(text: str, found: list[Span]) -> str:
    """The text with every stretch of overlapping spans replaced by the kind of its first one, in brackets."""
    out, last = [], 0
    for start, kind, end in found:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind]}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs(doc_id, text)``; a span is ``kind, start, end, value``, in code points, end exclusive.

    Spans are ordered by start, then by kind in the order of ``KINDS``; spans of
    different kinds may overlap. A null or empty text has an empty list. Repeated
    rows and ids are scanned one by one; other columns are ignored; an empty table
    gives no rows.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, "doc_id long, spans array<struct<kind: string, start: int, end: int, value: string>>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with personal data in ``text`` replaced by its kind in brackets; null texts stay null."""
    return map_arrow(docs, _redact, docs.schema)
