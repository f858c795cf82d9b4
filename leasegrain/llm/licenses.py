"""License scan by ordered signature rules.

Each rule is a regular expression with keywords, one of which must be in the text
before it is tried, a priority and a confidence. Runs of white space are one space
to both. Of overlapping detections one that lies
inside another of higher priority (or as high and longer) is suppressed. Four base
phrases are counted apart, word by word, and their labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from leasegrain.llm.common import map_arrow, slices

#: Base phrases and labels, as fixed by the contract of the scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, np.int8)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1

#: label | keywords | name as a pattern | SPDX id as a pattern | address as a pattern
FAMILIES = """
agpl | affero | gnu affero general public licen[cs]e | agpl-(?P<v>[\\d.]+) | gnu\\.org/licenses/agpl
lgpl | lesser | gnu lesser general public licen[cs]e | lgpl-(?P<v>[\\d.]+) | gnu\\.org/licenses/lgpl
lgpl | library general | gnu library general public licen[cs]e | lgpl-(?P<v>2[\\d.]*) | gnu\\.org/licenses/old-licenses/lgpl
gpl | general public | (?:gnu )?general public licen[cs]e | gpl-(?P<v>[\\d.]+) | gnu\\.org/licenses/gpl
gfdl | free documentation | gnu free documentation licen[cs]e | gfdl-(?P<v>[\\d.]+) | gnu\\.org/licenses/fdl
apache | apache | apache(?: software)? licen[cs]e | apache-(?P<v>[\\d.]+) | apache\\.org/licenses
mit | mit | mit licen[cs]e | mit\\b | opensource\\.org/licenses/mit
x11 | x11 | (?:mit/)?x11 licen[cs]e | x11\\b | opensource\\.org/licenses/x11
expat | expat | expat licen[cs]e | expat\\b | directory\\.fsf\\.org/wiki/license:expat
bsd | bsd | bsd(?: licen[cs]e|[- ][0234][- ]clause(?: licen[cs]e)?) | bsd-(?P<v>\\d)-clause | opensource\\.org/licenses/bsd
0bsd | zero | zero[- ]clause bsd(?: licen[cs]e)? | 0bsd\\b | opensource\\.org/licenses/0bsd
isc | isc | isc licen[cs]e | isc\\b | opensource\\.org/licenses/isc
mpl | mozilla | mozilla public licen[cs]e | mpl-(?P<v>[\\d.]+) | mozilla\\.org/(?:[a-z-]+/)?mpl
npl | netscape | netscape public licen[cs]e | npl-(?P<v>[\\d.]+) | mozilla\\.org/mpl/npl
epl | eclipse | eclipse public licen[cs]e | epl-(?P<v>[\\d.]+) | eclipse\\.org/legal/epl
edl | eclipse | eclipse distribution licen[cs]e | edl-(?P<v>[\\d.]+) | eclipse\\.org/org/documents/edl
cpl | common public | common public licen[cs]e | cpl-(?P<v>[\\d.]+) | opensource\\.org/licenses/cpl
ipl | ibm public | ibm public licen[cs]e | ipl-(?P<v>[\\d.]+) | opensource\\.org/licenses/ibmpl
cddl | common development | common development and distribution licen[cs]e | cddl-(?P<v>[\\d.]+) | opensource\\.org/licenses/cddl
cpal | common public attribution | common public attribution licen[cs]e | cpal-(?P<v>[\\d.]+) | opensource\\.org/licenses/cpal
eupl | european union | european union public licen[cs]e | eupl-(?P<v>[\\d.]+) | eupl\\.eu
cecill | cecill | cecill(?:-[abc])?(?: (?:free software )?licen[cs]e)? | cecill-(?P<v>[\\d.]+) | cecill\\.info/licen[cs]es
artistic | artistic | (?:perl )?artistic licen[cs]e | artistic-(?P<v>[\\d.]+) | opensource\\.org/licenses/artistic
afl | academic free | academic free licen[cs]e | afl-(?P<v>[\\d.]+) | opensource\\.org/licenses/afl
osl | open software | open software licen[cs]e | osl-(?P<v>[\\d.]+) | opensource\\.org/licenses/osl
apsl | apple public | apple public source licen[cs]e | apsl-(?P<v>[\\d.]+) | opensource\\.apple\\.com/apsl
rpl | reciprocal | reciprocal public licen[cs]e | rpl-(?P<v>[\\d.]+) | opensource\\.org/licenses/rpl
ms-pl | microsoft public | microsoft public licen[cs]e | ms-pl\\b | opensource\\.org/licenses/ms-pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | ms-rl\\b | opensource\\.org/licenses/ms-rl
psf | python | python(?: software foundation)? licen[cs]e | (?:psf|python)-(?P<v>[\\d.]+) | docs\\.python\\.org/[\\w/.]*license
php | php | php licen[cs]e | php-(?P<v>[\\d.]+) | php\\.net/license
ruby | ruby | ruby licen[cs]e | ruby\\b | ruby-lang\\.org/en/about/license
zlib | zlib | zlib(?:/libpng)? licen[cs]e | zlib\\b | zlib\\.net/zlib_license
libpng | libpng | libpng licen[cs]e | libpng(?:-(?P<v>[\\d.]+))? | libpng\\.org/pub/png/src/libpng-license
bsl | boost | boost software licen[cs]e | bsl-(?P<v>1[\\d.]*) | boost\\.org/license
busl | business source | business source licen[cs]e | busl-(?P<v>[\\d.]+) | mariadb\\.com/bsl
sspl | server side | server side public licen[cs]e | sspl-(?P<v>[\\d.]+) | mongodb\\.com/licensing/server-side
elastic | elastic | elastic licen[cs]e | elastic-(?P<v>[\\d.]+) | elastic\\.co/licensing/elastic-license
unlicense | unlicense | the unlicense | unlicense\\b | unlicense\\.org
wtfpl | wtfpl; do what the f | (?:do what the f\\S* you want to public licen[cs]e|wtfpl) | wtfpl\\b | wtfpl\\.net
cc0 | cc0; creative commons zero | (?:creative commons zero|cc0)(?: universal)? | cc0-(?P<v>[\\d.]+) | creativecommons\\.org/publicdomain/zero
cc-by-nc-nd | by-nc-nd; creative commons attribution | (?:cc by-nc-nd|creative commons attribution-non-?commercial-no-?derivatives) | cc-by-nc-nd-(?P<v>[\\d.]+) | creativecommons\\.org/licenses/by-nc-nd
cc-by-nc-sa | by-nc-sa; creative commons attribution | (?:cc by-nc-sa|creative commons attribution-non-?commercial-share-?alike) | cc-by-nc-sa-(?P<v>[\\d.]+) | creativecommons\\.org/licenses/by-nc-sa
cc-by-nc | by-nc; creative commons attribution | (?:cc by-nc(?!-)|creative commons attribution-non-?commercial(?!-)) | cc-by-nc-(?P<v>[\\d.]+) | creativecommons\\.org/licenses/by-nc/
cc-by-nd | by-nd; creative commons attribution | (?:cc by-nd|creative commons attribution-no-?derivatives) | cc-by-nd-(?P<v>[\\d.]+) | creativecommons\\.org/licenses/by-nd
cc-by-sa | by-sa; creative commons attribution | (?:cc by-sa|creative commons attribution-share-?alike) | cc-by-sa-(?P<v>[\\d.]+) | creativecommons\\.org/licenses/by-sa
cc-by | cc by; creative commons attribution | (?:cc by(?!-)|creative commons attribution(?!-)) | cc-by-(?P<v>[\\d.]+) | creativecommons\\.org/licenses/by/
odbl | open database | open (?:data commons open )?database licen[cs]e | odbl-(?P<v>[\\d.]+) | opendatacommons\\.org/licenses/odbl
odc-by | open data commons | open data commons attribution licen[cs]e | odc-by-(?P<v>[\\d.]+) | opendatacommons\\.org/licenses/by
pddl | public domain dedication | public domain dedication and licen[cs]e | pddl-(?P<v>[\\d.]+) | opendatacommons\\.org/licenses/pddl
ofl | open font | (?:sil )?open font licen[cs]e | ofl-(?P<v>[\\d.]+) | scripts\\.sil\\.org/ofl
ogl | open government | open government licen[cs]e | ogl-(?:uk-)?(?P<v>[\\d.]+) | nationalarchives\\.gov\\.uk/doc/open-government-licence
lppl | latex project | latex project public licen[cs]e | lppl-(?P<v>[\\d.]+) | latex-project\\.org/lppl
openrail | rail | (?:creativeml |bigcode )?open ?rail(?:-m)?(?: licen[cs]e)? | openrail\\b | licenses\\.ai
""".strip()
#: Template, priority and confidence of the rules that every family has.
SHAPES = (
    ("spdx-license-identifier:\\s*{spdx}", 100, 0.99),
    ("https?://(?:www\\.)?{address}[\\w./-]*?(?:(?P<v>\\d[\\d.]*\\d|\\d))?(?=[\\s)>\"',;]|[.]?$|[.]\\s|/)", 90, 0.95),
    ("(?:licen[cs]ed|released|distributed|available|published|provided)(?: only)? under (?:the )?(?:terms of )?(?:the )?{name}(?:,? (?:version |v)?(?P<v>\\d[\\d.]*\\d|\\d))?", 80, 0.95),
    ("{name},? (?:version |v\\.? ?)?(?P<v>\\d[\\d.]*\\d|\\d)", 70, 0.85),
    ("{name}", 50, 0.7),
)
#: Rules outside the families: label, keywords, pattern, priority, confidence.
OTHERS = (
    ("mit", "free of charge", "permission is hereby granted, free of charge, to any person obtaining a copy", 85, 0.97),
    ("mit", "without restriction", "deal in the software without restriction, including without limitation the rights", 84, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms, with or without modification", 85, 0.97),
    ("bsd-3", "endorse", "neither the name of (?:(?!neither the name of).)+? may be used to endorse or promote products", 86, 0.97),
    ("isc", "permission to use", "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 85, 0.95),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation", 86, 0.97),
    ("lgpl", "lesser", "under the terms of the gnu lesser general public license as published", 87, 0.97),
    ("agpl", "affero", "under the terms of the gnu affero general public license as published", 88, 0.97),
    ("gpl-or-later", "later version", "(?:either version [\\d.]+ of the license, or )?\\(?at your option\\)? any later version", 60, 0.6),
    ("apache-2.0", "in compliance", "you may not use this file except in compliance with the license", 84, 0.9),
    ("zlib", "as-is", "this software is provided 'as-is', without any express or implied warranty", 83, 0.9),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license", 86, 0.97),
    ("public-domain", "public domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain", 65, 0.8),
    ("public-domain", "public domain", "this (?:work|file|software) is in the public domain", 65, 0.8),
    ("all-rights-reserved", "all rights", "all rights reserved", 30, 0.5),
    ("copyright", "copyright", "copyright (?:\\(c\\) ?|© ?)?(?:19|20)\\d\\d", 20, 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 60, 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution) of this (?:file|software|document)", 60, 0.8),
    ("proprietary", "license agreement; licence agreement", "end[- ]user licen[cs]e agreement", 55, 0.7),
    ("non-commercial", "non-commercial; noncommercial", "for non-?commercial (?:use|purposes) only", 55, 0.7),
    ("research-only", "research; academic", "for (?:academic|research) (?:use|purposes) only", 55, 0.7),
)


class Rule(NamedTuple):
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def _spaced(pattern: str) -> bytes:
    """Words of a pattern may stand on different lines."""
    return re.sub(r"(?<![\\?\[]) (?![?*+])", r"\\s+", pattern).encode()


def _keywords(keys: str) -> tuple[bytes, ...]:
    return tuple(k.encode() for k in keys.split("; "))


def rules() -> list[Rule]:
    out = []
    for line in FAMILIES.splitlines():
        label, keys, name, spdx, address = (x.strip() for x in line.split(" | "))
        for shape, priority, confidence in SHAPES:
            own = spdx if "{spdx}" in shape else name
            text = shape.replace("{spdx}", spdx).replace("{name}", name).replace("{address}", address)
            need = "spdx" if "{spdx}" in shape else "://" if "{address}" in shape else keys
            edge = "" if own == spdx or "{address}" in shape else r"(?<![a-z0-9])"
            out.append(Rule(label, _keywords(need), re.compile(edge.encode() + _spaced(text)), priority, confidence))
    out += [Rule(label, _keywords(keys), re.compile(_spaced(text)), priority, confidence) for label, keys, text, priority, confidence in OTHERS]
    return sorted(out, key=lambda r: -r.priority)


RULES = rules()
KEYWORDS = sorted({k for r in RULES for k in r.keywords})
SPACES = re.compile(rb"\s+")


class Detection(NamedTuple):
    start: int
    stop: int
    label: str
    priority: int
    confidence: float


def detect(low: bytes) -> list[Detection]:
    """Detections of a lowered text with single spaces, after suppression, in order of place. A rule none of whose keywords is there is not tried."""
    there = {k for k in KEYWORDS if k in low}
    found = []
    for rule in RULES:
        if not there.isdisjoint(rule.keywords):
            for m in rule.pattern.finditer(low):
                version = (m.groupdict().get("v") or b"").decode("latin-1").strip(".")
                version = version[:-2] if version.endswith(".0") and rule.label.endswith("gpl") else version
                found.append(Detection(m.start(), m.end(), f"{rule.label}-{version}" if version else rule.label, rule.priority, rule.confidence))
    found.sort(key=lambda d: (-d.priority, d.start - d.stop, d.start, d.label))
    kept: list[Detection] = []
    for d in found:
        if not any(k.start <= d.start and d.stop <= k.stop for k in kept):
            kept.append(d)
    return sorted(kept)


#: Texts without any of these hold no detection and no base phrase.
GATE = re.compile(rb"licen[cs]|copyright|spdx|public domain|proprietary|all rights|unauthorized|://|cc0?(?![a-z0-9])|bsd|cecill|rail|wtfpl|permission|redistribution|commercial|research|academic|as-is|later version|endorse|restriction|creative commons")


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of a whole text."""
    low = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    inside = _IN_WORD[np.frombuffer(low, np.uint8)]
    n_words = int(np.count_nonzero(np.diff(inside, prepend=np.int8(0)) == 1))
    low = SPACES.sub(b" ", low)
    if not GATE.search(low):
        return n_words, 0, None, None, "", "", 0.0
    line = b" " + b" ".join(WORD.findall(low)) + b" "
    starts, base = [], set()
    for phrase, label in BASE.items():
        needle, at = f" {phrase} ".encode(), -1
        while (at := line.find(needle, at + 1)) >= 0:
            starts.append(at)
            base.add(label)
    words = []
    if starts:
        before = np.cumsum(np.frombuffer(line, np.uint8) == 32)
        words = (before[np.array(starts)] - 1).tolist()
    found = detect(low)
    labels = base | {d.label for d in found}
    doubt = 1.0
    for sure in {d.label: d.confidence for d in sorted(found, key=lambda d: d.confidence)}.values():
        doubt *= 1 - sure
    doubt *= 0.1 if base else 1.0
    first, last = (min(words), max(words)) if words else (None, None)
    return n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - doubt


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for batch in slices(batches, "text"):
        found = [scan(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(zip(*found), kinds)]], [*batch.schema.names, *names])


def with_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``scan``; columns of these names are replaced.

    Null texts are empty: no words, no labels, score 0. Whole texts are read, each
    row by itself, so repeated rows give repeated results and an empty table none.
    """
    clear = docs.drop(*[f.split()[0] for f in FIELDS.split(", ")])
    return map_arrow(clear, _scan, StructType([*clear.schema.fields, *_parse_datatype_string(FIELDS).fields]))
