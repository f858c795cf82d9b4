"""Benchmark passages in documents, also with other numbers, names or units.

Texts become templates: numbers, units and names turn into typed placeholders, runs
of one type into one; beside them stand the literal tokens. Windows of template tokens meet in a hash join; windows of one
alignment must fill the slots consistently (an item's value always stands for the
same document value). An item is found where its windows are contained in a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrain.llm.common import map_arrow, slices
from leasegrain.session import staged

WINDOW, LITERALS, CONTAINED, RUN = 5, 3, 0.8, 9
#: The filter of window hashes has at most so many bits; beyond, it only lets more through to the join.
FILTER_BITS, SALTS = 28, 16
NUM, UNIT, NAME = 1, 2, 3
#: Forms in which an item is asked for: its template, the one without names, that of an item of mostly capitalised words, its literal tokens.
TYPED, NAMELESS, CAPITAL, LITERAL = range(4)
LITERAL_SEED, EDGE = np.uint64(1 << 32), "\x01"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half quarter dozen"
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers inch inches foot feet yard yards g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules newton newtons hz khz mhz ghz kb mb gb tb"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!:\n"]] = True
_IN_NUMBER = np.frombuffer(b".,/:-", np.uint8)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
CHUNK = 1 << 16
#: Bytes of text whose tokens are worked on at once; they take some 60 times their size.
SLICE = 1 << 20


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def token_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the lowered tokens; long texts go in stretches, as powers wrap the same everywhere."""
    out = np.zeros(len(starts), np.uint64)
    # reduceat over value * BASE ** (place within the token)
    values = _LOWER[b] + np.uint64(1)
    sizes = ends - starts
    longest = int(sizes.max())
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(min(longest, CHUNK), BASE)]))
    for k in range(0, len(starts), CHUNK):
        s, n = starts[k : k + CHUNK], sizes[k : k + CHUNK]
        total = int(n.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        flat = values[np.repeat(s, n) + inner] * powers[inner % len(powers)]
        out[k : k + CHUNK] = np.add.reduceat(flat, np.cumsum(n) - n)
    return scramble(out)


def _of_words(words: str) -> np.ndarray:
    out = []
    for w in words.split():
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(token_hashes(b, np.array([0]), np.array([len(b)]))[0])
    return np.array(sorted(out), np.uint64)


_NUMBERS, _UNITS = _of_words(NUMBER_WORDS), _of_words(UNITS)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def together(texts) -> tuple[bytes, np.ndarray]:
    """UTF-8 of the texts of an Arrow array (null: empty), a line end apart, and where each one begins."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts)
    data = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_buffer().to_pybytes()
    return data, np.cumsum(sizes + 1) - sizes - 1


class Tokens:
    """Tokens of the texts of an Arrow array and the templates made of them; ``capital``: most words of a text have a capital,
    so case tells nothing there. ``names``: whether a text has any. Tokens of all texts are worked on at once."""

    def __init__(self, texts):
        self.data, begin = together(texts)
        self.bytes, n = np.frombuffer(self.data, np.uint8), len(texts)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[self.bytes], [False]]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hash, self.kind, self.text = np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, np.int64)
        self.capital, self.names = np.zeros(n, bool), np.zeros(n, bool)
        if not len(self.starts):
            return
        b, starts, ends = self.bytes, self.starts, self.ends
        h = token_hashes(b, starts, ends)
        upper = _UPPER[b[starts]]
        self.hash, self.kind = h, np.zeros(len(h), np.int8)
        counts = np.diff(np.searchsorted(starts, begin), append=len(starts))
        self.text = np.repeat(np.arange(n), counts)
        self.capital = 2 * np.bincount(self.text[upper], minlength=n) > counts
        stops = np.concatenate([[0], np.cumsum(_STOP[b])])  # the line end between two texts is one
        first = np.concatenate([[True], stops[starts[1:]] > stops[ends[:-1]]])
        self.kind[upper & ~first & ~self.capital[self.text]] = NAME
        self.kind[among(h, _UNITS)] = UNIT
        digits = np.concatenate([[0], np.cumsum(_DIGIT[b])])
        self.kind[(digits[ends] > digits[starts]) | among(h, _NUMBERS)] = NUM
        self.names[self.text[self.kind == NAME]] = True

    def template(self, names: bool = True) -> Template:
        h, starts, ends = self.hash, self.starts, self.ends
        if not len(h):
            return Template(self.data, h, self.kind, starts, ends, self.text)
        kind = self.kind if names else np.where(self.kind == NAME, 0, self.kind)
        # a run of one type is one slot only where nothing but a space, or the sign inside a number, parts it
        inner = self.bytes[ends[:-1]]
        joined = (starts[1:] - ends[:-1] == 1) & ((inner == 32) | (kind[1:] == NUM) & np.isin(inner, _IN_NUMBER))
        new = np.concatenate([[True], (kind[1:] == 0) | (kind[1:] != kind[:-1]) | ~joined])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(h)]]) - 1
        return Template(self.data, np.where(kind[at] == 0, h[at], kind[at].astype(np.uint64)), kind[at], starts[at], ends[last], self.text[at])

    def literal(self) -> Template:
        return Template(self.data, self.hash, np.zeros(len(self.hash), np.int8), self.starts, self.ends, self.text, LITERAL_SEED)


class Template:
    """Tokens of templates: ``hash``, ``kind`` (0: literal), the byte span each one covers and the ``text`` it is of."""

    def __init__(self, data: bytes, hash: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, seed: np.uint64 = np.uint64(0)):
        self.data, self.hash, self.kind, self.starts, self.ends, self.text, self.seed = data, hash, kind, starts, ends, text, seed

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` tokens, and which of them are of one text and have enough literals to mean something."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.full(n, np.uint64(size) + self.seed)
        for k in range(size):
            out = scramble(out * BASE + self.hash[k : k + n])
        literals = np.concatenate([[0], np.cumsum(self.kind == 0)])
        return out, (literals[size:] - literals[:-size] >= min(LITERALS, size)) & (self.text[:n] == self.text[size - 1 :])

    def slots(self, at: int, size: int, ends: bool = False) -> list[str]:
        """Type and filling of every slot of a window, in order; with ``ends`` the first and last slot of a single text are
        marked, as their runs may go on outside the passage."""
        return [
            f"{EDGE if ends and k in (0, len(self.kind) - 1) else ''}{self.kind[k]}{self.data[self.starts[k] : self.ends[k]].decode('utf-8', 'replace').lower()}"
            for k in range(at, at + size)
            if self.kind[k]
        ]


ITEM_WINDOWS = "item_id long, form int, size int, place long, hash long, slots array<string>, n_windows long"
DOC_WINDOWS = "doc_id long, text_key long, view int, size int, place long, hash long, slots array<string>"


def _emit(names: list[str], columns: list[list], kinds: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _item_windows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()]
    for batch in slices(batches, "text"):
        columns: list[list] = [[] for _ in kinds]
        for k, item in enumerate(batch.column("item_id").to_pylist()):
            tokens = Tokens(batch.column("text").slice(k, 1))
            forms = [(CAPITAL if tokens.capital[0] else TYPED, tokens.template()), (LITERAL, tokens.literal())]
            if tokens.names[0]:
                forms.append((NAMELESS, tokens.template(names=False)))
            for form, t in forms:
                size = min(WINDOW, len(t.hash))
                if not size:
                    continue
                hashes, enough = t.windows(size)
                places = np.flatnonzero(enough)
                for at in places.tolist():
                    for c, v in zip(columns, (item, form, size, at, int(hashes[at].astype(np.int64)), t.slots(at, size, True), len(places))):
                        c.append(v)
        yield _emit(["item_id", "form", "size", "place", "hash", "slots", "n_windows"], columns, kinds)


def item_windows(items: DataFrame) -> DataFrame:
    return map_arrow(items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(), _item_windows, ITEM_WINDOWS)


def window_filter(windows: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """A bitmap of the windows' hashes, of bounded size whatever the benchmark holds, and the window sizes in use in each form."""
    n = max(1, windows.count())
    bits = min(FILTER_BITS, max(16, int(16 * n).bit_length()))
    marks = np.zeros(1 << bits >> 3, np.uint8)
    for row in windows.select("hash").toLocalIterator(prefetchPartitions=True):
        at = (row[0] & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
        marks[at >> 3] |= 1 << (at & 7)
    sizes: dict[int, list[int]] = {}
    for form, size in sorted(windows.select("form", "size").distinct().collect()):
        sizes.setdefault(form, []).append(size)
    return marks, sizes


def _held(batch, marks: np.ndarray, sizes: dict[int, list[int]]) -> Iterator:
    """The windows of a batch's texts whose bit is set in ``marks``, with their slots; all texts of the batch at once."""
    import pyarrow as pa

    tokens = Tokens(batch.column("text"))
    shift = np.uint64(64 - (len(marks) * 8).bit_length() + 1)
    typed = sorted({x for form, found in sizes.items() if form != LITERAL for x in found})
    views = [(TYPED, tokens.template(), typed), (LITERAL, tokens.literal(), sizes.get(LITERAL, []))]
    if CAPITAL in sizes and tokens.names.any():
        views.append((NAMELESS, tokens.template(names=False), sizes[CAPITAL]))
    for view, t, wanted in views:
        begin = np.searchsorted(t.text, np.arange(batch.num_rows))
        for size in wanted:
            hashes, enough = t.windows(size)
            bit = hashes >> shift
            seen = (marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            if view == NAMELESS:  # other texts have this template as the typed one
                enough &= tokens.names[t.text[: len(enough)]]
            places = np.flatnonzero(enough & (seen == 1))
            for k in range(0, len(places), 20_000):
                at = places[k : k + 20_000]
                text = t.text[at]
                constant = lambda v: pa.array(np.full(len(at), v, np.int32))
                slots = [t.slots(x, size) for x in at.tolist()] if t.kind.any() else [[]] * len(at)
                columns = [*[batch.column(c).take(pa.array(text)) for c in ("doc_id", "text_key")], constant(view), constant(size)]
                columns += [pa.array(at - begin[text]), pa.array(hashes[at].view(np.int64)), pa.array(slots, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "view", "size", "place", "hash", "slots"])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text_key, item_id, windows, n_windows, contained, slots_changed`` of every document that holds an item.

    ``docs(doc_id, text)``, ``items(item_id, text)``; ``text_key`` tells rows of one
    id apart. An item is held if 0.8 of its windows stand in the document, or a run of
    9 windows (13 tokens), of its template or of its literal lowered tokens; windows
    whose slots conflict in an alignment do not count. The best form is given. Null and
    empty texts hold nothing and, as items, are in nothing; items of fewer than five
    tokens are one window. Repeated rows give one result per id and text. Template
    windows of mostly placeholders are not compared, as they would fit anything; such
    an item is found by its literal tokens only. Extra columns
    are ignored; empty tables give no rows.
    """
    asked = staged(item_windows(items), "item-windows")
    marks, sizes = window_filter(asked)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((marks, sizes))

    def run(batches: Iterator) -> Iterator:
        for batch in slices(batches, "text", SLICE):
            yield from _held(batch, *shared.value)

    held = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"), run, DOC_WINDOWS)
    # a passage may stand in a third of all documents: its windows are spread over salts
    held = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d, i = held.alias("d"), spread.alias("i")
    pairs = d.join(i, ["hash", "size", "salt"]).select(
        "doc_id",
        "text_key",
        "item_id",
        "form",
        "view",
        "n_windows",
        F.col("i.place").alias("place"),
        (F.col("d.place") - F.col("i.place")).alias("shift"),
        F.arrays_zip(F.col("i.slots").alias("item"), F.col("d.slots").alias("doc")).alias("slots"),
    )
    whole = ["doc_id", "text_key", "item_id", "form", "n_windows"]
    aligned = pairs.groupBy(*whole, "view", "shift").agg(F.collect_set(F.struct("place", "slots")).alias("all"))
    # windows with an item's value that stands for several values of the document do not count
    aligned = aligned.withColumn("fill", F.expr("array_distinct(flatten(transform(all, w -> w.slots)))"))
    aligned = aligned.withColumn("values", F.expr("transform(fill, x -> x.item)"))
    clash = F.expr("if(size(array_distinct(values)) = size(values), array(), filter(array_distinct(values), v -> size(filter(values, x -> x = v)) > 1))")
    aligned = aligned.withColumn("clash", clash).withColumn("all", F.expr("filter(all, w -> not exists(w.slots, x -> array_contains(clash, x.item)))"))
    aligned = aligned.where(F.size("all") > 0).select(
        *whole, F.expr("transform(all, w -> w.place)").alias("places"), F.expr("flatten(transform(all, w -> w.slots))").alias("slots")
    )
    runs = F.expr(
        """aggregate(array_sort(places), struct(-2L as last, 0 as n, 0 as best),
           (s, p) -> struct(p as last, if(p = s.last + 1, s.n + 1, 1) as n, greatest(s.best, if(p = s.last + 1, s.n + 1, 1)) as best), s -> s.best)"""
    )
    changed = F.expr(f"exists(slots, x -> ltrim('{EDGE}', x.item) <> x.doc)")
    found = aligned.select(*whole, "places", runs.alias("run"), changed.alias("changed")).groupBy(*whole).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("windows"),
        F.max("run").alias("run"),
        F.max("changed").alias("slots_changed"),
    )
    found = found.where((F.col("windows") >= CONTAINED * F.col("n_windows")) | (F.col("run") >= RUN))
    contained = (F.col("windows") / F.col("n_windows")).alias("contained")
    best = F.max(F.struct(contained, (~F.col("slots_changed")).alias("same"), "windows", "n_windows")).alias("best")
    return found.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", "best.windows", "best.n_windows", "best.contained", (~F.col("best.same")).alias("slots_changed")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows are told apart by id and text."""
    bad = matches(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    same = (F.xxhash64(docs["text"]) == F.col("_key")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_doc"))
    return docs.join(bad, same, "left_anti")
