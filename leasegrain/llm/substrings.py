"""Repeated substrings by external induced suffix sorting.

Only sampled suffixes are sorted outright: every string of ``LENGTH`` bytes has an
*anchor*, the leftmost place in it whose ``GRAM``-byte hash is least, at the same
offset wherever the string stands. Occurrences of one anchor that stands nowhere
else cannot begin a repeat and are left out. Spark's external sort orders the others
by anchor and by the bytes from it on, and streams them with the common prefix of
neighbours. The suffixes left of the anchors are then induced byte by byte: order
``o + 1`` follows from order ``o`` by a stable pass over the preceding byte, and
common prefixes from range minima. A string is repeated where a neighbour in that
order shares ``LENGTH`` bytes.

Passages of ``PASSAGE`` words are sampled alike, by the least hash of their runs of
``RUN`` words, and only marked.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.llm.common import join_counted, map_arrow, slices
from leasegrain.llm.decontamination import BASE as WORD_BASE
from leasegrain.llm.decontamination import scramble, token_hashes
from leasegrain.session import staged

LENGTH, GRAM = 400, 32
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words of a passage, and of a run of words by whose least hash passages are first compared.
PASSAGE, RUN = 50, 16
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes of a text looked at together; a longer text goes in stretches.
STRETCH = 1 << 22
#: Rows induced together; a larger group of one anchor is a batch of its own.
BATCH = 60_000
#: Bytes left of the anchors that a batch keeps in memory; beyond, they are in a file of the task.
HELD = 96 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        down = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, 1 << 16)
        _POWERS[0] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x)])) for x in (BASE, down))
    return _POWERS[0]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    up, down = powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1]
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima within blocks in both directions."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchors(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hash, place, first, last``: each anchor with the range of string starts that it stands for."""
    found = []
    low = np.uint64((1 << 24) - 1)
    for start in range(0, max(0, len(b) - length + 1), STRETCH):
        part = b[start : start + STRETCH + length - 1]
        h = gram_hashes(part)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_least(key, length - GRAM + 1) & low).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([cut[1:], [len(place)]]) - 1
        found.append((h[place[cut]], place[cut] + start, cut + start, last + start))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


class Lefts:
    """The bytes before each anchor, last one first, one after the other; on disk when there are many."""

    def __init__(self):
        self.held, self.file, self.sizes = [], None, []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.held.append(data[::-1])
        self.sizes.append(len(data))
        self.size += len(data)
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(b"".join(self.held))
            self.held, self.size = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.held) or b"\0", np.uint8)
        self.file.write(b"".join(self.held))
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def thinned(shared: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Common prefixes between the kept rows: least of those between them and the rows left out."""
    return np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))


def induce(prefix: np.ndarray, left: np.ndarray, n_left: np.ndarray, least: np.ndarray, length: int = LENGTH):
    """Yields ``rows, o``: the rows whose string starting ``o`` bytes before the anchor is repeated, by rising ``o``.

    Rows come ordered by the bytes from the anchor on, groups one after the other;
    ``prefix`` is the common prefix with the row before (-1 at the start of a group),
    ``left`` the reversed bytes before the anchors, ``n_left`` how many each row has,
    ``least`` the first ``o`` that is a row's own.
    """
    order, shared = np.arange(len(prefix)), prefix.astype(np.int64)
    offset = np.cumsum(n_left) - n_left
    for o in range(int(n_left.max(initial=-1)) + 1):
        if o:
            live = n_left[order] >= o
            if not live.all():
                kept = np.flatnonzero(live)
                if not len(kept):
                    return
                shared, order = thinned(shared, kept), order[kept]
            char = left[offset[order] + o - 1].astype(np.int64)
            # a new block where neighbours can't come to share enough by any later offset
            far = int(n_left[order].max()) - (o - 1)
            block = np.cumsum(shared < length - far)
            if (np.diff(block) != 0).sum() == 0 and (char == char[0]).all():
                shared = np.where(np.arange(len(shared)) == 0, -1, shared + 1)
            else:
                by = np.argsort(block * 256 + char, kind="stable")
                same = (np.diff(block[by]) == 0) & (np.diff(char[by]) == 0)
                ends = np.empty(2 * len(by) - 2, np.int64)
                ends[::2], ends[1::2] = by[:-1] + 1, by[1:] + 1
                # pairs that do not belong together get a range of one
                ends[::2] = np.where(same, ends[::2], ends[1::2])
                least_between = np.minimum.reduceat(np.append(shared, 0), ends)[::2] if len(ends) else np.empty(0, np.int64)
                shared = np.concatenate([[-1], np.where(same, least_between + 1, -1)])
                order = order[by]
        near = np.maximum(shared, np.append(shared[1:], -1))
        # rows that share too little with both neighbours to be repeated at any later offset
        hopeful = near >= length - (int(n_left[order].max()) - o)
        seen = (near >= length) & (least[order] <= o)
        if seen.any():
            yield order[seen], o
        if not hopeful.all():
            kept = np.flatnonzero(hopeful)
            if not len(kept):
                return
            shared, order = thinned(shared, kept), order[kept]


def runs(marks: Iterator, n: int):
    """``row, from, to``: maximal runs of consecutive offsets of each row."""
    start, last, out = np.full(n, -1), np.full(n, -2), []
    for rows, o in marks:
        new = rows[last[rows] != o - 1]
        old = new[start[new] >= 0]
        if len(old):
            out.append((old, start[old], last[old]))
        start[new] = o
        last[rows] = o
    rest = np.flatnonzero(start >= 0)
    out.append((rest, start[rest], last[rest]))
    return [np.concatenate(x) for x in zip(*out)]


ANCHORS = "doc_id long, key long, hash long, place int, first int, last int, times int"
CONTEXTS = "doc_id long, key long, hash long, right binary, left binary, place int, least int, begin int, stop int"
SPANS = "doc_id long, key long, begin int, stop int"


def _batch(schema: str, columns: list):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _anchors(batches: Iterator) -> Iterator:
    for batch in slices(batches, "text"):
        out: list[list] = [[] for _ in range(7)]
        for doc, key, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "key", "text")]):
            h, place, first, last = anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
            _, where, times = np.unique(h, return_inverse=True, return_counts=True)
            for c, v in zip(out, ([doc] * len(h), [key] * len(h), h.astype(np.int64).tolist(), place.tolist(), first.tolist(), last.tolist(), times[where].tolist())):
                c.extend(v)
        yield _batch(ANCHORS, out)


def _contexts(batches: Iterator) -> Iterator:
    """Candidate anchors with the bytes around them. Contexts that a task meets again are repeats and are passed on once.

    Rows without bytes are spans already found; they go along, spread by their text.
    """
    met: dict[bytes, tuple | None] = {}
    for batch in slices(batches, "text"):
        out: list[list] = [[] for _ in range(9)]
        for doc, key, text, asked in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "asked")]):
            data = text.encode("utf-8", "surrogatepass")
            for x in asked:
                place, first, last = x["place"], x["first"], x["last"]
                around = data[first : last + LENGTH]
                mark = hashlib.blake2b(around, digest_size=16, salt=(place - first).to_bytes(4, "big")).digest()
                if mark in met:
                    # twice the same: both are repeated from end to end
                    for d, k, begin, stop in filter(None, (met[mark], (doc, key, first, last + LENGTH))):
                        for c, v in zip(out, (d, k, k, None, None, None, None, begin, stop)):
                            c.append(v)
                    met[mark] = None
                    continue
                met[mark] = (doc, key, first, last + LENGTH)
                for c, v in zip(out, (doc, key, x["hash"], data[place : last + LENGTH], data[first:place], place, place - last, None, None)):
                    c.append(v)
            if len(met) > 150_000:
                met.clear()
        if out[0]:
            yield _batch(CONTEXTS, out)


def _repeats(batches: Iterator) -> Iterator:
    """Contexts in order of anchor and right bytes in, repeated spans out."""

    def work(docs, keys, places, least, prefix, lefts):
        n = len(docs)
        row, begin, end = runs(induce(np.array(prefix), lefts.array(), np.array(lefts.sizes, np.int64), np.array(least, np.int64)), n)
        at = np.array(places, np.int64)[row]
        return _batch(SPANS, [[docs[k] for k in row], [keys[k] for k in row], (at - end).tolist(), (at - begin + LENGTH).tolist()])

    def empty():
        return [], [], [], [], [], Lefts()

    held, before, right = empty(), None, b""
    for batch in batches:
        ready = batch.filter(batch.column("right").is_null())
        if ready.num_rows:
            yield _batch(SPANS, [ready.column(c) for c in ("doc_id", "key", "begin", "stop")])
        batch = batch.filter(batch.column("right").is_valid())
        for doc, key, h, now, left, place, least in zip(
            *[batch.column(c).to_pylist() for c in ("doc_id", "key", "hash", "right", "left", "place", "least")]
        ):
            if h != before and len(held[0]) >= BATCH:
                yield work(*held)
                held = empty()
            docs, keys, places, leasts, prefix, lefts = held
            docs.append(doc)
            keys.append(key)
            places.append(place)
            leasts.append(least)
            prefix.append(common(right, now) if h == before else -1)
            lefts.add(left)
            before, right = h, now
    if held[0]:
        yield work(*held)


def _removed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, "text"):
        columns: list[list] = [[] for _ in range(5)]
        for doc, key, text, spans in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "spans")]):
            data, merged = text.encode("utf-8", "surrogatepass"), []
            for x in sorted((s["begin"], s["stop"]) for s in spans):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            digest, at = hashlib.sha256(), 0
            for begin, stop in merged:
                digest.update(data[at:begin])
                at = stop
            digest.update(data[at:])
            for c, v in zip(columns, (doc, key, sum(b - a for a, b in merged), len(merged), digest.hexdigest())):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "key", "n_removed", "n_spans", "kept_sha256"])


def passage_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every ``PASSAGE`` consecutive words (ASCII letters lowered), the hash and the least hash of its runs of ``RUN`` words."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~SPACES[b], [False]]).astype(np.int8)))
    if len(edge) < 2 * PASSAGE:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    words = token_hashes(b, edge[::2], edge[1::2])

    def rolled(h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(h) - size + 1, np.uint64(size))
        for k in range(size):
            out = scramble(out * WORD_BASE + h[k : k + len(out)])
        return out

    runs_ = rolled(words, RUN)
    # runs that overlap cover the passage
    starts = [*range(0, PASSAGE - RUN, RUN), PASSAGE - RUN]
    n = len(words) - PASSAGE + 1
    out = np.full(n, np.uint64(PASSAGE))
    for k in starts:
        out = scramble(out * WORD_BASE + runs_[k : k + n])
    return out, sliding_least(runs_, PASSAGE - RUN + 1)


def _least_runs(batches: Iterator) -> Iterator:
    met: set[int] = set()
    for batch in slices(batches, "text", 1 << 20):
        keys, found = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if key in met:
                continue  # a copy
            if len(met) < 150_000:
                met.add(key)
            keys.append(key)
            found.append(np.unique(passage_hashes(text)[1]).view(np.int64))
        if keys:
            yield _batch("hash long, key long", [np.concatenate(found), np.repeat(np.array(keys, np.int64), [len(x) for x in found])])


def _passages(batches: Iterator) -> Iterator:
    for batch in slices(batches, "text", 1 << 20):
        keys, found = batch.column("key").to_pylist(), []
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
            hashes, least = passage_hashes(text)
            found.append(np.unique(hashes[np.isin(least, np.array(asked, np.int64).view(np.uint64))]).view(np.int64))
        yield _batch("hash long, key long", [np.concatenate(found), np.repeat(np.array(keys, np.int64), [len(x) for x in found])])


def shared_passages(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``key`` of the ``texts(doc_id, key, text)`` with ``PASSAGE`` consecutive words that also stand in another row.

    ``groups(doc_id, key, copies)`` has one row of each text. Equal passages have the
    same least run, so only passages whose least run stands in several texts are compared.
    """
    several = lambda rows: rows.groupBy("hash").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("hash")
    found = staged(map_arrow(texts.select("key", "text"), _least_runs, "hash long, key long"), "least-runs")
    asked = found.join(several(found), "hash", "left_semi").groupBy("key").agg(F.collect_set("hash").alias("asked"))
    asked = asked.join(groups.select("doc_id", "key"), "key")
    first = texts.join(asked, texts["doc_id"].eqNullSafe(asked["doc_id"]) & (texts["key"] == asked["key"])).select(texts["key"], "text", "asked")
    passages = map_arrow(first, _passages, "hash long, key long").repartition("hash").distinct()
    ends = Window.partitionBy("hash")
    marked = passages.withColumn("low", F.min("key").over(ends)).withColumn("high", F.max("key").over(ends))
    copied = found.join(groups.where("copies > 1").select("key"), "key", "left_semi").select("key")
    return marked.where("low <> high").select("key").union(copied).distinct()


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``known, groups, texts, spans``: all rows by digest, copies, the texts that may hold repeats and their repeated byte spans.

    Spans may overlap. A text is known by its id and a 64-bit hash of itself.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    known = staged(
        texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")),
        "text-digests",
    )
    groups = known.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.max("n_bytes").alias("n_bytes")
    )
    groups = staged(groups.select("digest", "copies", "n_bytes", "first.doc_id", "first.key"), "text-groups")
    long = texts.where(F.octet_length("text") >= LENGTH).select("doc_id", "key", "text")
    found = staged(map_arrow(long, _anchors, ANCHORS), "anchors")
    # copies of one text have one key and do not make an anchor repeated
    often = found.groupBy("hash").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("times").alias("times"))
    often = often.where("low <> high or times > 1").select("hash")
    one = groups.where(F.col("n_bytes") >= LENGTH).select("doc_id", "key")
    asked = found.join(often, "hash", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "first", "last", "hash")).alias("asked"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    asked = asked.join(one, same(asked, one), "left_semi")
    hold = long.join(asked, same(long, asked)).select(long["doc_id"], long["key"], "text", "asked")
    hold = staged(hold, "texts")
    contexts = map_arrow(hold, _contexts, CONTEXTS).repartition("hash").sortWithinPartitions("hash", "right")
    spans = map_arrow(contexts, _repeats, SPANS)
    return known, groups, hold.select("doc_id", "key", "text"), spans


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs(doc_id, text)``.

    With ``passages`` also ``shares_passage``: whether ``PASSAGE`` consecutive words, of any
    number of bytes, stand in another row too. Such words alone are not removed.

    A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere
    else, in this text or another; strings are judged on the input. Copies of whole
    texts of that length lose everything. Null counts as empty, shorter texts lose
    nothing, repeated rows are copies, an empty table gives no rows. Other columns
    are ignored.
    """
    known, groups, hold, spans = repeated_spans(docs)
    single = groups.where("copies = 1").select("doc_id", "key")
    listed = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    listed = listed.join(single, same(listed, single), "left_semi")
    cut = map_arrow(hold.join(listed, same(hold, listed)).select(hold["doc_id"], hold["key"], "text", "spans"), _removed, "doc_id long, key long, n_removed long, n_spans long, kept_sha256 string")
    cut = staged(cut, "cut-texts")
    also = []
    if passages:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
        shared = staged(shared_passages(texts, groups), "sharing").withColumn("shares_passage", F.lit(True))
        groups, also = groups.join(shared, "key", "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(False))), ["shares_passage"]
    rows = join_counted(known.drop("n_bytes"), groups.select("digest", "copies", "n_bytes", *also), "digest", "copies", known.count())
    gone = F.col("copies") > 1
    gone = gone & (F.col("n_bytes") >= LENGTH)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(cut, same(rows, cut), "left").select(
        rows["doc_id"],
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, none).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *also,
    )
