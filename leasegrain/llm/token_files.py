"""Token ids of whole documents in range-coded files (rANS).

A file row is a *segment*: consecutive documents in ascending ``doc_id`` order,
coded with one static frequency table that all its blocks share. A block is
coded by itself over interleaved lanes (symbol ``i`` belongs to lane ``i % lanes``)
into one stream of 32-bit words. Checkpoints hold the lane states and the word
position every ``CHECK`` symbols with a CRC-32 of the symbols up to the next, so
any stretch decodes without what precedes it and damage is found.

Segment layout, little-endian: ``MAGIC``, the length of a JSON header, the
header, then the sections it names one after the other.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leasegrain.llm.common import map_arrow, slices

MAGIC = b"LGRANS01"
#: Lanes of a block, symbols of a block and between two checkpoints, ids of a segment.
LANES, BLOCK, CHECK, SEGMENT = 2048, 1 << 20, 1 << 19, 4 << 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


def shares(counts: np.ndarray, bits: int) -> np.ndarray:
    """Integer frequencies of at least 1 that sum to ``2 ** bits``, near the given counts."""
    whole = 1 << bits
    out = np.maximum(1, counts.astype(np.float64) * whole / counts.sum()).astype(np.int64)
    while (over := int(out.sum()) - whole) > 0:
        room = out - 1
        out -= np.minimum(room, -(-room * over // max(1, int(room.sum()))))
    out[int(np.argmax(out))] += whole - int(out.sum())
    return out


class Model:
    """The frequency table of a segment: sorted symbols with their frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int):
        self.symbols, self.bits = symbols.astype(np.uint32), bits
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(freq) - freq).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Model:
        counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        for k in range(0, len(ids), BLOCK):  # numpy counts and looks up in 64 bits, so by blocks
            counts += np.bincount(ids[k : k + BLOCK], minlength=len(counts))
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        bits = max(20, int(len(symbols)).bit_length() + 2)
        return cls(symbols, shares(counts, bits), bits)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ranks: np.ndarray, model: Model, lanes: int) -> tuple[list, np.ndarray]:
    """Checkpoints ``(first symbol, word position, lane states)`` and the words of one block."""
    bits, steps = np.uint64(model.bits), -(-len(ranks) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    limit = model.freq << np.uint64(63 - model.bits)
    words, marks, every = [], [], max(1, CHECK // lanes)
    for step in range(steps - 1, -1, -1):
        s = ranks[step * lanes : (step + 1) * lanes]
        x, f = state[: len(s)], model.freq[s]
        full = x >= limit[s]
        if full.any():
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> WORD, x)
        else:
            words.append(np.empty(0, np.uint32))
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + model.first[s]
        if step % every == 0:
            marks.append((step, state.copy()))
    words.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    checks = [(step * lanes, int(at[step]), s) for step, s in reversed(marks)]
    return checks, np.concatenate(words) if words else np.empty(0, np.uint32)


def decode_stretch(state: np.ndarray, words: np.ndarray, n: int, model: Model, slots: np.ndarray) -> np.ndarray:
    """``n`` ranks from a checkpoint's lane states and the words from its position on."""
    lanes, bits, mask = len(state), np.uint64(model.bits), np.uint64((1 << model.bits) - 1)
    out, state, at = np.empty(n, np.uint32), state.copy(), 0
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        slot = x & mask
        s = slots[slot]
        out[start : start + len(x)] = s
        x = model.freq[s] * (x >> bits) + slot - model.first[s]
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << WORD) | words[at : at + len(short)]
        at += len(short)
        state[: len(x)] = x
    return out


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    model = Model.of(ids)
    rank_of = np.zeros(int(model.symbols[-1]) + 1 if len(model.symbols) else 1, np.uint32)
    rank_of[model.symbols] = np.arange(len(model.symbols))
    checks, streams, at = [], [], 0
    for start in range(0, len(ids), BLOCK):
        block = rank_of[ids[start : start + BLOCK]]
        lanes = int(max(1, min(LANES, len(block) // 64)))
        marks, words = encode_block(block, model, lanes)
        for k, (first, position, state) in enumerate(marks):
            stop = marks[k + 1][0] if k + 1 < len(marks) else len(block)
            check = zlib.crc32(ids[start + first : start + stop].astype("<u4").tobytes())
            checks.append((start + first, stop - first, at + position, lanes, check, state))
        streams.append(words.astype("<u4", copy=False).data.cast("B"))
        at += len(words)
    parts = {
        "docs": zlib.compress(json.dumps(doc_ids).encode()),
        "lengths": zlib.compress(lengths.astype("<u4").tobytes()),
        "symbols": zlib.compress(np.diff(model.symbols, prepend=np.uint32(0)).astype("<u4").tobytes()),
        "freq": zlib.compress(model.freq.astype("<u4").tobytes()),
        "checks": np.array([c[:5] for c in checks], "<i8").tobytes(),
        "states": b"".join(c[5].astype("<u8").tobytes() for c in checks),
    }
    sizes = {k: len(v) for k, v in parts.items()} | {"words": sum(map(len, streams))}
    head = json.dumps({"bits": model.bits, "n_ids": len(ids), "sizes": sizes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts.values(), *streams])


class Segment:
    """A segment read back; ``stretch(k)`` decodes from checkpoint ``k`` alone."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token segment")
        (length,) = struct.unpack_from("<I", data, 8)
        head, at, part = json.loads(data[12 : 12 + length]), 12 + length, {}
        for name, size in head["sizes"].items():
            part[name] = data[at : at + size]
            at += size
        unsigned = lambda name: np.frombuffer(zlib.decompress(part[name]), "<u4")
        self.doc_ids = json.loads(zlib.decompress(part["docs"]))
        self.lengths = unsigned("lengths")
        self.n_ids = head["n_ids"]
        self.model = Model(np.cumsum(unsigned("symbols")), unsigned("freq").astype(np.int64), head["bits"])
        self.slots = self.model.slots()
        self.checks = np.frombuffer(part["checks"], "<i8").reshape(-1, 5)
        self.states = np.frombuffer(part["states"], "<u8")
        self.words = np.frombuffer(part["words"], "<u4").astype(np.uint64)

    def stretch(self, k: int) -> np.ndarray:
        first, n, position, lanes, check = self.checks[k].tolist()
        at = int(self.checks[:k, 3].sum())
        ranks = decode_stretch(self.states[at : at + lanes], self.words[position:], n, self.model, self.slots)
        ids = self.model.symbols[ranks]
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError(f"checksum of checkpoint {k} at id {first} does not match")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.stretch(k) for k in range(len(self.checks))] or [np.empty(0, np.uint32)])


#: Bytes of text whose pieces stand apart at one time, and known pieces of which Arrow makes a table at one time.
PART, LOOKUP = 1 << 20, 1 << 17

#: White space of any script, and what keeps a text from being cut into pieces: an empty piece, or one that starts with it.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = rf"\A{SPACE}| {SPACE}| \z|\A\z"
#: Pieces whose cuts are known without the library's pattern: words of Latin letters, marks after them, single line ends between.
LETTER, MARK, CUT = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", r"[!-/:-@\[-`{-~]", "\x01"
PLAIN = rf"\A{LETTER}+{MARK}*(\n{LETTER}+{MARK}*)*\z"


def byte_letters() -> np.ndarray:
    """The character by which byte-level BPE writes each byte; ``CUT`` stays as it is."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, others = np.arange(256, dtype="<u4"), [b for b in range(256) if b not in own]
    out[others] = 256 + np.arange(len(others))
    out[ord(CUT)] = ord(CUT)
    return out


def in_lines(pieces, between: str):
    """The pieces, each behind a space, 256 to a text, with ``between`` in place of the space of all but the first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    edge = pa.array([*range(0, len(pieces), 256), len(pieces)], pa.int64())
    empty, space, between = (pa.scalar(x, pa.large_string()) for x in ("", " ", between))
    return pc.binary_join_element_wise(empty, pc.binary_join(pa.LargeListArray.from_arrays(edge, pieces), between), space)


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` values and half as many again."""
    out = np.zeros(n + n // 2, x.dtype)
    out[: len(x)] = x
    return out


class Encoder:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    The pre-tokenizer of byte-level BPE always cuts before a single space that
    stands before a non-space, so a text is the sequence of its space-separated
    pieces, and a piece has the same ids wherever it stands. Texts in which a
    piece is empty, starts with white space, or that hold a special token, go to
    the library whole. Of new pieces, ``PLAIN`` ones are cut by Arrow and reach the library's
    model in its byte letters, without its pattern. Known pieces are an Arrow array, in which Arrow finds a
    batch's distinct pieces at once. The memory of pieces is bounded: it starts anew when full. A batch is cut
    and written out in parts of ``PART`` bytes, so of its pieces only the numbers stand beside it as a whole.
    """

    def __init__(self, path: str, known: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), known
        config = json.loads(self.tokenizer.to_str())
        pre = config["pre_tokenizer"] or {}
        self.by_piece = (
            config["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and config["post_processor"] is None
        )
        # the same model, behind cuts that are made already
        self.model, self.letters = Tokenizer(self.tokenizer.model), byte_letters()
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(CUT)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.n_bytes[k] = len(token)
        self.forget()

    def forget(self) -> None:
        import pyarrow as pa

        self.known, self.used = pa.array([], pa.large_string()), 0
        self.size, self.offset, self.pool = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(8192, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces) -> np.ndarray:
        """Encode distinct new pieces, and say in which order they are kept; one with a leading space stands for a piece
        at the start of a text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        numpy = lambda x: x.to_numpy(zero_copy_only=False)
        kind = np.where(numpy(pc.starts_with(pieces, " ")), 0, np.where(numpy(pc.match_substring_regex(pieces, PLAIN)), 2, 1))
        order = np.argsort(kind, kind="stable")
        pieces = pieces.take(pa.array(order))
        n, m = np.searchsorted(kind[order], [1, 2]).tolist()
        starts = [p[1:] for p in pieces.slice(0, n).to_pylist()]
        first = [x for k in range(0, n, 1024) for x in self.whole(starts[k : k + 1024])]
        inner = [self.whole([line])[0] for line in in_lines(pieces.slice(n, m - n), " ").to_pylist()]
        inner = np.concatenate([np.empty(0, np.uint32), *inner, *self.plain(in_lines(pieces.slice(m), CUT + " "))])
        # byte-level tokens cover the bytes one after the other, so byte counts tell where a piece ends
        n_bytes = numpy(pc.binary_length(pieces.slice(n))).astype(np.int64) + 1
        cuts = np.searchsorted(np.cumsum(self.n_bytes[inner]), np.cumsum(n_bytes)) + 1
        sizes = np.concatenate([np.array([len(x) for x in first], np.int64), np.diff(cuts, prepend=0)])
        self.keep(pieces, sizes, np.concatenate([np.empty(0, np.uint32), *first, inner]))
        return order

    def plain(self, lines) -> list[np.ndarray]:
        """Ids of each line of ``PLAIN`` pieces that are parted by ``CUT``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lines = pc.replace_substring_regex(lines, f"({LETTER})({MARK})", rf"\1{CUT}\2")
        lines = pc.replace_substring(lines, "\n", f"{CUT}\n{CUT}").cast(pa.large_binary()).to_pylist()
        written = (self.letters[np.frombuffer(line, np.uint8)].tobytes().decode("utf-32-le") for line in lines)
        return [np.array(self.model.encode_batch_fast([w], add_special_tokens=False)[0].ids, np.uint32) for w in written]

    def keep(self, pieces, sizes: np.ndarray, flat: np.ndarray) -> None:
        import pyarrow as pa

        n = len(self.known)
        if n + len(pieces) > len(self.size):
            self.size = grown(self.size, n + len(pieces))
            self.offset = grown(self.offset, n + len(pieces))
        if self.used + len(flat) > len(self.pool):
            self.pool = grown(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(pieces)] = sizes
        self.offset[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.known = pa.concat_arrays([self.known, pieces])
        self.used += len(flat)

    def places(self, pieces) -> np.ndarray:
        """Where each piece stands among the known ones; new ones are learnt."""
        import pyarrow.compute as pc

        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        at, new = np.full(len(distinct), -1, np.int32), distinct
        for k in range(0, len(self.known), LOOKUP):
            there = pc.index_in(new, value_set=self.known.slice(k, LOOKUP))
            at[at < 0] = pc.fill_null(pc.add(there, k), -1).to_numpy(zero_copy_only=False)
            new = new.filter(pc.is_null(there))
        if len(new):
            n = len(self.known)
            at[np.flatnonzero(at < 0)[self.learn(new)]] = np.arange(n, n + len(new))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def cut(self, texts) -> tuple:
        """Distinct pieces of texts that are not odd, the number of each piece among them, and where each text's begin,
        with their number at the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = pc.split_pattern(texts, " ")
        edge = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)])
        flat = pieces.flatten()
        starts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), flat.take(pa.array(edge[:-1])), pa.scalar(" ", pa.large_string()))
        coded = pa.concat_arrays([flat, starts]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).copy()
        codes[edge[:-1]] = codes[len(flat) :]
        return coded.dictionary, codes[: len(flat)], edge

    def parts(self, texts, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of ids of each text of an Arrow array (null: empty), and their ids one after the other, part by part.

        With ``end``, that id follows each text's. Arrow cuts the texts and numbers their pieces.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD) if self.by_piece else pa.array(np.full(len(texts), True))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        if len(self.known) > self.limit:
            self.forget()
        within = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PART
        edges = [0, *(np.flatnonzero(np.diff(within)) + 1).tolist(), len(texts)]
        parts = [(texts.slice(a, b - a), odd[a:b]) for a, b in zip(edges, edges[1:])]
        cuts = [self.cut(part.filter(pa.array(~o))) for part, o in parts]
        # the distinct pieces of all parts are looked up at once
        at = self.places(pa.concat_arrays([distinct for distinct, _, _ in cuts]))
        first = np.cumsum([0, *(len(distinct) for distinct, _, _ in cuts)])
        cuts = [(codes, edge) for _, codes, edge in cuts]
        for (part, o), (codes, edge), k in zip(parts, cuts, first.tolist()):
            yield self.ended(*self.joined(part, o, *self.expanded(at[codes + k]), edge), end)

    def joined(self, texts, odd: np.ndarray, ids: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of texts of which the others than the ``odd`` ones have ``ids``."""
        import pyarrow as pa

        lengths = np.zeros(len(texts), np.int64)
        lengths[~odd] = ends[edge[1:]] - ends[edge[:-1]]
        if odd.any():
            runs = np.split(ids, np.cumsum(lengths)[:-1])
            where = np.flatnonzero(odd)
            for k, x in zip(where.tolist(), self.whole(texts.take(pa.array(where)).to_pylist())):
                runs[k], lengths[k] = x, len(x)
            ids = np.concatenate(runs)
        return lengths, ids

    def ended(self, lengths: np.ndarray, ids: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return lengths, ids
        lengths = lengths + 1
        out, inner = np.full(len(ids) + len(lengths), end, np.uint32), np.ones(len(ids) + len(lengths), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = ids
        return lengths, out

    def __call__(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All parts in one: the number of ids of each text, and all ids one after the other."""
        lengths, runs = zip(*self.parts(texts, end))
        return np.concatenate(lengths), np.concatenate(runs)

    def expanded(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces at ``at``, and where each piece's begin, with their number at the end."""
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids = np.empty(int(ends[-1]), np.uint32)
        for k in range(0, len(at), 1 << 16):
            part, first, n = at[k : k + (1 << 16)], ends[k], sizes[k : k + (1 << 16)]
            last = int(ends[min(k + (1 << 16), len(at))])
            shift = self.offset[part] - (ends[k : k + len(part)] - first)
            ids[first:last] = self.pool[np.repeat(shift, n) + np.arange(last - first)]
        return ids, ends


_encoders: dict[str, Encoder] = {}

SEGMENTS = "part int, seq int, n_docs long, n_ids long, payload binary"
TOKENS = "doc_id long, part int, seq int, before long, n_tokens long, ids_crc32 long"


def _segments(path: str, end_id: int, segment: int):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        part, seq, docs, lengths, runs, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            ids = np.concatenate(runs)
            runs.clear()
            payload = pack_segment(docs, np.concatenate(lengths), ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            values = [part, seq, len(docs), held, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["part", "seq", "n_docs", "n_ids", "payload"])

        for batch in slices(batches, "text", 12 << 20):
            docs += batch.column("doc_id").to_pylist()
            for n, ids in encoder.parts(batch.column("text"), end_id):
                lengths.append(n)
                runs.append(ids)
                held += len(ids)
            if held >= segment:
                yield flush()
                seq, docs, lengths, runs, held = seq + 1, [], [], [], 0
        if docs:
            yield flush()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Encode ``docs(doc_id, text)`` in ascending ``doc_id`` order into segments at ``path``.

    One range shuffle puts documents in order; each task encodes its range into
    segments as it reads, so it holds one segment whatever the range holds.
    Null texts are empty, documents of one id are ordered by text, and a null
    id comes first. An empty table gives no segment.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, _segments(tokenizer, end_id, segment), SEGMENTS).write.option("maxRecordsPerFile", 4).option(
        "compression", "none"
    ).parquet(path)


def _documents(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row in range(batch.num_rows):
            segment = Segment(batch.column("payload")[row].as_buffer().to_pybytes())
            ids = segment.ids().astype("<u4", copy=False)
            ends = np.cumsum(segment.lengths.astype(np.int64))
            starts = ends - segment.lengths
            view = memoryview(ids).cast("B")
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(segment.doc_ids, pa.int64()),
                    pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)),
                    pa.array(np.full(n, batch.column("seq")[row].as_py(), np.int32)),
                    pa.array(starts),
                    pa.array(segment.lengths.astype(np.int64)),
                    pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ],
                ["doc_id", "part", "seq", "before", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row in range(batch.num_rows):
            segment = Segment(batch.column("payload")[row].as_buffer().to_pybytes())
            ids, edges = segment.ids(), np.concatenate([[0], np.cumsum(segment.lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int64)))],
                ["doc_id", "ids"],
            )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of every document at ``path``."""
    return map_arrow(spark.read.schema(SEGMENTS).parquet(path), _ids, "doc_id long, ids array<long>")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    The start of a segment is a running total over the manifest columns, summed
    first per part; payloads are read only to decode.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    parts = parts.select("part", total("n", Window.orderBy("part")).alias("part_base"))
    bases = files.select("part", "seq", total("n_ids", Window.partitionBy("part").orderBy("seq")).alias("seq_base")).join(parts, "part")
    return (
        map_arrow(files, _documents, TOKENS)
        .join(bases, ["part", "seq"])
        .select("doc_id", (F.col("part_base") + F.col("seq_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
