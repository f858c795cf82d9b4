"""Merkle manifest of a corpus, with leaf coordinates from ranked bitmaps.

A row is a leaf. Its place among the leaves of its source is a rank query: per
source and range of ids, compressed bitmaps of the tasks are merged into one
container with a popcount directory (a sorted list while sparse), and containers
know how many leaves lie before them. So leaves are never sorted. Places give the
slots of keyed arrays of ``BLOCK`` leaves; an array is reduced several levels at a
time, its digest being a slot of the next array. The way down gives every leaf the
digests beside its path.

Order of leaves: by source (null first, bytewise), then ``doc_id`` (null first),
then digest. Repeated ids and rows are leaves of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.llm.common import map_arrow, with_prefix
from leasegrain.session import staged

FANOUT, DEPTH = 3, 6
BLOCK = FANOUT**DEPTH
#: Ids of one container, and up to how many of them it is a sorted list.
CHUNK_BITS, SPARSE = 12, 32
CHUNK = 1 << CHUNK_BITS
#: Ids a task gathers before it hands out their bitmaps.
GATHER = 1 << 20


def field(column: Column) -> Column:
    """A value as leaves hold it: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row of ``documents``, or of that row with another text."""
    parts = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text") if text is None else text]
    return F.sha2(F.concat(*[field(p) for p in parts]), 256)


# ---- bitmaps


def _bitmaps(batches: Iterator) -> Iterator:
    """A task's ids as bitmaps: per source and chunk the set bits (a list or a bitmap) and the surplus of repeated ids."""
    import pyarrow as pa

    def out(held: list) -> pa.RecordBatch:
        keys = pa.concat_arrays([k for k, _, _ in held]).dictionary_encode()
        names = keys.dictionary
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunk, low = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        order = np.lexsort((low, chunk, code))
        code, chunk, low = code[order], chunk[order], low[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(chunk) != 0)]))
        rows = []
        for a, b in zip(new, [*new[1:], len(code)]):
            ids, times = np.unique(low[a:b], return_counts=True)
            more = times > 1
            bits = None
            if len(ids) > CHUNK // 16:
                bits = np.zeros(CHUNK, np.uint8)
                bits[ids] = 1
                bits = np.packbits(bits, bitorder="little").tobytes()
            rows.append((int(chunk[a]), None if bits else ids.astype("<u2").tobytes(), bits, ids[more].tolist(), (times[more] - 1).tolist()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([names.take(pa.array(code[new])), *columns], ["key", "chunk", "ids", "bits", "again", "extra"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("key"), *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "low")]))
        n += batch.num_rows
        if n >= GATHER:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _containers(batches: Iterator) -> Iterator:
    """Bitmaps of all tasks merged into one container per source and chunk."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            there, extra = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
            for p in parts:
                if p["bits"] is not None:
                    seen = np.flatnonzero(np.unpackbits(np.frombuffer(p["bits"], np.uint8), bitorder="little"))
                else:
                    seen = np.frombuffer(p["ids"], "<u2").astype(np.int64)
                there[seen] += 1
                np.add.at(extra, np.array(p["again"], np.int64), np.array(p["extra"], np.int64))
            extra += np.maximum(there - 1, 0)
            ids = np.flatnonzero(there)
            again = np.flatnonzero(extra)
            words = counts = None
            if len(ids) > SPARSE:
                packed = np.packbits(there > 0, bitorder="little")
                words = packed.view("<i8").tolist()
                per = np.bincount(ids >> 6, minlength=CHUNK >> 6)
                counts = (np.cumsum(per) - per).tolist()
            rows.append((len(ids) + int(extra.sum()), None if words else ids.tolist(), words, counts, again.tolist(), extra[again].tolist()))
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), *columns], ["key", "chunk", "n", "ids", "words", "counts", "again", "extra"])


def _running(df: DataFrame, part: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` before a row within ``part``: rows are dealt into ranges of the order, whose sums run on."""
    ranges = staged(df.repartitionByRange(*part, *order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value), "ranges")
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*part, "_range").agg(F.sum("_value").alias("_sum"))
    bases = sums.select(*part, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return counted.join(bases, [*part, "_range"]).withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_value", "_base", "_inside")


def directory(rows: DataFrame) -> DataFrame:
    """Containers ``key, chunk, ids or words and counts, again, extra, n, base, total`` of ``rows(key, chunk, low)``."""
    parts = map_arrow(rows.select("key", "chunk", "low"), _bitmaps, "key string, chunk long, ids binary, bits binary, again array<int>, extra array<long>")
    merged = parts.groupBy("key", "chunk").agg(F.collect_list(F.struct("ids", "bits", "again", "extra")).alias("parts"))
    fields = "key string, chunk long, n long, ids array<int>, words array<long>, counts array<int>, again array<int>, extra array<long>"
    based = _running(map_arrow(merged, _containers, fields), ["key"], ["chunk"], F.col("n"), "base")
    totals = based.groupBy("key").agg(F.sum("n").alias("total"))
    return staged(based.join(totals, "key"), "directory")


def rank(low: Column) -> Column:
    """Leaves of the source before those of this id, from its container's columns."""
    word = F.shiftright(low, 6)
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low.bitwiseAND(63)))
    dense = F.get("counts", word) + F.bit_count(F.get("words", word).bitwiseAND(below))
    sparse = (F.array_position("ids", low) - 1).cast("int")
    surplus = F.aggregate(F.arrays_zip("again", "extra"), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["again"] < low, x["extra"]).otherwise(0))
    return F.col("base") + F.coalesce(sparse, dense) + surplus


def placed(rows: DataFrame) -> DataFrame:
    """``rows(key, chunk, low, leaf, ...)`` with their place ``pos`` among the ``total`` leaves of their key."""
    containers = directory(rows)
    own = [c for c in rows.columns]
    found = rows.join(containers.hint("shuffle_hash"), ["key", "chunk"])
    found = found.select(*own, "total", rank(F.col("low")).alias("pos"), F.array_contains("again", F.col("low")).alias("_copies"))
    if containers.where(F.size("again") > 0).isEmpty():
        return found.drop("_copies")
    found = staged(found, "ranked")
    one = found.where("not _copies").drop("_copies")
    # equal rows are one row with a count until they have places
    many = found.where("_copies").drop("_copies").groupBy(*own, "total", "pos").agg(F.count("*").alias("_n"))
    bucket = F.conv(F.substring("leaf", 1, 3), 16, 10).cast("int")
    others = [F.col(c) for c in own if c not in ("key", "chunk", "low", "leaf")]
    many = with_prefix(many, ["key", "chunk", "low"], bucket, [F.col("leaf"), *others], F.col("_n"), "_before")
    many = many.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return one.unionByName(many.withColumn("pos", F.col("pos") + F.col("_before") + F.col("_copy") - 1).drop("_n", "_before", "_copy"))


# ---- the tree


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(total: int) -> int:
    """Levels until one node is left of ``total``."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def levels_of(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of one array, from its slots to its root, of a tree with ``total`` nodes on the array's level."""
    out = [nodes]
    for _ in range(min(DEPTH, height(total))):
        out.append([digest(out[-1][k : k + FANOUT]) for k in range(0, len(out[-1]), FANOUT)])
    return out


def _slots(batch) -> Iterator[tuple[int, np.ndarray, list[str], int]]:
    lists = batch.column("entries")
    flat, sizes = lists.flatten(), lists.value_lengths().to_pylist()
    slots, digests, totals = flat.field("slot").to_numpy(zero_copy_only=False), flat.field("digest").to_pylist(), batch.column("total").to_pylist()
    start = 0
    for k, size in enumerate(sizes):
        nodes: list = [None] * size
        at = slots[start : start + size]
        for slot, d in zip(at.tolist(), digests[start : start + size]):
            nodes[slot] = d.hex()
        yield k, at, nodes, totals[k]
        start += size


def _up(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [(bytes.fromhex(levels_of(nodes, total)[-1][0]), -(-total // BLOCK)) for _, _, nodes, total in _slots(batch)]
        columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), *columns], ["key", "pos", "digest", "total"])


def _down(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        flat = batch.column("entries").flatten()
        above = [batch.column(c).to_pylist() for c in ("lefts", "rights")]
        start = 0
        for k, at, nodes, total in _slots(batch):
            levels = levels_of(nodes, total)
            paths = [([], [])]
            for level in reversed(levels[:-1]):
                below = []
                for i in range(len(level)):
                    first = i - i % FANOUT
                    lefts, rights = paths[i // FANOUT]
                    below.append((["".join(level[first:i]), *lefts], ["".join(level[i + 1 : first + FANOUT]), *rights]))
                paths = below
            order = at.tolist()
            entries = flat.slice(start, len(order))
            start += len(order)
            repeat = pa.array(np.full(len(order), k))
            sides = [pa.array([paths[s][side] + above[side][k] for s in order], pa.list_(pa.string())) for side in (0, 1)]
            names = [f.name for f in flat.type]
            columns = [batch.column("key").take(repeat), batch.column("subroot").take(repeat), *[entries.field(n) for n in names], *sides]
            yield pa.RecordBatch.from_arrays(columns, ["key", "subroot", *names, "lefts", "rights"])


def _arrays(nodes: DataFrame, others: list[str]) -> DataFrame:
    """Keyed slot arrays of ``nodes(key, pos, total, digest, others)``, in no order."""
    entry = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), "digest", *others)
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return keyed.groupBy("key", "block").agg(F.max("total").alias("total"), F.collect_list(entry).alias("entries"))


class Forest:
    """Trees of ``nodes(key, pos, total, digest, others)`` per key: a table of arrays for every round of levels."""

    def __init__(self, nodes: DataFrame, others: list[str], label: str) -> None:
        self.others, self.fields = others, {c: nodes.schema[c].dataType.simpleString() for c in others}
        self.rounds = [staged(_arrays(nodes, others), f"{label}-arrays")]
        most = self.rounds[0].agg(F.max("total").alias("m")).first()["m"] or 1
        while True:
            up = map_arrow(self.rounds[-1].select("key", "block", "total", "entries"), _up, "key string, pos long, digest binary, total long")
            most = -(-most // BLOCK)
            if most == 1:
                self.roots = staged(up.select("key", "digest"), f"{label}-roots")
                return
            self.rounds.append(staged(_arrays(up, ["pos"]), f"{label}-arrays"))

    def paths(self, above: DataFrame) -> DataFrame:
        """``key, subroot, digest, others, lefts, rights`` of all nodes under ``above(key, subroot, lefts, rights)``."""
        now = above.select("key", F.lit(0).cast("long").alias("pos"), "subroot", "lefts", "rights")
        for k in reversed(range(len(self.rounds))):
            fields = {"pos": "bigint"} if k else self.fields
            schema = "key string, subroot string, slot int, digest binary, " + "".join(f"`{c}` {t}, " for c, t in fields.items()) + "lefts array<string>, rights array<string>"
            joined = self.rounds[k].join(now, (self.rounds[k]["key"] == now["key"]) & (self.rounds[k]["block"] == now["pos"]))
            rows = joined.select(self.rounds[k]["key"], "total", "entries", "subroot", "lefts", "rights")
            now = map_arrow(rows, _down, schema)
            if k:
                now = staged(now, "paths")
        return now


def prove(docs: DataFrame, **carried: Column) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, lefts, rights`` and ``carried`` of every row of ``docs(doc_id, source, lang, n_chars, text)``.

    ``lefts`` and ``rights`` hold, level by level from the leaf to the root, the
    joined digests of the run's other nodes on either side (an empty string if
    none). ``carried`` are expressions over the rows of ``docs`` that come back
    with their row. Other columns are ignored, whatever their names; nulls in any
    column are ``-`` in the leaf; a null source is one source, a null id sorts
    first; an empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("key"),
        F.coalesce(F.shiftright(doc_id, CHUNK_BITS), F.lit(-(1 << 62))).alias("chunk"),
        F.coalesce(doc_id.bitwiseAND(CHUNK - 1), F.lit(0)).cast("int").alias("low"),
        leaf_digest().alias("leaf"),
        doc_id.alias("doc_id"),
        *[e.alias(f"c_{c}") for c, e in carried.items()],
    )
    others = ["doc_id", *[f"c_{c}" for c in carried]]
    trees = Forest(placed(rows).withColumn("digest", F.unhex("leaf")), others, "leaves")
    roots = trees.roots.withColumn("one", F.lit(1).cast("long"))
    sources = roots.count()
    ranked = _running(roots.withColumn("all", F.lit("")), ["all"], ["key"], F.col("one"), "pos")
    ranked = ranked.select(F.lit("").alias("key"), "pos", F.lit(sources).cast("long").alias("total"), "digest", F.col("key").alias("source_key"))
    top = Forest(ranked, ["source_key"], "sources")
    root = top.roots.first()
    none = F.array().cast("array<string>")
    start = top.roots.select("key", F.lit("").alias("subroot"), none.alias("lefts"), none.alias("rights"))
    above = top.paths(start).select(F.col("source_key").alias("key"), F.lower(F.hex("digest")).alias("subroot"), "lefts", "rights")
    found = trees.paths(staged(above, "paths"))
    return found.select(
        "doc_id",
        F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"),
        F.lower(F.hex("digest")).alias("leaf"),
        "subroot",
        F.lit(root["digest"].hex() if root else None).alias("root"),
        "lefts",
        "rights",
        *[F.col(f"c_{c}").alias(c) for c in carried],
    )


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf gives along its path."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)
