"""Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints of five-word shingles (few bits apart)
and, as at 0.8 fingerprints differ in about ten bits, from a prefix filter: two
sets of similarity 0.8 share one of the first ``n - ceil(0.8 n) + 1`` shingles of
either one, in any fixed order of shingles. The order is by rarity, so that common
passages are no candidates. Every candidate is verified on both whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.llm import simhash
from leasegrain.llm.common import FILTER_BITS, FILTER_BLOCK, Scratch, components, join_counted, key_filter, map_arrow, may_be_in, slices
from leasegrain.llm.decontamination import BASE, scramble, token_hashes
from leasegrain.session import staged

#: The similarity is ALIKE / OF; counts are compared in whole numbers.
WORDS, ALIKE, OF = 5, 4, 5
#: Counts of shingles are kept by the first bits of their hashes; they only order shingles.
CELL_BITS = 18
#: Bytes of text worked on at a time; a text takes some 24 times its size while it is hashed.
SLICE = 1 << 20
#: Keys by which a task knows the texts it has seen.
REMEMBERED = 1 << 20
#: Shingles of each text by which a pair knows that it has met before.
LEAST = 8
#: Longs of a set's bitmap, a power of two.
MAP_WORDS = 8
MAPS = [f"m{k}" for k in range(MAP_WORDS)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes, rising, of a text's shingles of five words (ASCII letters lowered); fewer words are one shingle."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[b], [False]]).astype(np.int8)))
    if not len(edge):
        return np.empty(0, np.uint64)
    h = token_hashes(b, edge[::2], edge[1::2])
    size = min(WORDS, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = scramble(out * BASE + h[k : k + len(out)])
    return np.unique(out)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, of which any set that is similar enough shares one with its own."""
    cells = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    order = np.lexsort((hashes, counts[cells]))
    return hashes[order[: len(hashes) - -(-ALIKE * len(hashes) // OF) + 1]] if len(hashes) else hashes


def key_of(text: str | None) -> int:
    """A signed 64-bit key of the text's words in their order."""
    import xxhash

    x = xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").translate(simhash.LOWER).split()))
    return simhash.signed(x)


def _nodes(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, "text", SLICE):
        texts = batch.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        maps = np.array([bitmap(s) for s in sets])
        columns = [pa.array([key_of(t) for t in texts], pa.int64()), pa.array([simhash.fingerprint(t, WORDS) for t in texts], pa.int64())]
        columns += [pa.array([len(s) for s in sets], pa.int32()), *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP_WORDS)]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "key", "print", "n", *MAPS])


def _counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in slices(batches, "text", SLICE):
        for text in batch.column("text").to_pylist():
            np.add.at(total, (shingles(text) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
    cells = np.flatnonzero(total)
    for k in range(0, len(cells), 1 << 16):
        at = cells[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes per place: two sets differ in at least as many hashes as their bitmaps in bits."""
    places = (hashes & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=64 * MAP_WORDS) & 1).view(np.int64)


def prefixes(rows: DataFrame) -> DataFrame:
    """``shingle, key`` of the prefix of every text of ``rows(text)``; a task gives a text it remembers once."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    found = map_arrow(rows.select("text"), _counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, sets in _distinct(batches):
            first = [prefix(s, shared.value).view(np.int64) for s in sets]
            columns = [np.concatenate(first), np.repeat(np.array(keys, np.int64), [len(p) for p in first])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "key"])

    return map_arrow(rows.select("text"), run, "shingle long, key long")


def _distinct(batches: Iterator, wanted=None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Keys and sets of a task's texts, each text once as far as ``REMEMBERED`` keys tell, of the ``wanted`` keys."""
    seen: set[int] = set()
    for batch in slices(batches, "text", SLICE):
        keys, sets = [], []
        for text in batch.column("text").to_pylist():
            key = key_of(text)
            if key in seen or not (wanted is None or wanted(key)):
                continue
            if len(seen) < REMEMBERED:
                seen.add(key)
            keys.append(key)
            sets.append(shingles(text))
        if keys:
            yield keys, sets


def sets_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, set`` of the texts of ``rows(text)`` whose key is in ``asked(key)``, each once.

    Tasks hold a filter of the keys of at most 2 MB, so that hardly any other
    text leaves them; the join is exact.
    """
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for block, data in key_filter(asked, "key").toLocalIterator():
        bits[block * (FILTER_BLOCK >> 3) : (block + 1) * (FILTER_BLOCK >> 3)] = np.frombuffer(data, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def wanted(key: int) -> bool:
            place = spark_hash(key) & ((1 << FILTER_BITS) - 1)
            return bool(shared.value[place >> 3] >> (place & 7) & 1)

        for keys, sets in _distinct(batches, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "set"])

    found = map_arrow(rows.select("text"), run, "key long, set array<long>")
    return found.join(asked, "key", "left_semi").dropDuplicates(["key"])


def spark_hash(key: int) -> int:
    """What Spark's ``xxhash64`` gives for a long."""
    import xxhash

    return xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)


def may_be_similar(a: str, b: str) -> Column:
    """Whether bitmaps and sizes of two nodes leave the similarity possible: of such sets, at most
    (OF - ALIKE) / (OF + ALIKE) of all members are in one only, and neither is below ALIKE / OF of the other."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MAPS])
    return (OF * F.least(m, n) >= ALIKE * F.greatest(m, n)) & ((OF + ALIKE) * differ <= (OF - ALIKE) * (m + n))


def _parities(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("set")
        sizes, flat = lists.value_lengths().to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(sizes).tolist()
        out = [parity(flat[end - n : end]) for n, end in zip(sizes, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["key", "n", "parity"])


def parity(hashes: np.ndarray) -> np.ndarray:
    """A set's parities in a power of two of at least twice as many places; halves laid over each other give the next smaller one."""
    places = 64
    while places < 2 * len(hashes):
        places *= 2
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).view(np.int64)


def parities_allow(a: str, b: str) -> Column:
    """The test of ``may_be_similar`` on parities of the sets' own length, which are nearly as good as the sets."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    p, q, m, n = F.col(f"{a}.parity"), F.col(f"{b}.parity"), F.col(f"{a}.n"), F.col(f"{b}.n")
    alike_in_size = OF * F.least(m, n) >= ALIKE * F.greatest(m, n)  # so at most one fold apart
    shorter = lambda x, y: F.when(F.size(x) > F.size(y), folded(x)).otherwise(x)
    differ = F.aggregate(F.zip_with(shorter(p, q), shorter(q, p), xor), F.lit(0), lambda acc, x: acc + F.bit_count(x))
    return F.when(alike_in_size, (OF + ALIKE) * differ <= (OF - ALIKE) * (m + n)).otherwise(False)


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs ``a, b`` of keys, each given once, whose texts are similar enough."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = nodes.select("key", "n", *MAPS).alias("x"), nodes.select("key", "n", *MAPS).alias("y")
    near = pairs.join(x, F.col("a") == F.col("x.key")).join(y, (F.col("b") == F.col("y.key")) & may_be_similar("x", "y"))
    pairs = scratch.staged(near.select("a", "b"), "pairs")
    asked = scratch.staged(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "asked")
    sets = scratch.staged(sets_of(rows, asked), "sets")
    # a set is 32 times its parities, so only pairs that these leave are compared by sets
    marks = scratch.staged(map_arrow(sets, _parities, "key long, n int, parity array<long>"), "parities")
    x, y = marks.alias("x"), marks.alias("y")
    near = pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key")).where(parities_allow("x", "y"))
    pairs = scratch.staged(near.select("a", "b"), "pairs")
    sided = lambda k: sets.select(F.col("key").alias(k), F.col("set").alias(f"of_{k}"))
    both = pairs.join(sided("a"), "a").join(sided("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(OF * shared >= ALIKE * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def by_fingerprint(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates ``a, b``: a key with the least key of its fingerprint, and the least keys of fingerprints few bits apart."""
    heads = scratch.staged(nodes.groupBy("print").agg(F.min("key").alias("head")), "heads")
    n = heads.count()
    same = nodes.join(heads, "print").select(F.col("head").alias("a"), F.col("key").alias("b"))
    if n < 2:
        return same
    close = simhash.links(heads.select("print"), simhash.plan(simhash.moments(heads), n))
    named = lambda k: heads.select(F.col("print").alias(k), F.col("head").alias(f"of_{k}"))
    return same.union(close.join(named("a"), "a").join(named("b"), "b").select("of_a", "of_b"))


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """``shingle, key, low, high`` of the prefix shingles that stand in several texts, with the least and largest key of each.

    Nearly all shingles stand in one text, so these leave the one shuffle in
    the stage that reads it, and nothing else moves or keeps them.
    """
    texts = Window.partitionBy("shingle")
    dealt = prefixes(rows).repartition("shingle").distinct()
    ends = dealt.withColumn("low", F.min("key").over(texts)).withColumn("high", F.max("key").over(texts))
    return ends.where("low <> high")


def with_least(there: DataFrame) -> DataFrame:
    """Adds ``least`` to ``there(shingle, key)``: the ``LEAST`` smallest shingles of the key among its rows."""
    listed = there.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("shingle")), 1, LEAST).alias("least"))
    return there.join(listed, "key")


def open_pairs(there: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of keys of ``there(shingle, key, component, least, n, bitmap)`` that share a shingle, are not yet in
    one component and may be similar.

    A pair meets at its smallest shared shingle. It may meet again at others only as
    long as no smaller one is among the least of both, so near copies, which share
    dozens, are no rows of each.
    """
    a, b = there.alias("a"), there.alias("b")
    apart = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.component") != F.col("b.component"))
    before = F.array_min(F.array_intersect("a.least", "b.least"))
    first = F.coalesce(before >= F.col("a.shingle"), F.lit(True))
    return a.join(b, apart & may_be_similar("a", "b") & first).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found(id, component)`` after further links ``a, b`` of ids: only components are linked, not all their members again."""
    of = lambda k: found.select(F.col("id").alias(k), F.col("component").alias(f"of_{k}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    ends = between.select(F.col("a").alias("id")).union(between.select("b")).distinct()
    least = components(ends, between).where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("least"))
    return found.join(least, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id, group_size`` of ``docs(doc_id, text)``: the smallest id reachable over similar texts.

    Texts of the same words in the same order are one node; null and blank texts are
    one node that is similar to no other. Candidates are verified in two rounds:
    those of the fingerprints and those of the least and the largest key of each
    shingle first, then the pairs of a shingle that are not yet in one component and
    whose bitmaps leave the similarity possible, each pair at one shingle, so a large
    group of near copies does not meet pair by pair. Repeated rows and ids
    stay; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = "doc_id long, key long, print long, n int, " + ", ".join(f"{m} long" for m in MAPS)
    prints = staged(map_arrow(rows, _nodes, fields), "keyed")
    same = ["key", "print", "n", *MAPS]
    nodes = staged(prints.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    members = scratch.staged(shared_prefixes(rows), "members")
    first = members.select(F.col("low").alias("a"), F.col("key").alias("b")).union(members.select("high", "key"))
    edges = staged(verified(by_fingerprint(nodes, scratch).union(first), nodes, rows, scratch), "similar")
    ids = nodes.select(F.col("key").alias("id"))
    found = staged(components(ids, edges), "found")
    there = members.join(found, members["key"] == found["id"]).select("shingle", "key", "component", "low", "high")
    open_ = there.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("shingle")
    there = scratch.staged(there.where("key <> low and key <> high").join(open_, "shingle", "left_semi"), "open")
    there = with_least(there.select("shingle", "key", "component")).join(nodes.select("key", "n", *MAPS), "key")
    rest = open_pairs(scratch.staged(there, "mapped"))
    more = staged(verified(rest, nodes, rows, scratch), "similar")
    if not more.isEmpty():
        found = merged(found, more)
    scratch.clear()
    named = nodes.join(found, nodes["key"] == found["id"]).select("key", "least", "copies", "component")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size"))
    labels = named.join(heads, "component").select("key", "copies", "component_id", "group_size")
    return join_counted(prints.select("doc_id", "key"), labels, "key", "copies", prints.count()).select("doc_id", "component_id", "group_size")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of similar texts stays: the one with the smallest id.

    Rows that repeat that id stay or go together, except that equal rows are kept
    once; documents without an id are all kept.
    """
    found = staged(similar_components(docs.select("doc_id", "text")), "labelled")
    # without a filter's hit a row surely stays; only the others are looked up, and compared as wholes
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    marked = may_be_in(packed, "id", key_filter(gone.union(twice.select("doc_id")), "doc_id"))
    sure = F.col("id").isNotNull() & ~F.col("_hit")
    looked = marked.where(~sure).select("row", "id").dropDuplicates(["row"])
    left = looked.join(gone.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return marked.where(sure).select("row.*").unionByName(left.select("row.*"))
