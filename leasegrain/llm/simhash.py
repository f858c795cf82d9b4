"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together, and part ``i``
gets a threshold ``e_i`` of -1 or more with ``sum(e_i + 1) = distance + 1``: two
fingerprints within the distance must differ in at most ``e_i`` bits of some
part. Thresholds (and the number of parts) come from a dynamic programme over
estimated candidates. Every fingerprint then probes the values within ``e_i`` of
its own part ``i``, and each candidate is verified on all bits in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrain.llm.common import components, join_counted, map_arrow, slices
from leasegrain.session import staged

WORDS, SEED, DISTANCE = 4, 42, 4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time, so that a very long text needs no large matrix.
CHUNK = 1 << 16
#: Cost of a probe row and of a verified candidate, relative.
PROBE, CANDIDATE = 1.0, 0.04


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text; 0 without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        part = [digest(line[a:b], seed) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, "text"):
        prints = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` of ``docs(doc_id, text)``."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _fingerprints, "doc_id long, print long")


def _moments(batches: Iterator) -> Iterator:
    """Rows ``i, values``: how often bits i and j are set together, of all fingerprints of a task."""
    import pyarrow as pa

    total = np.zeros((64, 64))
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(prints), CHUNK):
            bits = np.unpackbits(prints[k : k + CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
    i, j = np.indices((64, 64))
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], ["i", "j", "n"])


def moments(distinct: DataFrame) -> np.ndarray:
    """The 64 x 64 table of joint bit counts over all fingerprints; only this table reaches the driver."""
    rows = map_arrow(distinct.select("print"), _moments, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((64, 64))
    for i, j, n in rows.collect():
        out[i, j] = n
    return out


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, each grown by its most correlated bit."""
    left, groups = set(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        seed = max(left, key=lambda b: (sum(corr[b, x] for x in left), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (sum(corr[b, x] for x in group), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(differ: np.ndarray, effective: float, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, ... ``most`` bits of a part."""
    law = np.array([1.0])
    for p in differ:
        law = np.convolve(law, [1 - p, p])
    return [min(1.0, float(law[: e + 1].sum())) ** effective for e in range(most + 1)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with ``sum(e + 1) = budget`` of least cost; ``costs[i][t]`` is part i's cost at e = t - 1."""
    best = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t in range(min(len(cost) - 1, budget - spent) + 1):
                option = (total + cost[t], [*chosen, t - 1])
                if spent + t not in following or option < following[spent + t]:
                    following[spent + t] = option
        best = following
    return best.get(budget, (float("inf"), []))


def plan(joint: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts ``(bits, threshold)`` of least estimated cost for ``n`` distinct fingerprints."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 1.0)
    best = (float("inf"), [])
    for parts in range(1, min(distance + 3, 16)):
        groups, costs = group_bits(corr, parts), []
        for bits in groups:
            own = corr[np.ix_(bits, bits)]
            effective = min(1.0, len(bits) / float((own**2).sum()))
            chances = within(2 * p[bits] * (1 - p[bits]), effective, distance)
            ball = np.cumsum([comb(len(bits), e) for e in range(distance + 1)])
            costs.append([0.0] + [PROBE * n * (1 + ball[e] / 2) + CANDIDATE * n * n * chances[e] / 2 for e in range(distance + 1)])
        cost, thresholds = allocate(costs, distance + 1)
        if cost < best[0]:
            best = (cost, [(bits, e) for bits, e in zip(groups, thresholds) if e >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints at most ``distance`` bits apart (a pair may come from several parts)."""
    probes, masks = [], []
    for k, (bits, radius) in enumerate(parts):
        masks.append((k, signed(sum(1 << b for b in bits))))
        for e in range(radius + 1):
            for flips in combinations(bits, e):
                probes.append((k, masks[-1][1], signed(sum(1 << b for b in flips)), signed(1 << max(flips)) if flips else 0))
    rows = lambda values, schema: F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for x, (c, t) in zip(v, schema)]) for v in values])
    asked = distinct.select("print", F.inline(rows(probes, [("part", "int"), ("mask", "long"), ("flip", "long"), ("top", "long")])))
    # of two that differ by a flip, the one with its highest bit clear asks
    asked = asked.where("(print & top) = 0").select("part", F.expr("(print & mask) ^ flip").alias("key"), F.col("print").alias("a"), (F.col("flip") == 0).alias("same"))
    there = distinct.select("print", F.inline(rows(masks, [("part", "int"), ("mask", "long")])))
    there = there.select("part", F.expr("print & mask").alias("key"), F.col("print").alias("b"))
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (~F.col("same") | (F.col("a") < F.col("b")))
    return asked.join(there, (asked["part"] == there["part"]) & (asked["key"] == there["key"]) & close).select("a", "b")


def near_components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, print, component_id, group_size`` of ``docs(doc_id, text)``: the smallest id reachable over links.

    Equal fingerprints are one node, so copies cost nothing beyond their own rows.
    Null and blank texts share fingerprint 0, which links like any other; repeated
    rows and ids stay; an empty table gives no rows. Other columns are ignored.
    """
    prints = staged(fingerprints(docs), "prints")
    nodes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    n = nodes.count()
    edges = links(nodes.select("print"), plan(moments(nodes), n, distance), distance) if n > 1 else None
    found = (
        components(nodes.select(F.col("print").alias("id")), edges)
        if edges is not None
        else nodes.select(F.col("print").alias("id"), F.col("print").alias("component"))
    )
    named = nodes.join(found, nodes["print"] == found["id"]).select("print", "least", "copies", "component")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size"))
    labels = named.join(heads, "component").select("print", "copies", "component_id", "group_size")
    return join_counted(prints, labels, "print", "copies", prints.count()).select("doc_id", "print", "component_id", "group_size")


def keep_first(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Rows that repeat that id stay or go together, except that equal rows are kept
    once; documents without an id are all kept.
    """
    found = near_components(docs.select("doc_id", "text"), distance)
    kept = found.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.dropDuplicates(docs.columns).join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
