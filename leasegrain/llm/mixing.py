"""A mixture of sources at target weights: equal-token units dealt out by Sainte-Laguë, taken in blocks."""

from __future__ import annotations

import hashlib
import heapq
from itertools import accumulate
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.llm.common import seeded, with_prefix

WORDS = r"[^\x20\x09-\x0D]+"
#: Blocks for each source on average, and seats of the smallest target at least; a document never counts more than REPEATS times.
BLOCKS_PER_SOURCE, REPEATS, WEIGHTS = 1000, 3, (5, 2, 1)
ROWS_PER_BUCKET = 50_000
SPAN = 1 << 52


def n_words(text: Column) -> Column:
    """Words without building them: every word is replaced by one sign, the rest by none."""
    signs = F.regexp_replace(F.coalesce(text, F.lit("")), WORDS, "x")
    return F.length(F.regexp_replace(signs, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict:
    """Tokens each source should give: shares of the whole by weight, none above ``repeats`` times its size.

    Sources go by code point, null last, and take the weights in turn. What a
    capped source leaves is shared again by weight until none is above its cap.
    """
    names = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: float(repeats * n) for s, n in sizes}
    total, fixed, free = float(sum(n for _, n in sizes)), {}, list(names)
    while free:
        left, shared = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / shared > cap[s]]
        if not above:
            return fixed | {s: left * weight[s] / shared for s in free}
        fixed |= {s: cap[s] for s in above}
        free = [s for s in free if s not in fixed]
    return fixed


def apportion(votes: dict, seats: int, most: dict | None = None) -> dict:
    """Sainte-Laguë: seats by the highest quotients ``votes / (2 k + 1)``; ties go by name.

    ``most`` bounds a party's seats. The start is a divisor a little too large,
    whose rounded quotas are surely won; the last seats come from a heap.
    """
    won, order = dict.fromkeys(votes, 0), {s: k for k, s in enumerate(sorted(votes, key=lambda s: (s is None, s or "")))}
    total = sum(votes.values())
    if total <= 0 or seats <= 0:
        return won
    most = most or dict.fromkeys(votes, seats)
    divisor = total / max(1, seats) * (1 + (len(votes) + 1) / max(1, seats))
    for s, v in votes.items():
        won[s] = min(most[s], max(0, int(v / divisor + 0.5) - 1))
    heap = [(-votes[s] / (2 * won[s] + 1), order[s], s) for s in votes if votes[s] > 0 and won[s] < most[s]]
    heapq.heapify(heap)
    left = seats - sum(won.values())
    while left > 0 and heap:
        _, k, s = heapq.heappop(heap)
        won[s] += 1
        left -= 1
        if won[s] < most[s]:
            heapq.heappush(heap, (-votes[s] / (2 * won[s] + 1), k, s))
    return won


def affine(n: int, seed: str) -> tuple[int, int]:
    """``(a, c)`` such that ``(a j + c) mod n`` is a permutation of the blocks, drawn from ``seed``."""
    drawn = int(hashlib.md5(seed.encode()).hexdigest()[:12], 16)
    a = max(1, drawn % max(1, n))
    a = min(a, (1 << 31) - 1)
    while gcd(a, n) != 1:
        a += 1
    return a, drawn // 7 % max(1, n)


def plan(sizes: list[tuple[str | None, int]], seed: int, shards: int, blocks_per_source: int = BLOCKS_PER_SOURCE) -> list[tuple]:
    """A row per source: size, target, block length, blocks, quota, how the quota is met, quotas of the shards, part.

    Seats are units of words so short that the smallest target spans many of them; the
    blocks of a source are whole units, of the same length in all sources but those too
    small for it, which have shorter ones. Every block of the source is taken
    ``passes`` times, ``extra`` blocks, the first ones of a seeded permutation, once
    more, and of the next one its first ``part`` words, so that a quota is met to the
    word. ``quotas`` is what each shard gets of the quota, again by Sainte-Laguë; the words
    taken, pass by pass and in each by the permutation of blocks, form one line, which
    ``edges`` cut so that each shard meets its quota to the word. ``last`` is the rank of
    the source's last block, which is ``short`` words shorter.
    """
    want, total = targets(sizes), sum(n for _, n in sizes)
    longest = max(1, total // max(1, blocks_per_source * len(sizes)))
    size = dict(sizes)
    unit = max(1, min([longest, *[int(w / BLOCKS_PER_SOURCE) for w in want.values() if w > 0]]))
    quota = apportion({s: want[s] for s in want}, round(sum(want.values()) / unit), {s: REPEATS * size[s] // unit for s in want})
    out = []
    for s in want:
        block = unit * max(1, min(longest, size[s] // max(1, blocks_per_source)) // unit)
        n = -(-size[s] // block)
        passes, rest = divmod(quota[s] * unit, size[s]) if n else (0, 0)
        a, c = affine(n, f"{seed}|{s}") if n else (1, 0)
        # the source's last block may be short: blocks after it in the permutation start that much earlier
        if n and rest >= ((a * (n - 1) + c) % n + 1) * block - (n * block - size[s]):
            rest += n * block - size[s]
        extra, part = divmod(rest, block)
        per_shard = apportion({str(k).zfill(6): 1.0 for k in range(shards)}, quota[s])
        quotas = [per_shard[k] for k in sorted(per_shard)]
        edges = [unit * e for e in accumulate(quotas, initial=0)]
        last = (a * (n - 1) + c) % n if n else 0
        out.append((s, size[s], float(want[s]), block, n, quota[s], passes, extra, a, c, quotas, part, edges, last, n * block - size[s]))
    return out


ADDED = ("size", "source_size", "target", "taken", "passes", "picked", "shard_words")
PLAN = "source string, source_size long, target double, block long, blocks long, quota long, passes long, extra long, a long, c long, quotas array<long>, part long, edges array<long>, last long, short long"


def mix(docs: DataFrame, seed: int = 11, shards: int = 16, bucket_rows: int = ROWS_PER_BUCKET, blocks_per_source: int = BLOCKS_PER_SOURCE) -> DataFrame:
    """Adds ``size, source_size, target, taken, passes, picked, shard_words`` to ``docs(doc_id, source, text, ...)``.

    The documents of a source stand in seeded order on one line of words, which
    is cut into blocks of equal length (shorter ones in a small source); a document takes what its blocks are
    taken. ``passes`` whole passes over the source are followed by one over the
    blocks in ``picked`` (positions of picked words, as ``[start, stop)`` pairs
    within the document). ``shard_words`` says how many of the taken words each shard
    gets: a block goes to the shard whose quota it fills, and is divided where a quota
    ends, so that every shard holds its quota of every source. The plan has a row per source; only source sizes and
    the plan go through the driver, never rows.

    Null texts have no words and are never taken; a null source is a source; an
    empty table gives no rows. A table without words takes nothing. Other columns are
    carried along; those named like an added one are replaced.
    """
    rows = docs.count()
    buckets = max(1, -(-rows // bucket_rows))
    carried = [c for c in docs.columns if c not in ADDED]
    sized = docs.select(
        F.struct(*carried).alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie")
    )
    sizes = [(r["source"], r["n"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    spark = docs.sparkSession
    plans = spark.createDataFrame(plan(sizes, seed, shards, blocks_per_source), PLAN)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    keyed = sized.withColumn("_source", key).withColumn("_hash", seeded(seed, F.col("doc_id"), F.col("_source")))
    order = [F.col("_hash"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("_tie")]
    lined = with_prefix(
        keyed, ["_source"], F.floor(F.col("_hash") * F.lit(float(buckets)) / F.lit(float(SPAN))), order, F.col("size"), "_offset"
    )
    # a row per source of the mixture, which names its sources one by one
    lined = lined.join(F.broadcast(plans.withColumn("_source", key).drop("source")), "_source")
    blocks = F.expr("if(size = 0, array(), sequence(_offset div block, (_offset + size - 1) div block))")
    picked = F.expr(
        """transform(
             filter(transform(_blocks, j -> struct(j * block - _offset as at, (cast(a as decimal(20)) * j + c) % blocks as rank)),
                    x -> x.rank < extra or (x.rank = extra and x.at + part > 0 and part > 0)),
             x -> array(greatest(x.at, 0L), least(x.at + if(x.rank < extra, block, part), size)))"""
    )
    pieces = F.expr(
        """flatten(transform(sequence(0L, passes), p -> transform(
             filter(transform(_blocks, j -> struct(j * block - _offset as at, cast((cast(a as decimal(20)) * j + c) % blocks as long) as rank)),
                    x -> p < passes or x.rank < extra or (x.rank = extra and x.at + part > 0 and part > 0)),
             x -> struct(
               p * source_size + x.rank * block - if(x.rank > last, short, 0L) + greatest(-x.at, 0L) as start,
               least(x.at + if(p < passes or x.rank < extra, block, part), size) - greatest(x.at, 0L) as n))))"""
    )
    shard_words = F.expr(
        """transform(quotas, (q, k) -> aggregate(_pieces, 0L, (s, x) ->
             s + greatest(0L, least(x.start + x.n, edges[k + 1]) - greatest(x.start, edges[k]))))"""
    )
    return (
        lined.withColumn("_blocks", blocks)
        .withColumn("picked", picked)
        .withColumn("_pieces", pieces)
        .withColumn("shard_words", shard_words)
        .withColumn("taken", F.col("passes") * F.col("size") + F.expr("aggregate(picked, 0L, (s, x) -> s + x[1] - x[0])"))
        .select("_row.*", *ADDED)
    )


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of the mixture, with the columns of ``docs``: each whole pass repeats the document, the last has its picked words."""
    clash = [c for c in docs.columns if c in ADDED]
    full = mix(docs.withColumn("_own", F.struct(*clash)) if clash else docs, seed)
    words = F.expr(
        r"""array_join(filter(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0),
            (w, i) -> exists(picked, p -> i >= p[0] and i < p[1])), ' ')"""
    )
    last = F.when(F.expr("aggregate(picked, 0L, (s, x) -> s + x[1] - x[0])") == F.col("size"), F.col("text")).otherwise(words)
    whole = full.withColumn("_text", F.explode(F.expr("array_repeat(text, cast(passes as int))")))
    part = full.where(F.size("picked") > 0).withColumn("_text", last)
    out = whole.where("size > 0").unionByName(part)
    new = {"text": F.col("_text")} | {c: F.col(f"_own.`{c}`") for c in clash}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
