"""Ranked lexical search of many items at once, each shared part of their scores computed once.

A score is a sum over an item's terms. Terms that the same items hold equally often
form one class, the largest set those items share. Items become sequences of
classes, commonest first; as long as two neighbours stand in several items, the
commonest pair becomes a node of its own. What is left is a graph of partial sums
in which items share nodes. Documents are tokenised once into postings of asked
terms; then a task fills, per block of documents, one accumulator per node and
keeps its best documents per item.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import floor, log

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.llm.common import map_arrow, slices, with_prefix
from leasegrain.session import staged

BEST = 10
#: Terms (with repeats) of the items that are searched together; one longer item is a block of its own.
BLOCK_TERMS = 1 << 18
#: Accumulators, as long integers, that a task holds at once.
CELLS = 1 << 22
SCALE = 1_000_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order and with repeats."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


# ---- items


def _item_terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, "text"):
        ids, found, times = [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            counts = Counter(terms(text))
            ids += [item] * len(counts)
            found += counts.keys()
            times += counts.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.int64())], ["item_id", "term", "n"])


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, n, block`` of ``items(item_id, text)``; rows of one id are one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    counted = map_arrow(rows, _item_terms, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    counted = staged(counted, "item-terms")
    sizes = counted.groupBy("item_id").agg(F.sum("n").alias("size")).withColumn("_all", F.lit(0))
    key = F.coalesce("item_id", F.lit(-(1 << 62)))
    before = with_prefix(sizes.withColumn("_key", key), ["_all"], F.floor(F.col("_key") / 10_000), [F.col("_key")], F.col("size"), "before")
    blocks = before.select(F.col("item_id").alias("_item"), F.floor((F.col("before") + F.col("size") - 1) / BLOCK_TERMS).alias("block"))
    return staged(counted.join(blocks, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item"), "item-terms")


class Graph:
    """The shared sums of a block of items.

    ``vocabulary`` maps a term to its column; ``starts`` are the first columns of
    the classes; a node is ``(a, b, None)``, the sum of two nodes, or
    ``(class, None, times)``; ``roots`` gives the nodes that add up to each item.
    """

    def __init__(self, found: list[tuple[int | None, bytes, int]]) -> None:
        held: dict[bytes, list] = defaultdict(list)
        for item, term, n in found:
            held[term].append((item, n))
        alike: dict[tuple, list[bytes]] = defaultdict(list)
        for term, users in held.items():
            alike[tuple(sorted(users, key=lambda u: (u[0] is not None, u[0] or 0)))].append(term)
        # commonest classes first, so that what items share stands together in their sequences
        order = sorted(alike, key=lambda users: (-len(users), min(alike[users])))
        self.vocabulary: dict[bytes, int] = {}
        self.starts: list[int] = []
        self.nodes: list[tuple[int, int | None, int | None]] = []
        sequences: dict[int | None, list[int]] = defaultdict(list)
        for k, users in enumerate(order):
            self.starts.append(len(self.vocabulary))
            for term in sorted(alike[users]):
                self.vocabulary[term] = len(self.vocabulary)
            leaves: dict[int, int] = {}
            for item, n in users:
                if n not in leaves:
                    leaves[n] = len(self.nodes)
                    self.nodes.append((k, None, n))
                sequences[item].append(leaves[n])
        self.items = list(sequences)
        self.roots = self._share([sequences[i] for i in self.items])

    def _share(self, sequences: list[list[int]]) -> list[list[int]]:
        """Replace neighbours that stand in several items by nodes, the commonest first."""
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, s in enumerate(sequences):
            for pair in zip(s, s[1:]):
                where[pair].add(k)
        queue = [(-len(w), pair) for pair, w in where.items() if len(w) > 1]
        heapq.heapify(queue)
        while queue:
            n, pair = heapq.heappop(queue)
            users = where[pair]
            if len(users) < 2 or -n != len(users):
                if len(users) > 1:
                    heapq.heappush(queue, (-len(users), pair))
                continue
            node = len(self.nodes)
            self.nodes.append((*pair, None))
            touched = set()
            for k in list(users):
                s = sequences[k]
                at = next(i for i in range(len(s) - 1) if (s[i], s[i + 1]) == pair)
                for old in zip(s[max(0, at - 1) : at + 2], s[max(0, at - 1) + 1 : at + 3]):
                    where[old].discard(k)
                s[at : at + 2] = [node]
                for new in zip(s[max(0, at - 1) : at + 1], s[max(0, at - 1) + 1 : at + 2]):
                    where[new].add(k)
                    touched.add(new)
            for new in touched:
                if len(where[new]) > 1:
                    heapq.heappush(queue, (-len(where[new]), new))
        return sequences

    def sums(self, cells: np.ndarray) -> list[np.ndarray]:
        """Every node's accumulator, from ``cells`` (a row per term, a column per document)."""
        classes = np.add.reduceat(cells, self.starts, axis=0)
        out: list[np.ndarray] = []
        for a, b, times in self.nodes:
            out.append(classes[a] * times if b is None else out[a] + out[b])
        return out


# ---- documents


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, found, times`` of every row with a term; ``found`` are the columns of the asked terms it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        asked = shared.value
        for batch in slices(batches, "text"):
            ids, sizes, found, times = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms(text)
                if words:
                    counts = [(asked[w], n) for w, n in Counter(words).items() if w in asked]
                    ids.append(doc)
                    sizes.append(len(words))
                    found.append([c[0] for c in counts])
                    times.append([c[1] for c in counts])
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "found", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, n long, found array<int>, times array<long>")


def _frequencies(batches: Iterator) -> Iterator:
    """Of a task: rows, their terms, and how many rows hold each asked term (``term`` -1 and -2 are the first two)."""
    import pyarrow as pa

    rows, length, df = 0, 0, np.zeros(0, np.int64)
    for batch in batches:
        rows += batch.num_rows
        length += int(batch.column("n").to_numpy(zero_copy_only=False).sum())
        now = np.bincount(batch.column("found").flatten().to_numpy(zero_copy_only=False), minlength=len(df))
        now[: len(df)] += df
        df = now
    there = np.flatnonzero(df)
    terms_, values = np.concatenate([[-1, -2], there]), np.concatenate([[rows, length], df[there]])
    yield pa.RecordBatch.from_arrays([pa.array(terms_, pa.int64()), pa.array(values, pa.int64())], ["term", "value"])


def top(held: list[tuple], best: int) -> tuple:
    """The ``best`` of several (score, id) arrays: highest score first, then smallest id, null ids (the largest long) last."""
    score, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    if len(score) > best:
        least = np.partition(score, len(score) - best)[len(score) - best]
        keep = score >= least
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:best]
    return score[order], ids[order]


NO_ID = (1 << 63) - 1


def best_of(found: DataFrame, graph: Graph, best: int) -> DataFrame:
    """``item, doc_id, score``: of every task of postings the ``best`` rows of each item, by the item's place in the graph."""
    counts = {r.term: r.value for r in map_arrow(found.select("n", "found"), _frequencies, "term long, value long").groupBy("term").agg(F.sum("value").alias("value")).collect()}
    rows, length = counts.get(-1, 0), max(counts.get(-2, 0), 1)
    weights = np.array([floor(1000 * log((2 * rows + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(graph.vocabulary))], np.int64)
    shared = found.sparkSession.sparkContext.broadcast((graph, weights))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        graph, weights = shared.value
        kept: dict[int, tuple] = {}
        step = max(1, CELLS // max(1, len(weights) + len(graph.nodes)))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                n = batch.column("n").to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                term = batch.column("found").flatten().to_numpy(zero_copy_only=False)
                tf = batch.column("times").flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(n)), batch.column("found").value_lengths().to_numpy(zero_copy_only=False))
                m = 25 + 75 * n * rows // length
                cells = np.zeros((len(weights), len(n)), np.int64)
                cells[term, doc] = weights[term] * (SCALE * tf // (1000 * tf + 8 * m[doc]))
                sums = graph.sums(cells)
                for item, nodes in enumerate(graph.roots):
                    score = sum(sums[x] for x in nodes)
                    floor_ = kept[item][0][-1] if item in kept and len(kept[item][0]) == best else 1
                    at = np.flatnonzero(score >= floor_)
                    if len(at):
                        new = (score[at], ids[at])
                        kept[item] = top([kept[item], new] if item in kept else [new], best)
        for item, (score, ids) in kept.items():
            docs = pa.array(ids, mask=ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int64)), docs, pa.array(score)], ["item", "doc_id", "score"])

    return map_arrow(found, run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``best`` rows of ``docs(doc_id, text)`` for every item of ``items(item_id, text)``.

    Null and blank texts hold no term: such rows are no documents, such items have
    no result. Rows that repeat a ``doc_id`` are documents of their own; rows that
    repeat an ``item_id`` are one item. Equal scores rank by ascending id, a null
    id last. Other columns are ignored. Items are searched in blocks of about
    ``BLOCK_TERMS`` terms, which bounds what is sent to the tasks.
    """
    asked = item_terms(items)
    blocks = [r.block for r in asked.select("block").distinct().orderBy("block").toLocalIterator()]
    out = None
    for block in blocks:
        graph = Graph([tuple(r) for r in asked.where(F.col("block") == block).select("item_id", "term", "n").collect()])
        found = staged(postings(docs, graph.vocabulary), "postings")
        names = docs.sparkSession.createDataFrame(list(enumerate(graph.items)), "item long, item_id long")
        part = best_of(found, graph, best)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        part = part.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best)
        part = staged(part.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
