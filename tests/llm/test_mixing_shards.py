"""Shards of the mixture: every shard meets its quota of every source, and the words are those of the blocks."""

from leasegrain.llm import mixing
from tests.llm.conftest import prose


def plainly(rows, plan, offsets):
    """Words of each document by shard, word by word along the line of taken blocks."""
    out = {}
    for source, size, _, block, n, quota, passes, extra, a, c, quotas, part, edges, *_ in plan:
        owner = {}
        for doc_id, start, length in offsets[source]:
            out[doc_id] = [0] * len(quotas)
            owner |= {start + k: doc_id for k in range(length)}
        order = sorted(range(n), key=lambda j: (a * j + c) % n)
        line = []
        for p in range(passes + 1):
            for rank, j in enumerate(order):
                words = list(range(j * block, min(size, (j + 1) * block)))
                line += words if p < passes or rank < extra else words[:part] if rank == extra else []
        assert len(line) == edges[-1]
        for at, word in enumerate(line):
            out[owner[word]][next(k for k in range(len(quotas)) if at < edges[k + 1])] += 1
    return out


def test_blocks_are_dealt_to_shards_by_their_quotas(spark):
    rows = [(k, f"s{k % 3}", prose(k, 5 + 3 * (k % 40))) for k in range(120)] + [(900 + k, "tiny", prose(k, 3)) for k in range(2)]
    rows += [(950, None, prose(7, 60)), (951, "s1", None), (952, "s1", " "), (953, "empty", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(docs, shards=5, bucket_rows=20, blocks_per_source=7).collect()}
    sizes = {}
    for r in got.values():
        sizes[r.source] = r.source_size
    plan = mixing.plan(list(sizes.items()), 11, 5, 7)
    # the seeded order of documents, restated
    import hashlib

    def rank(r):
        return int(hashlib.md5(f"11|{r.doc_id}|{'n' if r.source is None else 's' + r.source}".encode()).hexdigest()[:13], 16)

    offsets = {}
    for source in sizes:
        at, offsets[source] = 0, []
        for r in sorted((r for r in got.values() if r.source == source), key=lambda r: (rank(r), r.doc_id)):
            offsets[source].append((r.doc_id, at, r.size))
            at += r.size
    want = plainly(rows, plan, offsets)
    assert {k: r.shard_words for k, r in got.items()} == want
    assert all(sum(r.shard_words) == r.taken for r in got.values())
    for source, *_, quotas, part, edges, last, short in plan:
        unit = edges[-1] // max(1, sum(quotas))
        assert [sum(r.shard_words[k] for r in got.values() if r.source == source) for k in range(5)] == [q * unit for q in quotas]
