"""The manifest against a tree built from sorted rows."""

import hashlib
import zlib

from pyspark.sql import functions as F

from leasegrain.llm import manifest
from tests.llm.conftest import COLUMNS


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h([field(row[0]), field(row[3]), field(row[2]), field(row[4]), field(text)])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def restated(rows, changed):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: tree([leaf(r, r[1]) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            sides = path(trees[s], i) + path(top, j)
            other = leaf(r, changed(r))
            for a, b in sides:
                other = h([a, other, b])
            out.append((r[0], s, trees[s][0][i], trees[s][-1][0], top[-1][0], h([x for ab in sides for x in ab]), other))
    return sorted(out, key=str)


def proved(frame, changed):
    found = manifest.prove(frame, other=manifest.leaf_digest(changed))
    sides = (F.col("lefts"), F.col("rights"))
    return found.select("doc_id", "source", "leaf", "subroot", "root", manifest.proof_digest(*sides), manifest.folded(F.col("other"), *sides))


def test_awkward_rows_give_the_tree_of_the_sorted_table(docs, rows, none):
    got = proved(docs, F.upper("text")).collect()
    assert sorted(map(tuple, got), key=str) == restated(rows, lambda r: r[1] and r[1].upper())
    assert manifest.prove(none).count() == 0


def test_many_leaves_repeated_ids_and_distant_ids(spark):
    ids = [*range(2500), *[7] * 40, *[-5, -4097, 1 << 40, (1 << 40) + 1], *range(9000, 9020)]
    rows = [(d, f"t{k % 3 if d == 7 else k}", "en", "hot" if k % 4 else None, k % 2, 0, 0, 0.0) for k, d in enumerate(ids)]
    got = proved(spark.createDataFrame(rows, COLUMNS).repartition(7), F.concat("text", F.lit(""))).collect()
    want = restated(rows, lambda r: r[1])
    assert sorted(map(tuple, got), key=str) == want
    assert all(r[6] == r[4] for r in want)


def test_ranks_follow_the_containers_kind(spark):
    ids = [3, 900, 4095, *range(5000, 5200, 2)]
    rows = spark.createDataFrame([("k", d >> 12, d & 4095, f"{zlib.crc32(str(d).encode()):08x}") for d in ids], "key string, chunk long, low int, leaf string")
    places = {(r.chunk << 12) + r.low: r.pos for r in manifest.placed(rows).collect()}
    assert places == {d: k for k, d in enumerate(sorted(ids))}
    kinds = {r.chunk: r.words is None for r in manifest.directory(rows).collect()}
    assert kinds == {0: True, 1: False}
