"""Connected components by stars: right components, and no round after the first table of stars."""

import random

from leasegrain.llm import common, similar


def plain(ids, edges):
    group = {k: k for k in ids}
    for a, b in edges:
        x, y = group[a], group[b]
        group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    return group


def rounds(monkeypatch, spark, ids, edges):
    tables, staged = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, label: tables.append(label) or staged(df, label))
    nodes, links = spark.createDataFrame([(k,) for k in ids], "id long"), spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in common.components(nodes, links).collect()}
    monkeypatch.setattr(common, "staged", staged)
    assert got == plain(ids, edges)
    return len(tables) - 1


def test_stars_need_no_round_and_chains_end_with_their_star(spark, monkeypatch):
    stars = [(k, k // 10 * 10) for k in range(40) if k % 10] + [(10, 11), (5, 5)]
    assert rounds(monkeypatch, spark, range(45), stars) == 0
    assert rounds(monkeypatch, spark, range(3), [(1, 0), (2, 1)]) == 1
    r = random.Random(3)
    assert rounds(monkeypatch, spark, range(60), [(r.randrange(60), r.randrange(60)) for _ in range(45)]) > 0
    assert rounds(monkeypatch, spark, range(-9, 20), [(k, k + 1) for k in range(-9, 12)]) > 1


def test_further_links_merge_components(spark):
    r = random.Random(4)
    ids, first = range(50), [(r.randrange(50), r.randrange(50)) for _ in range(25)]
    more = [(r.randrange(50), r.randrange(50)) for _ in range(12)] + [(7, 8), (8, 9), (7, 8)]
    found = spark.createDataFrame(list(plain(ids, first).items()), "id long, component long")
    got = similar.merged(found, spark.createDataFrame(more, "a long, b long")).collect()
    assert len(got) == 50 and {x.id: x.component for x in got} == plain(ids, first + more)
