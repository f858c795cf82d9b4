"""The pipeline's near-duplicates against brute force over five-word shingles."""

import random

from leasegrain.llm import similar
from tests.llm.conftest import prose


def plain(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_groups_are_those_of_brute_force(spark, none):
    r, texts = random.Random(8), [None, "", "three words here", "Three  words HERE", prose(1, 12)]
    for k in range(40):
        words = prose(500 + k, 120).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4):  # Jaccard similarities from about 0.7 to 0.95
            other = list(words)
            for at in r.sample(range(120), edits):
                other[at] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(other))
    line = prose(77, 30)  # a passage in half of the texts does not make them alike
    texts = [f"{t} {line}" if k > 5 and k % 2 else t for k, t in enumerate(texts)]
    sets, group = [plain(t) for t in texts], list(range(len(texts)))
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert pairs > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in similar.similar_components(docs).collect()}
    assert got == dict(enumerate(group))
    assert {x.doc_id for x in similar.keep_first(docs).collect()} == set(group)
    assert similar.keep_first(none).count() == 0


def test_any_similar_set_shares_a_shingle_of_the_prefix():
    import numpy as np

    r, counts = np.random.default_rng(3), np.random.default_rng(4).integers(0, 5, 1 << similar.CELL_BITS)
    for n in range(1, 60):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for cut in range(n // 5 + 1):
            b = a[cut:] if cut else a
            if 5 * len(b) >= 4 * len(a):
                assert len(np.intersect1d(similar.prefix(a, counts), similar.prefix(b, counts)))


def test_kept_rows_are_whole_rows_once(spark):
    text = prose(3, 40)
    rows = [(1, text, "a", 1, True), (1, text, "a", 1, True), (1, text, "b", 1, True), (2, text, "a", 2, False), (None, text, "a", 3, False), (None, text, "a", 3, False), (5, "other words", "a", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, id long, _hit boolean")
    got = sorted(similar.keep_first(docs).collect(), key=str)
    # the smallest id of a group keeps its different rows; rows without an id are no copies of others
    assert sorted(map(tuple, got), key=str) == sorted({rows[0], rows[2], rows[4], rows[6]}, key=str)


def test_one_shuffle_finds_shared_shingles(spark):
    docs = spark.createDataFrame([(k, prose(k % 7, 30)) for k in range(20)], "doc_id long, text string")
    plan = similar.shared_prefixes(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_of_keys_miss_nothing(spark):
    from leasegrain.llm.common import key_filter, may_be_in

    keys = spark.range(0, 4000, 7).withColumnRenamed("id", "k")
    marked = may_be_in(spark.range(4000), "id", key_filter(keys, "k")).collect()
    assert all(r._hit for r in marked if r.id % 7 == 0) and sum(r._hit for r in marked) < 600


def test_parities_rule_out_no_similar_sets(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r, rows, similar_pairs = np.random.default_rng(6), [], set()
    for k in range(300):
        whole = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 900)), dtype=np.uint64))
        other = np.union1d(whole[: max(1, int(len(whole) * r.uniform(0.5, 1)))], r.integers(0, 1 << 63, int(len(whole) * r.uniform(0, 0.4)), dtype=np.uint64))
        if 5 * len(np.intersect1d(whole, other)) >= 4 * len(np.union1d(whole, other)):
            similar_pairs.add(k)
        rows += [(k, side, len(s), similar.parity(s).tolist()) for side, s in (("x", whole), ("y", other))]
    marks = spark.createDataFrame(rows, "k int, side string, n int, parity array<long>")
    x, y = (marks.where(F.col("side") == side).alias(side) for side in "xy")
    left = {row.k for row in x.join(y, F.col("x.k") == F.col("y.k")).where(similar.parities_allow("x", "y")).select("x.k").collect()}
    assert similar_pairs <= left and len(similar_pairs) > 20 and len(left) < len(similar_pairs) + 40


def test_pairs_that_share_many_shingles_meet_once(spark):
    import numpy as np
    from pyspark.sql import functions as F

    base, rows, texts = prose(41, 150).split(), [], []
    for k in range(30):
        words = list(base)
        words[(5 * k) % 150] = f"new{k}"
        words[(7 * k + 3) % 150] = f"old{k}"
        texts.append(" ".join(words))
    texts += [prose(42, 60) + " " + prose(43, 30), prose(44, 60) + " " + prose(43, 30)]
    for k, text in enumerate(texts):
        s = similar.shingles(text)
        rows += [(int(x), k, k, len(s), *similar.bitmap(s).tolist()) for x in s.view(np.int64)]
    there = spark.createDataFrame(rows, "shingle long, key long, component long, n int, " + ", ".join(f"{m} long" for m in similar.MAPS))
    a, b = there.alias("a"), there.alias("b")
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.key") < F.col("b.key")) & similar.may_be_similar("a", "b"))
    want = {tuple(x) for x in met.select("a.key", "b.key").distinct().collect()}
    got = [tuple(x) for x in similar.open_pairs(similar.with_least(there)).collect()]
    # all pairs, and hardly any twice; there are over fifty rows a pair without it
    assert set(got) == want and len(want) > 100
    assert len(got) < 1.2 * len(want) and met.count() > 50 * len(want)
