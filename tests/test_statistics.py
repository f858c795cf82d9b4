import random

import pytest
from pyspark.sql import functions as F

from leasegrain.operators.statistics import (
    _value_bin, expected_days, km_steps, survival_at, weighted_median, weighted_quantile, weighted_quantiles,
)
from tests import plain
from tests.raised import RAISED


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lower_median_of_even_count_takes_the_lower_value(spark):
    rows = [(1, 10.0, 1.0), (1, 20.0, 1.0), (1, 30.0, 1.0), (1, 40.0, 1.0)]
    df = frame(spark, rows, "k int, v double, weight double")
    assert [r.median for r in weighted_median(df, ["k"], "v").collect()] == [20.0]


def test_weight_zero_is_no_evidence_and_keys_without_evidence_have_no_row(spark):
    rows = [(1, 10.0, 0.0), (2, 5.0, 0.0), (2, 7.0, 2.0), (3, None, 1.0)]
    df = frame(spark, rows, "k int, v double, weight double")
    assert {(r.k, r.median) for r in weighted_median(df, ["k"], "v").collect()} == {(2, 7.0)}


def test_negative_weight_is_an_error(spark):
    df = frame(spark, [(1, 10.0, -1.0)], "k int, v double, weight double")
    with pytest.raises(RAISED, match="non-negative"):
        weighted_median(df, ["k"], "v").collect()


def test_quantile_outside_the_unit_interval_is_an_error(spark):
    df = frame(spark, [(1, 10.0, 1.0)], "k int, v double, weight double")
    with pytest.raises(ValueError):
        weighted_quantile(df, ["k"], "v", q=1.5)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_agree_with_a_sequential_scan(spark, q):
    rng = random.Random(7)
    rows = []
    for key in range(60):
        scale = rng.choice([0.001, 1.0, 300.0, -5.0])
        for _ in range(rng.randint(1, 40)):
            rows.append((key, round(rng.uniform(-1, 4), rng.choice([0, 1, 6])) * scale, float(rng.randint(0, 4))))
    df = frame(spark, rows, "k int, v double, weight double")
    mine = {r.k: r.quantile for r in weighted_quantile(df, ["k"], "v", q=q).collect()}
    for key in range(60):
        expected = plain.lower_quantile([(v, w) for k, v, w in rows if k == key], q)
        assert mine.get(key) == expected


def test_one_huge_group_of_near_equal_values(spark):
    """All values in very few bins, and all rows in one group."""
    df = spark.range(20000).selectExpr("1 AS k", "1.0 + id / 1e9 AS v", "1.0 AS weight")
    assert weighted_median(df, ["k"], "v").first().median == 1.0 + 9999 / 1e9


def test_weight_n_equals_n_copies(spark):
    rng = random.Random(3)
    rows = [(1, rng.uniform(0, 9), float(rng.randint(1, 5))) for _ in range(50)]
    copies = [(k, v, 1.0) for k, v, w in rows for _ in range(int(w))]
    schema = "k int, v double, weight double"
    one = weighted_median(frame(spark, rows, schema), ["k"], "v").first().median
    assert one == weighted_median(frame(spark, copies, schema), ["k"], "v").first().median


KM = "k int, effective_dom int, censored boolean, weight double"


def test_curves_agree_with_a_sequential_estimate(spark):
    rng = random.Random(11)
    rows = [
        (k, rng.randint(0, 20), rng.random() < 0.4, rng.choice([0.0, 0.5, 1.0, 3.0]))
        for k in range(80)
        for _ in range(rng.randint(1, 25))
    ]
    df = frame(spark, rows, KM)
    steps = km_steps(df, ["k"])
    found: dict[int, list] = {}
    for r in steps.orderBy("k", "day").collect():
        found.setdefault(r.k, []).append(r)
    for k in range(80):
        mine = [(d, c, w) for key, d, c, w in rows if key == k]
        expected = plain.survival(mine)
        got = found.get(k, [])
        assert [(r.day, r.at_risk, r.events) for r in got] == [(d, n, e) for d, _, n, e in expected]
        for r, (_, s, _, _) in zip(got, expected):
            assert r.survival == pytest.approx(s, rel=1e-12, abs=1e-12)
            assert r.truncated_at == max(d for d, _, w in mine if w > 0)
        levels = [1.0] + [r.survival for r in got]
        assert all(b <= a for a, b in zip(levels, levels[1:]))
    keys = df.select("k").distinct()
    for r in survival_at(keys, steps, ["k"], [0, 5, 14, 30]).collect():
        reached = [s for d, s, *_ in plain.survival([(d, c, w) for key, d, c, w in rows if key == r.k]) if d <= r.day]
        assert r.survival == pytest.approx(reached[-1] if reached else 1.0, abs=1e-12)
    limits = keys.selectExpr("k", "cast(k % 25 as int) AS t")
    for r in expected_days(limits, steps, ["k"], "t").collect():
        expected = plain.area(plain.survival([(d, c, w) for key, d, c, w in rows if key == r.k]), r.t)
        assert r.days == pytest.approx(expected, abs=1e-9)


def test_censored_on_the_event_day_is_still_at_risk(spark):
    df = frame(spark, [(1, 5, False, 1.0), (1, 5, True, 1.0), (1, 9, False, 2.0)], KM)
    steps = km_steps(df, ["k"]).orderBy("day").collect()
    assert [(r.day, r.at_risk, r.events, r.censored_count) for r in steps] == [(5, 4.0, 1.0, 1), (9, 2.0, 2.0, 0)]
    assert [r.survival for r in steps] == [0.75, 0.0]


def test_all_censored_has_no_steps(spark):
    assert km_steps(frame(spark, [(1, 5, True, 1.0)], KM), ["k"]).count() == 0


@pytest.mark.parametrize("days", [-1.0, 2.5])
def test_durations_must_be_whole_days(spark, days):
    df = frame(spark, [(1, days, False, 1.0)], KM.replace("effective_dom int", "effective_dom double"))
    with pytest.raises(RAISED, match="whole"):
        km_steps(df, ["k"]).collect()


def test_values_near_zero_spread_over_many_bins(spark):
    df = spark.range(1, 1001).selectExpr("1 AS k", "id / 1e7 AS v", "1.0D AS weight")
    assert df.select(_value_bin(F.col("v"))).distinct().count() > 990
    assert weighted_median(df, ["k"], "v").first().median == 500 / 1e7


def test_bins_follow_the_order_of_values(spark):
    values = [float("-inf"), -1.7e308, -3.0, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 3.0, 1.7e308, float("inf"), float("nan")]
    bins = [r.b for r in frame(spark, [(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(_value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(set(bins))


def test_several_quantiles_share_one_scan(spark):
    df = spark.range(1, 101).selectExpr("id % 2 AS k", "cast(id AS double) AS v", "1.0D AS weight")
    found = {tuple(r) for r in weighted_quantiles(df, ["k"], "v", "weight", {"a": 0.0, "b": 0.5, "c": 1.0}).collect()}
    assert found == {(0, 2.0, 50.0, 100.0), (1, 1.0, 49.0, 99.0)}
