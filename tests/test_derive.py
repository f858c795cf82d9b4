import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leasegrain.config import Knobs
from leasegrain.operators import cohorts, curation, price_test, views
from leasegrain.plans.derive import derive, lazy, meta
from leasegrain.session import staged
from leasegrain.schemas import CUTS
from tests.raised import RAISED

AS_OF = date(2026, 7, 27)
COMP = (
    "pull_ref string, as_of date, comp_key string, group_key string, first_listed date, lat double, lng double, "
    "psf double, cohort_year int, effective_dom int, censored boolean, removal_class string, withdrawal_suspect boolean, "
    "address string, unit string, beds double, baths double, sqft double, initial_ask double, relist_count int, gap_days int"
)
REQUEST = (
    "request_id string, pull_ref string, subject_lat double, subject_lng double, subject_sqft double, drift_pct double, "
    "candidate_rent double, max_distance_mi double, hide_censored boolean, leased_only boolean"
)


def comp(key, psf=2.0, year=2026, dom=30, kind="confirmed", lat=41.8, **more):
    row = dict(
        pull_ref="p", as_of=AS_OF, comp_key=key, group_key=key, first_listed=date(year, 6, 1), lat=lat, lng=-87.7, psf=psf,
        cohort_year=year, effective_dom=dom, censored=kind is None, removal_class=kind, withdrawal_suspect=False,
        address=key, unit=None, beds=2.0, baths=1.0, sqft=1000.0 if psf else None,
        initial_ask=1000.0 * (psf or 2.0), relist_count=0, gap_days=0,
    )
    row.update(more)
    return row


def request(**more):
    row = dict(
        request_id="r", pull_ref="p", subject_lat=41.8, subject_lng=-87.7, subject_sqft=1000.0, drift_pct=7.0,
        candidate_rent=None, max_distance_mi=None, hide_censored=False, leased_only=False,
    )
    row.update(more)
    return row


def frames(spark, comps, requests, weights, overrides):
    names = [c.split()[0] for c in COMP.split(", ")]
    frame = spark.createDataFrame([tuple(c[n] for n in names) for c in comps], COMP)
    names = [c.split()[0] for c in REQUEST.split(", ")]
    return (
        spark.createDataFrame([tuple(r[n] for n in names) for r in requests], REQUEST),
        frame.withColumn("cut_history", F.array().cast(CUTS)),
        spark.createDataFrame(weights, "request_id string, comp_key string, weight double"),
        spark.createDataFrame(overrides, "request_id string, comp_key string"),
    )


# One pull and one request per case; all are derived in one run, as requests are.
CASES = {
    "weights": dict(
        comps=[comp("a"), comp("b", psf=None), comp("c", psf=None), comp("d")], weights={"c": 2.0, "d": 0.0}
    ),
    "filters": dict(
        comps=[comp("near"), comp("far", lat=42.8), comp("open", kind=None), comp("pending", kind="pending"), comp("kept", lat=42.8), comp("zero", lat=42.8)],
        ask=dict(max_distance_mi=5.0, leased_only=True), weights={"zero": 0.0}, overrides=["kept", "zero"],
    ),
    "filtered_zero": dict(comps=[comp("a", lat=42.8)], ask=dict(max_distance_mi=1.0), weights={"a": 0.0}),
    "thin": dict(
        comps=[comp(f"x{n}", psf=float(n)) for n in range(1, 6)] + [comp("alone", year=2024, psf=None)], weights={"x4": 0.0, "x5": 0.0}
    ),
    "at_minimum": dict(comps=[comp(f"x{n}", psf=float(n)) for n in range(1, 6)], weights={"x5": 0.0}),
    "ages": dict(comps=[comp("a", psf=2.0, year=2024), comp("b", psf=2.2, year=2025), comp("c", psf=9.0, year=2026)]),
    "no_area": dict(comps=[comp("a", psf=None)], ask=dict(candidate_rent=2000.0)),
    "outcomes": dict(
        comps=[comp("a", dom=10), comp("b", dom=20), comp("c", dom=99, kind="pending"), comp("d", dom=55, kind=None), comp("e", dom=40, kind="provisional")]
    ),
    "far_rent": dict(
        comps=[comp(f"c{n}", psf=2.0 * (1 + p)) for n, p in enumerate([-0.02, -0.01, 0.0, 0.0, 0.01, 0.04, 0.10])],
        ask=dict(candidate_rent=2330.0, drift_pct=0.0),
    ),
    "all_open": dict(comps=[comp(f"c{n}", kind=None) for n in range(4)], ask=dict(candidate_rent=2000.0)),
    "curve": dict(
        comps=[comp("a", dom=10), comp("b", dom=20, kind="pending"), comp("c", dom=30, kind=None), comp("d", dom=40)],
        ask=dict(candidate_rent=2000.0, drift_pct=0.0),
    ),
    "ties": dict(comps=[comp(f"k{n:02d}", dom=90 - n) for n in range(12)], ask=dict(candidate_rent=2000.0, drift_pct=0.0)),
    "words": dict(
        comps=[comp("a", kind=None, dom=9), comp("b", dom=9), comp("c", dom=9, kind="provisional"), comp("d", dom=9, kind="pending", first_listed=AS_OF - timedelta(days=11))]
    ),
    "by_hand": dict(comps=[comp("a", lat=42.8), comp("b", lat=42.8, psf=None)], ask=dict(max_distance_mi=1.0), overrides=["a"]),
}


@pytest.fixture(scope="module")
def inputs(spark):
    comps, requests, weights, overrides = [], [], [], []
    for name, c in CASES.items():
        comps += [{**row, "pull_ref": name} for row in c["comps"]]
        requests.append(request(**{"request_id": name, "pull_ref": name, **c.get("ask", {})}))
        weights += [(name, key, w) for key, w in c.get("weights", {}).items()]
        overrides += [(name, key) for key in c.get("overrides", [])]
    return frames(spark, comps, requests, weights, overrides)


NAMES = (
    "comps", "cohorts", "anchor_edges", "anchor", "buckets", "censored_floors", "price_test", "neighbors", "edge_neighbors",
    "curve", "horizons", "breakdown", "warnings",
)


def collected(inputs):
    return {name: df.collect() for name, df in derive(*inputs, keep=staged).items() if name in NAMES}


@pytest.fixture(scope="module")
def derived(inputs):
    return collected(inputs)


@pytest.fixture
def rows(derived):
    def of(case, table):
        return [r for r in derived[table] if r.request_id == case]

    return of


def states(rows, case):
    return {r.comp_key: r.state for r in rows(case, "comps")}


def test_weights_default_to_one_or_zero_without_area_and_requested_ones_win(rows):
    found = {r.comp_key: (r.weight, r.state) for r in rows("weights", "comps")}
    assert found == {"a": (1.0, "included"), "b": (0.0, "excluded"), "c": (2.0, "included"), "d": (0.0, "excluded")}
    shares = {r.comp_key: r.contribution_share for r in rows("weights", "comps")}
    assert shares["a"] == pytest.approx(1 / 3) and shares["c"] == pytest.approx(2 / 3) and shares["b"] is None


def test_filters_relabel_and_overrides_lift_only_filters(rows):
    assert states(rows, "filters") == {
        "near": "included", "far": "filtered", "open": "filtered", "pending": "filtered", "kept": "included", "zero": "excluded",
    }
    (b,) = rows("filters", "breakdown")
    assert b.included + b.excluded + b.filtered == b.pulled == 6


def test_filtered_wins_over_weight_zero(rows):
    assert states(rows, "filtered_zero") == {"a": "filtered"}


def test_thin_cohort_falls_back_to_all_pulled_comps_at_weight_one(rows):
    by_year = {r.cohort_year: r for r in rows("thin", "cohorts")}
    assert (by_year[2026].selected_count, by_year[2026].thin, by_year[2026].basis, by_year[2026].median_psf) == (3, True, "pulled", 3.0)
    assert (by_year[2024].median_psf, by_year[2024].basis, by_year[2024].pulled_count) == (None, None, 0)
    (r,) = rows("at_minimum", "cohorts")
    assert (r.selected_count, r.thin, r.basis, r.median_psf) == (4, False, "selected", 2.0)


def test_anchor_moves_each_comp_by_its_own_age(rows):
    edges = {r.edge: r for r in rows("ages", "anchor_edges")}
    for edge, drift in (("low", 5.0), ("mid", 7.0), ("high", 9.0)):
        rate = 1 + drift / 100
        expected = sorted([2.0 * rate**2, 2.2 * rate, 9.0])[1]
        assert edges[edge].anchor_psf == pytest.approx(expected, rel=1e-12)
        assert edges[edge].anchor_rent == pytest.approx(expected * 1000.0, rel=1e-12)
    assert edges["mid"].n_comps == 3


def test_no_evidence_gives_no_anchor_but_a_warning(rows):
    assert rows("no_area", "anchor") == [] and rows("no_area", "price_test") == []
    assert {(r.code, r.n) for r in rows("no_area", "warnings")} == {("missing_sqft", 1), ("no_anchor", None)}
    assert sorted((r.bucket_order, r.bucket, r["count"], r.leased_dom_median) for r in rows("no_area", "buckets")) == [
        (0, "below", 0, None), (1, "at", 0, None), (2, "above", 0, None),
    ]


@pytest.mark.parametrize("value, bucket", [(-0.0401, "below"), (-0.04, "at"), (0.0, "at"), (0.04, "at"), (0.0401, "above"), (None, None)])
def test_bucket_edges_belong_to_the_middle(spark, value, bucket):
    df = spark.createDataFrame([(value,)], "p double").select(cohorts.bucket_of(F.col("p"), 4.0).alias("b"))
    assert df.first().b == bucket


def test_bucket_statistics_leave_out_pending_and_open(rows):
    (at,) = [r for r in rows("outcomes", "buckets") if r.bucket == "at"]
    assert (at["count"], at.leased_count, at.leased_dom_median, at.leased_dom_min, at.leased_dom_max, at.provisional_count, at.thin) == (5, 3, 20.0, 10, 40, 1, True)
    assert [(r.effective_dom, r.n) for r in rows("outcomes", "censored_floors")] == [(55, 1)]


def test_guard_without_nearby_evidence(rows):
    """Evidence at -2 % to +4 % and +10 %, a candidate at about +16 %."""
    (row,) = rows("far_rent", "price_test")
    assert (row.state, row.reason, row.days_mid) == ("guard", "too_few_in_range", None)
    assert rows("far_rent", "curve") == [] and len(rows("far_rent", "neighbors")) == 7


def test_guard_when_every_neighbor_is_open(rows):
    (row,) = rows("all_open", "price_test")
    assert (row.state, row.reason) == ("guard", "all_censored")


def test_curve_counts_pending_as_an_end(rows):
    (row,) = rows("curve", "price_test")
    assert (row.state, row.truncated_at, row.bucket) == ("curve", 40, "at")
    steps = sorted((r.day, r.survival) for r in rows("curve", "curve") if r.edge == "mid")
    assert steps == [(10, 0.75), (20, pytest.approx(0.5)), (40, 0.0)]
    assert row.days_mid == pytest.approx(10 + 7.5 + 10) and row.cost_mid == pytest.approx(27.5 * 2000 / 30)
    assert {(r.day, r.survival) for r in rows("curve", "horizons") if r.edge == "mid"} == {(14, 0.75), (30, 0.5), (45, 0.0), (60, 0.0)}


def test_nearest_breaks_ties_by_order_and_ignores_outcomes(rows):
    mid = sorted((r.neighbor_rank, r.comp_key) for r in rows("ties", "edge_neighbors") if r.edge == "mid")
    assert [key for _, key in mid] == [f"k{n:02d}" for n in range(7)]


def test_results_do_not_depend_on_broadcasting(spark, inputs, derived):
    """Without any broadcast every join is shuffled or dealt out by salt."""

    def plain(tables):
        def cell(v):
            return round(v, 9) if isinstance(v, float) else str(v)

        return {n: sorted(tuple(map(cell, r)) for r in found) for n, found in tables.items() if n not in ("anchor",)}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = collected(inputs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, expected in plain(derived).items():
        assert sorted(map(repr, plain(again)[name])) == sorted(map(repr, expected)), name


def test_a_negative_weight_fails_loudly_or_is_kept_aside(spark):
    asked, comps, weights, overrides = frames(spark, [comp("a")], [request()], [("r", "a", -1.0)], [])
    with pytest.raises(RAISED, match="non-negative"):
        derive(asked, comps, weights, overrides, keep=lazy)["cohorts"].collect()
    good, rejected = curation.split_requests(asked, weights)
    assert good.count() == 0 and rejected.first().errors == ["weights must be non-negative"]


def test_including_by_hand_lifts_the_filter_and_the_zero_weight(spark, derived):
    kept = [(r.request_id, r.comp_key, r.state, r.weight) for r in derived["comps"] if r.request_id == "by_hand"]
    scored = spark.createDataFrame(kept, "request_id string, comp_key string, state string, weight double")
    w = spark.createDataFrame([], "request_id string, comp_key string, weight double")
    o = spark.createDataFrame([("by_hand", "a")], "request_id string, comp_key string")
    weights, overrides = views.include_comps(w, o, scored, scored.select("request_id", "comp_key"))
    assert [(r.comp_key, r.weight) for r in weights.collect()] == [("b", 1.0)]
    assert sorted(r.comp_key for r in overrides.collect()) == ["a", "b"]


def test_outcome_words(spark, rows):
    columns = "comp_key string, censored boolean, removal_class string, effective_dom int, days_since_removal int"
    names = [c.split()[0] for c in columns.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows("words", "comps")], columns)
    assert {r.comp_key: r.t for r in df.select("comp_key", views.outcome_text().alias("t")).collect()} == {
        "a": "active 9+ days", "b": "leased 9 days", "c": "leased 9 days · provisional", "d": "removed 2 days ago — classifying",
    }


def test_top_k_of_a_pool_that_fills_the_table(spark):
    pool = spark.range(5000).selectExpr(
        "'r' AS request_id", "concat('c', id) AS comp_key", "concat('c', id) AS group_key", "date'2026-01-01' AS first_listed",
        "id / 5000.0D AS premium", "1 AS effective_dom", "false AS censored", "'confirmed' AS removal_class", "1.0D AS weight",
        "2026 AS cohort_year", "0 AS cut_count",
    )
    candidates = spark.createDataFrame(
        [("r", e, 2000.0, c) for e, c in (("low", 0.2), ("mid", 0.5), ("high", 0.9))],
        "request_id string, edge string, candidate_rent double, candidate_premium double",
    )
    found = price_test.nearest(pool, candidates, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert {(r.edge, r.comp_key) for r in found.collect()} == {
        (e, f"c{n}") for e, m in (("low", 1000), ("mid", 2500), ("high", 4500)) for n in (m - 1, m, m + 1)
    }


def test_a_changed_column_changes_the_pull_digest(spark):
    def digest(**more):
        asked, comps, _, _ = frames(spark, [comp("a", **more), comp("b")], [request()], [("r", "a", 1.0)], [("r", "a")])
        return meta(asked, comps, Knobs()).first()

    base = digest()
    assert base.pull_digest == digest().pull_digest and json.loads(base.knobs) == json.loads(json.dumps(Knobs().to_mapping()))
    for change in ({"lat": 41.9}, {"beds": 9.0}, {"removal_class": "pending"}, {"sqft": None}):
        assert digest(**change).pull_digest != base.pull_digest, change


def test_a_request_without_a_place_is_kept_aside(spark):
    asked, _, weights, _ = frames(
        spark, [comp("a")], [request(), request(request_id="x", subject_lat=None, subject_lng=float("nan"))], [("r", "a", 1.0)], [("r", "a")]
    )
    good, rejected = curation.split_requests(asked, weights)
    assert [r.request_id for r in good.collect()] == ["r"]
    assert rejected.first().errors == ["subject latitude is required", "subject longitude is required"]
