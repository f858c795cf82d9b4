"""Drift from cohorts and the decision log on small hand-made tables."""

from datetime import date

import pytest

from leasegrain.config import Knobs
from leasegrain.operators import decisions, drift


def test_drift_falls_back_to_the_group_with_evidence(spark):
    rows = []
    for year, psf in ((2020, 1.0), (2022, 1.21)):
        rows += [("p", "1", 2.0, year, psf)] * 4
    rows += [("p", "2", 1.0, 2020, 2.0)] * 4 + [("p", "2", 1.0, 2021, 9.0)] * 3 + [("p", None, 1.0, 2021, 3.0)] * 4 + [("p", "1", 2.0, 2021, None)] * 9
    comps = spark.createDataFrame(rows, "pull_ref string, zip string, beds double, cohort_year int, psf double")
    ratios = drift.cohort_ratios(comps, Knobs())
    zip_1 = {r.cohort_year: (r.prior_year, r.growth) for r in ratios.where("zip = '1' and level = 0").collect()}
    assert zip_1[2020] == (None, None) and zip_1[2022] == (2020, pytest.approx(0.1))
    drifts = drift.group_drifts(ratios)
    found = {(r.level, r.zip, r.beds): (r.drift_pct, r.years, r.evidence) for r in drifts.collect()}
    assert found[(0, "1", "2.0")] == (pytest.approx(10.0), 2, 4)
    assert (0, "2", "1.0") not in found  # one year has three comps only
    assert found[(2, "*", "1.0")] == (pytest.approx(50.0), 1, 4)
    asked = [("a", "zip", "1", 2.0), ("b", "zip", "2", 1.0), ("c", "cohort", "1", 2.0), ("d", "manual", "1", 2.0), ("e", "zip", None, None)]
    requests = spark.createDataFrame([(r, "p", s, z, b, 7.0) for r, s, z, b in asked] + [("f", "q", "zip", "1", 2.0, 7.0)], "request_id string, pull_ref string, drift_source string, subject_zip string, subject_beds double, drift_pct double")
    used = {r.request_id: (r.drift_source, round(r.drift_pct, 6)) for r in drift.subject_drifts(requests, drifts).collect()}
    pull = round(found[(3, "*", "*")][0], 6)
    assert used == {"a": ("zip and beds", 10.0), "b": ("beds", 50.0), "c": ("pull", pull), "d": ("manual", 7.0), "e": ("pull", pull), "f": ("manual", 7.0)}


def test_every_decision_meets_its_vacancy(spark, tmp_path):
    cut = [(date(2024, 3, 1), 1000.0, 950.0)]
    vacancies = spark.createDataFrame(
        [
            ("p", "u", date(2024, 1, 1), date(2024, 2, 1), 900.0, []),
            ("p", "u", date(2024, 2, 20), date(2024, 3, 20), 1000.0, cut),
            ("p", "u", date(2025, 1, 1), None, 1100.0, None),
            ("q", "u", date(2023, 1, 1), None, 500.0, None),
            ("q", "u", date(2024, 1, 1), date(2024, 1, 9), 600.0, None),
        ],
        "pull_ref string, unit_key string, first_listed date, chain_end date, initial_ask double, cut_history array<struct<on: date, from_price: double, to_price: double>>",
    )
    made = [
        ("inside", "p", "u", date(2024, 1, 10), 900.0, 20.0), ("same day", "p", "u", date(2024, 2, 1), 900.0, None), ("before", "p", "u", date(2024, 2, 10), 1000.0, 30.0),
        ("after the cut", "p", "u", date(2024, 3, 5), 940.0, 10.0), ("twice", "p", "u", date(2024, 3, 5), 960.0, 10.0), ("late", "p", "u", date(2024, 4, 1), 900.0, 5.0),
        ("open", "p", "u", date(2025, 2, 1), 900.0, 5.0), ("stale", "q", "u", date(2023, 12, 1), 500.0, 5.0), ("missing", "q", "u", date(2024, 2, 1), 500.0, 5.0), ("nowhere", "r", "x", date(2024, 2, 1), 500.0, 5.0),
    ]
    path = str(tmp_path / "log")
    frame = spark.createDataFrame(made, "decision_id string, pull_ref string, unit_key string, decided_on date, candidate_rent double, predicted_days double")
    decisions.log_decisions(frame.limit(4), path)
    decisions.log_decisions(frame.subtract(frame.limit(4)), path)
    found = decisions.outcomes(spark.read.parquet(path), vacancies)
    got = {r.decision_id: (r.outcome, r.actual_days, r.ask_held, r.error_days) for r in found.collect()}
    assert got == {
        "inside": ("leased", 22, True, 2.0), "same day": ("leased", 0, True, None), "before": ("leased", 29, False, -1.0),
        "after the cut": ("leased", 15, True, 5.0), "twice": ("leased", 15, False, 5.0), "late": ("late", None, None, None),
        "open": ("open", None, None, None), "stale": ("open", None, None, None), "missing": ("missing", None, None, None), "nowhere": ("missing", None, None, None),
    }
    record = decisions.track_record(found, "pull_ref").where("pull_ref = 'p'").first()
    assert (record.decisions, record.leased, record.open, record.late, record.held, record.mean_abs_error_days) == (7, 5, 1, 1, 3, 3.25)
