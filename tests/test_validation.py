"""Request documents that break a rule each, and weights that name a comp twice."""

import json

import pytest

from leasegrain.operators import curation, validation

GOOD = {
    "pull_ref": "p", "subject": {"address": "1 Elm St", "lat": 41.8, "lng": -87.7, "sqft": 900, "beds": 0, "baths": 1.5},
    "weights": {"a|": 0, "b|": 2.5}, "include_overrides": [], "filters": {}, "drift_pct": -3, "candidate_rent": None,
}


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for name in path[:-1]:
        at = at[name]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


CASES = {
    "good": (json.dumps(GOOD), []),
    "least": (json.dumps({k: GOOD[k] for k in ("pull_ref", "subject")}), []),
    "text": ("{broken", [("$", "is not JSON")]),
    "list": ("[1]", [("$", "must be an object")]),
    "null": ("null", [("$", "must be an object")]),
    "no subject": (changed(["subject"], KeyError), [("subject", "is required")]),
    "null subject": (changed(["subject"], None), [("subject", "must be an object")]),
    "no pull": (changed(["pull_ref"], KeyError), [("pull_ref", "is required")]),
    **{f"no {c}": (changed(["subject", c], KeyError), [(f"subject.{c}", "is required")]) for c in GOOD["subject"]},
    **{f"{c} as flag": (changed(["subject", c], True), [(f"subject.{c}", "must be a text" if c == "address" else "must be a number")]) for c in GOOD["subject"]},
    "no area": (changed(["subject", "sqft"], 0), [("subject.sqft", "must be greater than 0")]),
    "negative beds": (changed(["subject", "beds"], -0.5), [("subject.beds", "must be at least 0")]),
    "negative baths": (changed(["subject", "baths"], -1), [("subject.baths", "must be at least 0")]),
    "negative weight": (changed(["weights", "b|"], -1e-9), [("weights.b|", "must be at least 0")]),
    "weights as list": (changed(["weights"], [1]), [("weights", "must be an object")]),
    "override": (changed(["include_overrides"], ["a", 1]), [("include_overrides[1]", "must be a text")]),
    "distance": (changed(["filters", "max_distance_mi"], -1), [("filters.max_distance_mi", "must be at least 0")]),
    "no distance": (changed(["filters", "max_distance_mi"], None), []),
    "flag": (changed(["filters", "hide_censored"], 1), [("filters.hide_censored", "must be true or false")]),
    "leased": (changed(["filters", "leased_only"], None), [("filters.leased_only", "must be true or false")]),
    "unknown filter": (changed(["filters", "max_distance"], 1), [("filters.max_distance", "unknown field")]),
    "drift": (changed(["drift_pct"], "7"), [("drift_pct", "must be a number")]),
    "rent": (changed(["candidate_rent"], 0), [("candidate_rent", "must be greater than 0")]),
    "unknown": (changed(["subjects"], {}), [("subjects", "unknown field")]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(name, body) for name, (body, _) in CASES.items()], "request_id string, body string")
    judged = validation.judged_documents(rows)
    return {r.request_id: [tuple(p) for p in r.problems] for r in judged.collect()}


@pytest.mark.parametrize("name", CASES)
def test_every_rule_names_the_path(found, name):
    assert found[name] == CASES[name][1]


def test_a_comp_has_one_weight(spark):
    requests = spark.createDataFrame([(r, "p", 1.0, 1.0, 900.0, None, None) for r in "abc"], "request_id string, pull_ref string, subject_lat double, subject_lng double, subject_sqft double, candidate_rent double, max_distance_mi double")
    weights = spark.createDataFrame([("a", "x|", 1.0), ("a", "x|", 1.0), ("b", "x|", -1.0), ("c", "x|", 1.0), ("c", "y|", 1.0)], "request_id string, comp_key string, weight double")
    good, bad = curation.split_requests(requests, weights)
    assert [r.request_id for r in good.collect()] == ["c"]
    assert {r.request_id: r.errors for r in bad.collect()} == {"a": ["weights must name a comp once"], "b": ["weights must be non-negative"]}
