"""Every result of a batch of requests, from comps."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.config import PIPELINE_VERSION, Knobs
from leasegrain.operators import buckets, cohorts, curation, evidence, price_test
from leasegrain.operators.coverage import hash_sums
from leasegrain.operators.curation import CURATED_COMP
from leasegrain.operators.shaping import with_row_dates
from leasegrain.session import discard, staged


Keep = Callable[[DataFrame, str], DataFrame]

#: What the cohort medians and totals read of a pair.
EVIDENCE_COLUMNS = ["request_id", "pull_ref", "cohort_year", "psf", "weight", "included"]
#: What the results read of a scored pair; the request's other columns join from ``requests`` where they are needed.
SCORED_COLUMNS = [
    *["request_id", "pull_ref", "as_of", *CURATED_COMP, "cut_count", "drift_pct", "distance_mi"],
    *["weight", "total_weight", "overridden", "state", "included"],
    *["premium", "premium_basis", "sqft_suspect", "bucket"],
]


def lazy(df: DataFrame, label: str) -> DataFrame:
    """A ``keep`` that writes nothing."""
    return df


def score(
    requests: DataFrame,
    comps: DataFrame,
    weights: DataFrame,
    overrides: DataFrame,
    knobs: Knobs = Knobs(),
    keep: Keep = staged,
) -> tuple[DataFrame, DataFrame]:
    """(scored pairs of request and comp, cohort medians).

    The pairs, by far the largest frame, are made from the comps and their marks where
    they are needed and never shuffled: once narrow, for medians and totals, and once
    whole, beside what their request brought of those.
    """
    marked = keep(curation.marked_comps(requests, comps, weights, overrides), "marked-comps")
    curated = keep(curation.curate(curation.pair(requests, marked)).select(*EVIDENCE_COLUMNS), "curated")
    medians = keep(cohorts.cohort_medians(curated, comps, knobs.min_cohort_size), "cohorts")
    asking = curation.in_blocks(requests).join(curation.total_weights(curated), "request_id", "left")
    asking = cohorts.beside_medians(asking, marked, medians)
    scored = cohorts.with_premiums(curation.curate(curation.pair(asking, marked)), medians, knobs.bucket_half_width_pct)
    kept = keep(scored.select(*SCORED_COLUMNS), "scored")
    for done in (marked, curated):
        discard(done)
    return kept, medians


def derive(
    requests: DataFrame,
    comps: DataFrame,
    weights: DataFrame,
    overrides: DataFrame,
    knobs: Knobs = Knobs(),
    summary: DataFrame | None = None,
    gaps: DataFrame | None = None,
    keep: Keep = staged,
) -> dict[str, DataFrame]:
    """All result tables, keyed by ``request_id``.

    ``keep`` is applied to the frames that several results read: curated and
    scored pairs, cohort medians, anchors and neighbours. It writes them to the
    shared folder; with ``lazy`` nothing runs until a result is used.
    ``summary`` is the shaping summary and ``gaps`` the pulls' missing windows.
    """
    scored, medians = score(requests, comps, weights, overrides, knobs, keep)
    return results(scored, medians, requests, comps, knobs, summary, gaps, keep)


def results(
    scored: DataFrame,
    medians: DataFrame,
    requests: DataFrame,
    comps: DataFrame,
    knobs: Knobs = Knobs(),
    summary: DataFrame | None = None,
    gaps: DataFrame | None = None,
    keep: Keep = staged,
) -> dict[str, DataFrame]:
    edges = keep(cohorts.anchors(scored, requests), "anchors")
    half = knobs.bucket_half_width_pct
    tests = price_test.price_tests(scored, requests, edges, knobs.knn_k, half, knobs.km_horizons_days, keep)
    return {
        "comps": derived_comps(scored, comps),
        "cohorts": medians,
        "anchor": cohorts.anchor_bands(edges),
        "anchor_edges": edges,
        "anchor_evidence": cohorts.anchor_evidence(scored),
        "buckets": buckets.bucket_stats(scored, requests, edges, half, knobs.min_cohort_size),
        "bucket_evidence": buckets.bucket_evidence(scored),
        "censored_floors": buckets.censored_floors(scored),
        "price_test": tests["result"],
        "neighbors": tests["neighbors"],
        "edge_neighbors": tests["edge_neighbors"],
        "edge_guards": tests["edge_guards"],
        "curve": tests["curve"],
        "horizons": tests["horizons"],
        "breakdown": evidence.breakdown(scored, requests, summary),
        "breakdown_evidence": evidence.breakdown_evidence(scored),
        "cohort_counts": evidence.cohort_counts(scored),
        "warnings": evidence.derive_warnings(scored, requests, edges),
        "meta": meta(requests, comps, knobs, gaps),
    }


def derived_comps(scored: DataFrame, comps: DataFrame) -> DataFrame:
    """Per request and comp: the comp's own facts and everything derived.

    The wide descriptive columns join only here, after all statistics.
    """
    facts = with_row_dates(comps).select(
        "pull_ref",
        "comp_key",
        "address",
        "unit",
        "beds",
        "baths",
        "sqft",
        "initial_ask",
        "relist_count",
        "gap_days",
        "days_since_removal",
        "cuts",
    )
    shared = curation.contribution_shares(scored).select(
        "request_id",
        "pull_ref",
        "comp_key",
        "group_key",
        "first_listed",
        "lat",
        "lng",
        "psf",
        "premium",
        "premium_basis",
        "cohort_year",
        "effective_dom",
        "censored",
        "removal_class",
        "withdrawal_suspect",
        "sqft_suspect",
        "distance_mi",
        "weight",
        "contribution_share",
        "state",
        "bucket",
    )
    return shared.join(facts, ["pull_ref", "comp_key"])


def meta(
    requests: DataFrame, comps: DataFrame, knobs: Knobs, gaps: DataFrame | None = None
) -> DataFrame:
    """Provenance of every request's numbers: digests of the comps and of the
    knobs, and the knobs themselves as JSON.

    ``gaps`` has ``pull_ref, missing, calls_to_complete``; a pull without a row
    there is whole.
    """
    digests = comps.groupBy("pull_ref").agg(
        F.max("as_of").alias("as_of"), F.count(F.lit(1)).alias("n_comps"), pull_digest(comps.columns).alias("pull_digest")
    )
    rows = (
        requests.select("request_id", "pull_ref")
        .join(digests, "pull_ref", "left")
        .withColumn("knobs", F.lit(json.dumps(knobs.to_mapping(), sort_keys=True)))
        .withColumn("config_digest", F.lit(knobs.digest()))
        .withColumn("pipeline_version", F.lit(PIPELINE_VERSION))
    )
    if gaps is not None:
        rows = rows.join(gaps.select("pull_ref", "missing", "calls_to_complete"), "pull_ref", "left")
    return rows


def pull_digest(columns: Sequence[str]) -> Column:
    """An order-free digest of a pull's comps over all their columns, by name."""
    return F.sha2(hash_sums(F.sha2(F.to_json(F.struct(*sorted(columns))), 256)), 256)
