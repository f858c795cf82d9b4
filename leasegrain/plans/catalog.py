"""Every operator as a query over the benchmark tables.

Each function takes a session and a folder of tables and returns a DataFrame.
Doubles are rounded to six places, so that engines can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrain.config import GO_THRESHOLD, Knobs
from leasegrain.functions.dates import calendar_date
from leasegrain.operators import cohorts, coverage, curation, decisions, drift, planning, profile, refresh, shaping, statistics, validation, views
from leasegrain.operators.cohorts import EDGES
from leasegrain.session import discard, shared_folder, staged
from leasegrain.sources import bookkeeping, event_responses, order_listings, responses
from leasegrain.sources.order_listings import Workbench, table
from leasegrain.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- shaping


@query
def listing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and Inactive records united, and their copies per listing id."""
    records = Workbench(spark, sf_dir).records().where(F.col("id").isNotNull())
    return records.groupBy("pull_ref", "id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(F.col("status") == "Active").alias("active_copies")
    )


@query
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = shaping.with_identity(Workbench(spark, sf_dir).records())
    return named.groupBy("pull_ref", "own_key").agg(F.count(F.lit(1)).alias("records"))


@query
def listing_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one unit key that all copies of a listing id share."""
    named = shaping.with_identity(Workbench(spark, sf_dir).records())
    return (
        named.where((F.col("own_key") != "|") & F.col("id").isNotNull())
        .groupBy("pull_ref", "id")
        .agg(F.min("own_key").alias("group_key"))
    )


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = shaping.with_identity(Workbench(spark, sf_dir).records())
    return shaping.observations(named.where(F.col("own_key") != "|"))


@query
def spell_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reported listing start: top-level dates and history entries."""
    return (
        _observed(spark, sf_dir)
        .where(F.col("listed").isNotNull())
        .select("pull_ref", "id", "own_key", "listed", "removed", "price", "sqft")
    )


@query
def collapsed_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    spells = shaping.collapse(_observed(spark, sf_dir))
    return rounded(
        spells.select("pull_ref", "group_key", "listed", "removed", "price", "lat", "lng", "beds", "baths", "sqft"),
        "lat",
        "lng",
    )


@query
def stitched_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    spells = shaping.stitch(shaping.collapse(_observed(spark, sf_dir)), Knobs().stitch_gap_days)
    return spells.select("pull_ref", "group_key", "listed", "removed", "chain", "off_market", "starts_chain")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    spells = shaping.collapse(_observed(spark, sf_dir))
    return shaping.fold_chains(shaping.stitch(spells, Knobs().stitch_gap_days))


@query
def chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("pull_ref", "group_key", "chain", "first_listed", "chain_end")


@query
def folded_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select(
        "pull_ref", "group_key", "chain", "initial_ask", "relist_count", "gap_days"
    )


@query
def price_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("pull_ref", "group_key", "chain", F.inline("cut_history")).withColumnRenamed(
        "on", "cut_on"
    )


@query
def chain_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = shaping.with_comp_key(_folded(spark, sf_dir), "address", "unit", "base_key")
    return described.select("pull_ref", "group_key", "chain", "base_key", "beds", "baths", "sqft")


@query
def chain_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_folded(spark, sf_dir).select("pull_ref", "group_key", "chain", "lat", "lng"), "lat", "lng")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbench(spark, sf_dir).shaped().chains


@query
def vacancy_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("pull_ref", "group_key", "chain", "effective_dom", "censored")


@query
def removal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("pull_ref", "group_key", "chain", "removal_class")


@query
def withdrawal_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("pull_ref", "group_key", "chain", "withdrawal_suspect")


@query
def season_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("pull_ref", "group_key", "chain", "first_listed", "in_window")


@query
def chain_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).groupBy("pull_ref", "cohort_year").agg(F.count(F.lit(1)).alias("chains"))


@query
def shaping_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbench(spark, sf_dir).shaped().summary


@query
def shaping_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbench(spark, sf_dir).shaped().quarantine


@query
def shaping_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, report and chain that shaping leaves out, with its reason."""
    return Workbench(spark, sf_dir).shaped().rejected


@query
def price_per_sqft(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = Workbench(spark, sf_dir).comps()
    return rounded(comps.select("pull_ref", "comp_key", "initial_ask", "sqft", "psf"), "psf")


@query
def row_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal date, days since, and each price cut's day within the vacancy."""
    dated = shaping.with_row_dates(Workbench(spark, sf_dir).comps())
    offsets = F.array_join(F.transform("cuts", lambda c: c["day_offset"].cast("string")), ",")
    return dated.select("pull_ref", "comp_key", "removed_on", "days_since_removal", offsets.alias("cut_days"))


@query
def comp_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbench(spark, sf_dir).comps().select("pull_ref", "group_key", "first_listed", "comp_key")


@query
def comp_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = shaping.with_sequence(Workbench(spark, sf_dir).comps())
    return ordered.select("pull_ref", "comp_key", "comp_seq")


@query
def shaped_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole shaping job, from raw records to comps."""
    return Workbench(spark, sf_dir).shaped().comps.select(
        "pull_ref",
        "comp_key",
        "initial_ask",
        "effective_dom",
        "censored",
        "removal_class",
        "cohort_year",
        "first_listed",
        "withdrawal_suspect",
        F.size("cut_history").alias("cut_count"),
        "relist_count",
        "gap_days",
    )


# ---- statistics on tables with few, very large groups


@query
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lower weighted quantiles per return flag: a third of the rows each."""
    lines = table(spark, sf_dir, "lineitem")
    asked = {"q25": 0.25, "q50": 0.5, "q90": 0.9}
    return statistics.weighted_quantiles(lines, ["l_returnflag"], "l_extendedprice", "l_quantity", asked)


@query
def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small groups: the quantity-weighted median price of every part."""
    lines = table(spark, sf_dir, "lineitem")
    return statistics.weighted_median(lines, ["l_partkey"], "l_extendedprice", "l_quantity", "median_price")


@query
def survival_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-limit curves of all vacancies per bedroom count."""
    comps = Workbench(spark, sf_dir).comps().withColumn("weight", F.col("beds") + 1.0)
    steps = statistics.km_steps(comps, ["beds"])
    return rounded(steps, "survival", "at_risk", "events")


@query
def survival_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = Workbench(spark, sf_dir).comps().withColumn("weight", F.lit(1.0))
    keys = ["pull_ref"]
    steps = statistics.km_steps(comps, keys)
    curves = comps.select(*keys).distinct()
    return rounded(statistics.survival_at(curves, steps, keys, Knobs().km_horizons_days), "survival")


@query
def restricted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected vacancy days per pull within its observation window."""
    comps = Workbench(spark, sf_dir).comps().withColumn("weight", F.lit(1.0))
    keys = ["pull_ref"]
    steps = statistics.km_steps(comps, keys)
    limits = steps.groupBy(*keys).agg(F.max("truncated_at").alias("limit_day"))
    return rounded(statistics.expected_days(limits, steps, keys, "limit_day"), "days")


# ---- requests


@query
def effective_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbench(spark, sf_dir).curated().select("request_id", "comp_key", "weight")


@query
def subject_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    pairs = curation.pair(bench.requests(), bench.comps())
    return rounded(pairs.select("request_id", "comp_key", "distance_mi"), "distance_mi")


@query
def membership_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbench(spark, sf_dir).curated().select("request_id", "comp_key", "overridden", "state")


@query
def cohort_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    return rounded(cohorts.cohort_medians(bench.curated(), bench.comps(), Knobs().min_cohort_size), "median_psf")


def _scored(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    scored, _ = Workbench(spark, sf_dir).scored()
    return scored.select("request_id", "comp_key", *columns)


@query
def cohort_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, medians = Workbench(spark, sf_dir).scored()
    found = scored.select("request_id", "cohort_year", "comp_key").join(
        medians.select("request_id", "cohort_year", "median_psf", "basis"), ["request_id", "cohort_year"]
    )
    return rounded(found.where(F.col("median_psf").isNotNull()), "median_psf")


@query
def premiums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir, "premium"), "premium")


@query
def sqft_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "sqft_suspect")


@query
def premium_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "premium_basis")


@query
def premium_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "bucket")


@query
def drift_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = Workbench(spark, sf_dir).requests()
    return requests.select("request_id", F.inline(cohorts.drift_edges(F.col("drift_pct"))))


@query
def anchor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift-adjusted market price of every subject at the three drift edges."""
    bench = Workbench(spark, sf_dir)
    scored, _ = bench.scored()
    edges = cohorts.anchors(scored, bench.requests())
    return rounded(
        edges.select("request_id", "edge", "edge_drift", "anchor_psf", "anchor_rent", "n_comps"),
        "anchor_psf",
        "anchor_rent",
    )


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Workbench(spark, sf_dir).derived()[name]


@query
def anchor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _derived(spark, sf_dir, "anchor")
    flat = bands.select(
        "request_id",
        *[F.col(f"rent.{e}").alias(f"rent_{e}") for e in EDGES],
        "drift_pct",
        "drift_sensitivity_pts",
        "subject_sqft",
        "n_comps",
    )
    return rounded(flat, *[f"rent_{e}" for e in EDGES])


@query
def anchor_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "anchor_evidence")


@query
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _derived(spark, sf_dir, "buckets").drop("dollar_min", "dollar_max")
    return rounded(stats, "cut_before_lease_rate")


@query
def bucket_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _derived(spark, sf_dir, "buckets")
    flat = stats.select(
        "request_id",
        "bucket",
        *[F.col(f"dollar_min.{e}").alias(f"min_{e}") for e in EDGES],
        *[F.col(f"dollar_max.{e}").alias(f"max_{e}") for e in EDGES],
    )
    return rounded(flat, *[f"{side}_{e}" for side in ("min", "max") for e in EDGES])


@query
def bucket_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "bucket_evidence")


@query
def censored_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "censored_floors")


@query
def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _derived(spark, sf_dir, "edge_neighbors")
    return found.select("request_id", "edge", "comp_key", "neighbor_rank")


@query
def candidate_premiums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _derived(spark, sf_dir, "edge_guards")
    return rounded(found.select("request_id", "edge", "candidate_premium"), "candidate_premium")


@query
def neighbor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _derived(spark, sf_dir, "neighbors")
    return rounded(found.drop("group_key", "first_listed"), "premium", "distance")


@query
def evidence_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "edge_guards").select(
        "request_id", "edge", "n_neighbors", "n_in_range", "reason"
    )


@query
def price_test_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_derived(spark, sf_dir, "curve"), "survival", "at_risk", "events")


@query
def price_test_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_derived(spark, sf_dir, "horizons"), "survival")


@query
def expected_vacancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _derived(spark, sf_dir, "price_test").where(F.col("state") == "curve")
    bands = [f"{kind}_{e}" for kind in ("days", "cost") for e in EDGES]
    return rounded(found.select("request_id", "truncated_at", *bands), *bands, places=4)


@query
def price_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _derived(spark, sf_dir, "price_test")
    bands = [f"candidate_premium_{e}" for e in EDGES]
    return rounded(
        found.select("request_id", "candidate_rent", "state", "reason", "bucket", "truncated_at", *bands), *bands
    )


@query
def contribution_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = Workbench(spark, sf_dir).scored()
    shared = curation.contribution_shares(scored)
    return rounded(shared.select("request_id", "comp_key", "contribution_share"), "contribution_share")


@query
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "breakdown")


@query
def breakdown_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "breakdown_evidence")


@query
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "cohort_counts")


@query
def derive_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "warnings")


@query
def derived_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _derived(spark, sf_dir, "comps").select(
        "request_id",
        "comp_key",
        "beds",
        "baths",
        "sqft",
        "initial_ask",
        "psf",
        "premium",
        "premium_basis",
        "effective_dom",
        "days_since_removal",
        "relist_count",
        "gap_days",
        F.size("cuts").alias("cut_count"),
        "distance_mi",
        "weight",
        "contribution_share",
        "state",
        "bucket",
    )
    return rounded(rows, "psf", "premium", "distance_mi", "contribution_share")


@query
def derive_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "meta").select("request_id", "pull_ref", "as_of", "n_comps", "pipeline_version")


@query
def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and weights that break their rules, kept aside with reasons."""
    bench = Workbench(spark, sf_dir)
    s = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("bigint")
    broken = (
        bench.requests()
        .withColumn("subject_sqft", F.when(s % 6 == 0, -F.col("subject_sqft")).otherwise(F.col("subject_sqft")))
        .withColumn("candidate_rent", F.when(s % 10 == 1, 0.0).otherwise(F.col("candidate_rent")))
        .withColumn("max_distance_mi", F.when(s % 9 == 0, -1.0).otherwise(F.col("max_distance_mi")))
    )
    weights = broken.where(s % 8 == 0).select(
        "request_id", F.lit("x|").alias("comp_key"), F.lit(-1.0).alias("weight")
    )
    _, rejected = curation.split_requests(broken, weights)
    return rejected.select("request_id", F.array_join("errors", "; ").alias("errors"))


# ---- raw responses and pull bookkeeping


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.parse_responses(event_responses.responses(spark, sf_dir))


@query
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of usable bodies: bare arrays and envelopes, objects only."""
    return responses.listing_records(_parsed(spark, sf_dir)).select("pull_ref", "response_status", "id")


@query
def unusable_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.unusable_responses(_parsed(spark, sf_dir)).select("pull_ref", "event_id", "body")


@query
def response_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = event_responses.responses(spark, sf_dir)
    return named.select("event_id", "sig", "status", "year", "page_offset")


@query
def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.stored_index(_parsed(spark, sf_dir))


@query
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing records through JSON bodies and back: nothing is lost."""
    records = Workbench(spark, sf_dir).records()
    fields = [c for c in records.columns if c != "pull_ref"]
    bodies = records.select(
        "pull_ref", F.concat(F.lit("["), F.to_json(F.struct(*fields)), F.lit("]")).alias("body"), F.lit("Active").alias("status")
    )
    back = responses.listing_records(responses.parse_responses(bodies))
    return back.groupBy("pull_ref", "propertyType").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.sum("price"), 2).alias("price_sum"),
        F.count_if(F.col("history").isNotNull()).alias("with_history"),
        F.count("squareFootage").alias("with_sqft"),
    )


@query
def window_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.reconcile(
        event_responses.planned(spark, sf_dir),
        event_responses.recorded(spark, sf_dir),
        coverage.stored_index(_parsed(spark, sf_dir)),
    )


@query
def window_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = coverage.stored_index(_parsed(spark, sf_dir))
    return coverage.corroborate(event_responses.recorded(spark, sf_dir), stored)


@query
def pull_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = coverage.pull_gaps(_reconciled(spark, sf_dir))
    return gaps.withColumn("missing", F.array_join("missing", ","))


@query
def observation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.observation_dates(
        event_responses.pulls(spark, sf_dir),
        event_responses.manifests(spark, sf_dir),
        event_responses.responses(spark, sf_dir),
    )


@query
def truncated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.truncation(_parsed(spark, sf_dir))


@query
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = event_responses.manifests(spark, sf_dir).select("pull_ref")
    gaps = coverage.pull_gaps(_reconciled(spark, sf_dir)).join(known, "pull_ref", "left_semi")
    return coverage.cache_status(event_responses.pulls(spark, sf_dir).select("pull_ref"), gaps)


@query
def monthly_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.monthly_calls(event_responses.calls(spark, sf_dir))


@query
def affordable_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    owed = coverage.pull_gaps(_reconciled(spark, sf_dir)).join(
        event_responses.pulls(spark, sf_dir).select(
            "pull_ref", F.col("user_id").alias("account"), F.date_format("today", "yyyy-MM").alias("month")
        ),
        "pull_ref",
    )
    budgets = coverage.monthly_calls(event_responses.calls(spark, sf_dir))
    judged = coverage.affordable(owed, budgets)
    return judged.select("pull_ref", "account", "calls_to_complete", "remaining", "refused")


@query
def evidence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.evidence_digests(
        event_responses.responses(spark, sf_dir), event_responses.manifests(spark, sf_dir)
    )


@query
def changed_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulls that a later batch of responses changes."""
    stored = event_responses.responses(spark, sf_dir)
    noted = event_responses.manifests(spark, sf_dir)
    before = coverage.evidence_digests(stored.where(F.col("total_count").isNotNull()), noted)
    return coverage.changed_pulls(coverage.evidence_digests(stored, noted), before).select("pull_ref")


@query
def latest_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookkeeping.latest_workspaces(event_responses.workspace_versions(spark, sf_dir))


@query
def workspace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = bookkeeping.latest_workspaces(event_responses.workspace_versions(spark, sf_dir))
    listed = bookkeeping.list_workspaces(bookkeeping.parse_workspaces(latest))
    return listed.select("key", "saved_at", F.col("state.pull_ref").alias("pull_ref"), "error")


@query
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = bookkeeping.latest_workspaces(event_responses.workspace_versions(spark, sf_dir))
    rows = bookkeeping.parse_workspaces(latest).select("key", F.col("state.pull_ref").alias("pull_ref"), "error")
    return coverage.recents(
        rows, event_responses.manifests(spark, sf_dir), event_responses.responses(spark, sf_dir)
    )


# ---- searches


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.normalize_searches(event_responses.searches(spark, sf_dir))


@query
def search_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select(
        "search_id",
        "address",
        F.round("radius", 6).alias("radius"),
        "years_back",
        "window_start",
        "window_end",
        F.array_join("property_types", "|").alias("property_types"),
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query
def bed_bath_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select(
        "search_id",
        F.col("bed.lo").alias("bed_lo"),
        F.col("bed.hi").alias("bed_hi"),
        F.col("bed.error").alias("bed_error"),
        F.col("bath.lo").alias("bath_lo"),
        F.col("bath.hi").alias("bath_hi"),
        F.col("bath.error").alias("bath_error"),
    )


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid searches, written once: planning and selection both read them."""
    valid = planning.valid_searches(_normalized(spark, sf_dir))
    return Workbench(spark, sf_dir).once("searches", lambda: staged(valid, "searches"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_windows(_valid(spark, sf_dir))


@query
def season_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select(
        "search_id", "year", "status", "opens", "closes", "days_old_min", "days_old_max", "fetchable"
    )


@query
def fetchable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.fetchable_windows(_windows(spark, sf_dir)).select("search_id", "sig", "label")


@query
def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = planning.plan_costs(_windows(spark, sf_dir))
    return costs.withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("cohorts", "fetchable_cohorts")}
    )


@query
def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select("search_id", planning.search_key().alias("pull_ref"))


@query
def selected_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings within radius, size, type, status and age of each search."""
    valid = _valid(spark, sf_dir)
    listings = Workbench(spark, sf_dir).records().select(
        F.col("id").alias("listing_id"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.col("bedrooms").alias("beds"),
        F.col("bathrooms").alias("baths"),
        F.col("propertyType").alias("property_type"),
        "status",
        calendar_date(F.col("listedDate")).alias("listed"),
    )
    found = planning.select_listings(valid, planning.plan_windows(valid), listings)
    return rounded(found.select("search_id", "year", "status", "listing_id", "distance_mi"), "distance_mi")


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    plans = bench.pulls().select(
        F.col("pull_ref").alias("search_id"),
        F.col("as_of").alias("today"),
        "window_start",
        "window_end",
        F.lit(3).alias("years_back"),
    )
    windows = planning.plan_windows(plans).where(F.col("status") == "Active")
    return planning.padded_matches(bench.records(), windows.withColumnRenamed("search_id", "pull_ref"))


@query
def padded_window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.window_checks(_padded(spark, sf_dir))


@query
def window_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.window_yields(_padded(spark, sf_dir))


@query
def coverage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.coverage_verdicts(_padded(spark, sf_dir), GO_THRESHOLD)


@query
def empty_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a one-day season leaves a pull without comps."""
    bench = Workbench(spark, sf_dir)
    number = F.split_part("pull_ref", F.lit("-"), F.lit(2)).cast("int")
    day = F.when(number % 2 == 0, "02-29").otherwise("06-15")
    narrow = bench.pulls().withColumns({"window_start": day, "window_end": day})
    summary = shaping.shape(bench.records(), narrow).summary
    gaps = narrow.select("pull_ref", (number % 3 != 0).alias("complete"))
    asked = narrow.select(
        "pull_ref", (number % 7 * 12.5).alias("radius"), (number % 5 + 1).cast("int").alias("years_back")
    )
    return coverage.empty_results(summary, gaps, asked)


@query
def pull_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.profile(Workbench(spark, sf_dir).records()), "value")


# ---- view rules


@query
def visible_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.visible(_scored(spark, sf_dir, "state"))


@query
def filtered_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filtered_out(_scored(spark, sf_dir, "state"))


@query
def weights_after_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = Workbench(spark, sf_dir).scored()
    return views.select_all(Workbench(spark, sf_dir).weights(), scored)


@query
def weights_after_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = Workbench(spark, sf_dir).scored()
    return views.select_none(Workbench(spark, sf_dir).weights(), scored)


@query
def included_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and overrides after every filtered comp is included by hand."""
    bench = Workbench(spark, sf_dir)
    scored, _ = bench.scored()
    weights, overrides = views.include_comps(
        bench.weights(), bench.overrides(), scored, views.filtered_out(scored)
    )
    return overrides.withColumn("override", F.lit(True)).join(weights, ["request_id", "comp_key"], "full")


@query
def outcome_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = shaping.with_row_dates(Workbench(spark, sf_dir).comps())
    return dated.select("pull_ref", "comp_key", views.outcome_text().alias("outcome"))


@query
def dominant_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = Workbench(spark, sf_dir).scored()
    shared = curation.contribution_shares(scored)
    return shared.select("request_id", "comp_key", views.dominates(F.col("contribution_share")).alias("dominant"))


@query
def map_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    scored, _ = bench.scored()
    return rounded(views.map_frames(scored, bench.requests()), "south", "north", "west", "east")


@query
def comp_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = Workbench(spark, sf_dir).comps()
    return comps.select(
        "pull_ref",
        "comp_key",
        views.listing_link(F.concat(F.col("address"), F.lit(" & Söhne"))).alias("listing_link"),
        views.street_link(F.col("lat"), F.col("lng")).alias("street_link"),
    )


# ---- refreshed pulls


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    return bench.once("changes", lambda: staged(refresh.comp_changes(bench.version("before"), bench.version("after")), "changes"))


def _asked_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights on comps of the earlier version, and some on keys that no comp has."""
    bench = Workbench(spark, sf_dir)
    weights = order_listings.request_weights(bench.requests(), bench.version("before"))
    later = order_listings.request_weights(bench.requests(), bench.version("after")).withColumn("weight", F.col("weight") + 5)
    lost = bench.requests().select("request_id", F.lit("no such street|").alias("comp_key"), F.lit(2.0).alias("weight"))
    known = weights.select("request_id", "comp_key")
    return staged(weights.unionByName(later.join(known, ["request_id", "comp_key"], "left_anti")).unionByName(lost), "asked-weights")


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    return bench.once(
        "carried",
        lambda: staged(refresh.carry_weights(bench.requests(), _asked_weights(spark, sf_dir), _changes(spark, sf_dir)), "carried"),
    )


@query
def refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh made of every comp of the earlier and the later observation."""
    return _changes(spark, sf_dir)


@query
def refresh_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of all requests after the refresh."""
    return _carried(spark, sf_dir)


@query
def refresh_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = Workbench(spark, sf_dir).requests()
    return refresh.refresh_summary(requests, _changes(spark, sf_dir), _carried(spark, sf_dir))


# ---- the incremental store

BATCHES = 3


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing records as response bodies of about ten records, dealt into batches."""
    records = Workbench(spark, sf_dir).records()
    fields = [c for c in records.columns if c != "pull_ref"]
    page = F.concat(F.lit("y2000-"), F.lower("status"), F.lit("-off"), F.pmod(F.crc32(F.coalesce("listedDate", F.lit("")).cast("binary")), F.lit(97)))
    # the active and the inactive copy of a listing come in different batches
    return (
        records.groupBy("pull_ref", F.concat(page, F.lit(".json")).alias("file_name"))
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*fields))), ","), F.lit("]")).alias("body"))
        .withColumns({"as_of": F.lit(None).cast("string"), "fetched_at": F.lit(None).cast("string"), "total_count": F.lit(None).cast("int")})
        .withColumn("_batch", F.pmod(F.crc32(F.col("file_name").cast("binary")), F.lit(BATCHES)).cast("int"))
    )


def _store(spark: SparkSession, sf_dir: str) -> str:
    """A store that took in all bodies in batches, first cut short and then again in full; compacted once."""
    bench = Workbench(spark, sf_dir)

    def fill() -> str:
        root = f"{shared_folder(spark)}/leasegrain-tables/store-{uuid.uuid4().hex}"
        bodies = staged(_bodies(spark, sf_dir), "bodies")
        incremental.put_manifests(spark, root, bench.pulls(), 0)
        first = bodies.where("_batch = 0").withColumn("body", F.when(F.col("file_name").contains("1."), "[]").otherwise(F.col("body")))
        incremental.ingest(spark, root, first.drop("_batch"), 0)
        incremental.ingest(spark, root, bodies.where("_batch = 1").drop("_batch"), 1)
        incremental.compact(spark, root)
        incremental.ingest(spark, root, bodies.where("_batch <> 1").drop("_batch"), 2)
        discard(bodies)
        return root

    return bench.once("store", fill)


@query
def incremental_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comps of a store filled in batches: the same as of all records at once."""
    return incremental.current_comps(spark, _store(spark, sf_dir)).select(
        "pull_ref", "comp_key", "initial_ask", "effective_dom", "censored", "removal_class", "first_listed", "withdrawal_suspect", "relist_count", "gap_days"
    )


@query
def stored_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw sink read back: records of the last version of every file, per pull and status."""
    stored = responses.listing_records(responses.parse_responses(incremental.stored_responses(spark, _store(spark, sf_dir))))
    return stored.groupBy("pull_ref", "response_status").agg(
        F.count(F.lit(1)).alias("records"), F.count("id").alias("with_id"), F.round(F.sum("price"), 2).alias("price_sum")
    )


@query
def stored_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest sink read back."""
    return incremental.stored_manifests(spark, _store(spark, sf_dir)).select("pull_ref", "as_of", "window_start", "window_end")


# ---- drift from the comps themselves


def _zip(number: Column) -> Column:
    """The zip of a house number; a tenth have none."""
    return F.when(number % 10 != 9, F.concat(F.lit("6061"), (number % 10).cast("string")))


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = Workbench(spark, sf_dir)
    house = F.split_part("comp_key", F.lit(" "), F.lit(1)).cast("bigint")
    return bench.once("ratios", lambda: staged(drift.cohort_ratios(bench.comps().withColumn("zip", _zip(house))), "ratios"))


@query
def cohort_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort medians and their yearly growth per zip and bedrooms, zip, bedrooms, pull."""
    return rounded(_ratios(spark, sf_dir), "median_psf", "growth")


@query
def group_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.group_drifts(_ratios(spark, sf_dir)), "drift_pct")


@query
def subject_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift of every request from its source, or its own where there is no evidence."""
    s = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("bigint")
    asked = Workbench(spark, sf_dir).requests().select(
        "request_id",
        "pull_ref",
        "drift_pct",
        F.element_at(F.array(F.lit("zip"), F.lit("cohort"), F.lit("zip"), F.lit("manual")), (s % 4 + 1).cast("int")).alias("drift_source"),
        F.concat(_zip(s % 12), F.when(s % 12 > 9, "0").otherwise("")).alias("subject_zip"),
        (s % 6).cast("double").alias("subject_beds"),
    )
    found = drift.subject_drifts(asked, drift.group_drifts(_ratios(spark, sf_dir)))
    return rounded(found, "drift_pct", "cohort_drift_pct")


# ---- decisions and what came of them


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision of every request about one unit of its pull, read back from the log, with what followed."""
    bench = Workbench(spark, sf_dir)
    s = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("bigint")
    unit = F.floor(s * 3 / 20) * 100 + s * 7 % 130
    number = F.when(unit % 5 != 0, (unit % 5).cast("string")).otherwise("")
    tests = bench.derived()["price_test"].select("request_id", F.col("days_mid").alias("predicted_days"))
    made = (
        bench.requests()
        .join(tests, "request_id", "left")
        .select(
            F.col("request_id").alias("decision_id"),
            "pull_ref",
            F.concat(unit.cast("string"), F.lit(" w oak st|"), number).alias("unit_key"),
            F.date_add(F.lit("1996-01-01").cast("date"), (s * 37 % 2100).cast("int")).alias("decided_on"),
            F.col("candidate_rent").alias("candidate_rent"),
            "predicted_days",
        )
    )
    path = f"{shared_folder(spark)}/leasegrain-tables/decisions-{uuid.uuid4().hex}"
    decisions.log_decisions(made, path)
    logged = spark.read.parquet(path)
    vacancies = shaping.with_comp_key(bench.shaped_once().chains, "address", "unit", "unit_key")
    return decisions.outcomes(logged, vacancies.select("pull_ref", "unit_key", "first_listed", "chain_end", "initial_ask", "cut_history"))


@query
def decision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _outcomes(spark, sf_dir).drop("unit_key")
    return rounded(found, "predicted_days", "error_days", places=4)


@query
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions.track_record(_outcomes(spark, sf_dir), "pull_ref"), "mean_error_days", "mean_abs_error_days", places=3)


# ---- requests as documents

#: What is wrong with a document by the supplier's number: (text of the good one, what stands there instead).
FAULTS = (
    ("", ""),
    ('"pull_ref":"p1",', ""),
    ('"pull_ref":"p1"', '"pull_ref":7'),
    ('"sqft":900', '"sqft":0'),
    ('"beds":2', '"beds":-1'),
    ('"baths":1.5,', ""),
    ('"lat":41.8', '"lat":"41.8"'),
    ('"lng":-87.7', '"lng":-87.7,"zip":"60614"'),
    ('"weights":{"a|":1}', '"weights":{"a|":-2,"b|":"x","c|":0}'),
    ('["a|"]', '["a|",3,null]'),
    ('"max_distance_mi":1.5', '"max_distance_mi":-1'),
    ('"max_distance_mi":1.5', '"max_distance_mi":null'),
    ('"leased_only":false', '"leased_only":"no"'),
    ('"candidate_rent":1500', '"candidate_rent":0'),
    ('"candidate_rent":1500', '"candidate_rent":null'),
    ('"drift_pct":7', '"drift_pct":null'),
    ('"drift_pct":7', '"drift":7,"Drift_pct":7'),
    ('"subject":{', '"subject":[{'),
    ("}", "]"),
)
DOCUMENT = (
    '{"pull_ref":"p1","subject":{"address":"1 Elm St","lat":41.8,"lng":-87.7,"sqft":900,"beds":2,"baths":1.5},'
    '"weights":{"a|":1},"include_overrides":["a|"],"filters":{"max_distance_mi":1.5,"hide_censored":true,"leased_only":false},'
    '"drift_pct":7,"candidate_rent":1500}'
)


def _document(fault: tuple[str, str]) -> str:
    old, new = fault
    if old == '"baths":1.5,':
        return DOCUMENT.replace(',"baths":1.5', "")
    if old == '"subject":{':
        return DOCUMENT.replace(old, new).replace('"baths":1.5}', '"baths":1.5}]')
    return DOCUMENT.replace(old, new) if old else DOCUMENT


@query
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every problem of a request document of each supplier, by path."""
    bodies = F.array(*[F.lit(_document(f)) for f in FAULTS])
    s = F.col("s_suppkey")
    documents = table(spark, sf_dir, "supplier").select(
        s.alias("request_id"), F.element_at(bodies, (s % len(FAULTS) + 1).cast("int")).alias("body")
    )
    return validation.problems_of(validation.judged_documents(documents))


# ---- provenance


@query
def derive_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, knobs and gaps of every request; the digest follows the comps, not their order."""
    from leasegrain.plans.derive import meta

    bench = Workbench(spark, sf_dir)
    number = F.split_part("pull_ref", F.lit("-"), F.lit(2)).cast("int")
    gaps = bench.pulls().where(number % 3 == 1).select("pull_ref", F.array(F.lit("2001 Active")).alias("missing"), F.lit(2).alias("calls_to_complete"))
    comps, requests = bench.comps(), bench.requests()
    dearer = comps.withColumn("initial_ask", F.when(number % 2 == 0, F.col("initial_ask") + 1).otherwise(F.col("initial_ask")))
    now = meta(requests, comps, Knobs(), gaps)
    dealt = meta(requests, comps.repartition(7, "first_listed"), Knobs()).select("request_id", F.col("pull_digest").alias("_dealt"))
    other = meta(requests, dearer, Knobs()).select("request_id", F.col("pull_digest").alias("_other"))
    return now.join(dealt, "request_id").join(other, "request_id").select(
        "request_id",
        "pull_ref",
        "as_of",
        "n_comps",
        F.length("pull_digest").alias("digest_length"),
        (F.col("pull_digest") == F.col("_dealt")).alias("same_when_dealt_anew"),
        (F.col("pull_digest") != F.col("_other")).alias("other_when_changed"),
        "config_digest",
        "knobs",
        "pipeline_version",
        F.array_join("missing", ",").alias("missing"),
        "calls_to_complete",
    )


@query
def dominant_in_small_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominance in requests that include the comps of one unit of their pull only, where it does occur."""
    scored, _ = Workbench(spark, sf_dir).scored()
    house = F.split_part("comp_key", F.lit(" "), F.lit(1)).cast("bigint")
    s = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("bigint")
    # the totals of all included comps are not those of these few
    few = scored.drop("total_weight").withColumn("included", F.col("included") & (house % 50 == s % 50))
    shared = curation.contribution_shares(few).where("included")
    return shared.select("request_id", "comp_key", views.dominates(F.col("contribution_share")).alias("dominant"))


@query
def cohort_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort median of every pair, those of cohorts without evidence included."""
    scored, medians = Workbench(spark, sf_dir).scored()
    found = scored.select("request_id", "cohort_year", "comp_key").join(
        medians.select("request_id", "cohort_year", "median_psf", "basis"), ["request_id", "cohort_year"], "left"
    )
    return rounded(found, "median_psf")


@query
def listing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and unit of every listing; a record without an id is a listing of its own address."""
    named = shaping.with_identity(Workbench(spark, sf_dir).records(), "status")
    anonymous = F.when(F.col("id").isNull(), F.col("own_key"))
    return (
        named.withColumn("anonymous_key", anonymous)
        .groupBy("pull_ref", "id", "anonymous_key")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count_if(F.col("status") == "Active").alias("active_copies"),
            F.min(F.when(F.col("own_key") != "|", F.col("own_key"))).alias("group_key"),
        )
    )
