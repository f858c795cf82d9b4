"""Cohort medians, premiums and the drift-adjusted anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.config import DRIFT_SENSITIVITY_PTS, SQFT_SUSPECT_SHARE
from leasegrain.operators.curation import cohort_number
from leasegrain.operators.spread import spread_join
from leasegrain.operators.statistics import weighted_median

EDGES = ("low", "mid", "high")


def _evidence(curated: DataFrame) -> DataFrame:
    """Comps that may enter a price statistic."""
    return curated.where(F.col("included") & (F.col("weight") > 0) & F.col("psf").isNotNull())


def pulled_medians(comps: DataFrame) -> DataFrame:
    """Unweighted lower median per pull and cohort, over every comp with a psf.

    It does not depend on a request, so it is computed once per pull and not
    once per request.
    """
    return weighted_median(comps, ["pull_ref", "cohort_year"], "psf", F.lit(1.0), "pulled_median")


def cohort_medians(curated: DataFrame, comps: DataFrame, min_cohort_size: int) -> DataFrame:
    """One row per request and listing year, also for years without evidence.

    The selected comps' weighted median, or the pulled median where fewer than
    ``min_cohort_size`` comps are selected.
    """
    usable = F.col("included") & (F.col("weight") > 0) & F.col("psf").isNotNull()
    counts = curated.groupBy("request_id", "pull_ref", "cohort_year").agg(
        F.count_if(usable).alias("selected_count"),
        F.count("psf").alias("pulled_count"),
    )
    selected = weighted_median(_evidence(curated), ["request_id", "cohort_year"], "psf", out="_selected")
    thin = F.col("selected_count") < min_cohort_size
    median = F.when(F.col("thin"), F.col("pulled_median")).otherwise(F.col("_selected"))
    basis = F.when(F.col("thin"), "pulled").otherwise("selected")
    return (
        counts.join(selected, ["request_id", "cohort_year"], "left")
        .join(pulled_medians(comps), ["pull_ref", "cohort_year"], "left")
        .withColumn("thin", thin)
        .withColumn("median_psf", median)
        .withColumn("basis", F.when(F.col("median_psf").isNotNull(), basis))
        .select(
            "request_id", "cohort_year", "selected_count", "pulled_count", "median_psf", "basis", "thin"
        )
    )


def premium(psf: Column, median: Column) -> Column:
    """Price relative to the comp's own cohort; null, never 0, if unknown."""
    return F.when(median > 0, psf / median - 1.0)


def sqft_suspect(value: Column) -> Column:
    return F.coalesce(F.abs(value) > SQFT_SUSPECT_SHARE, F.lit(False))


def bucket_of(value: Column, half_width_pct: float) -> Column:
    """``below``, ``at`` or ``above``; both edges belong to ``at``."""
    half = half_width_pct / 100.0
    return F.when(value < -half, "below").when(value > half, "above").when(value.isNotNull(), "at")


def beside_medians(requests: DataFrame, comps: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Requests once per cohort of their pull, with its median: ``_cohort, median_psf, basis``.

    So a pair finds its median where request and comp meet.
    """
    years = comps.select("pull_ref", "cohort_year", cohort_number().alias("_cohort")).distinct()
    medians = cohorts.select("request_id", "cohort_year", "median_psf", "basis")
    return requests.join(years, "pull_ref").join(medians, ["request_id", "cohort_year"], "left").drop("cohort_year")


def with_premiums(curated: DataFrame, cohorts: DataFrame, half_width_pct: float) -> DataFrame:
    """Add ``premium``, ``premium_basis``, ``sqft_suspect`` and ``bucket``.

    Pairs whose request brought its medians (``beside_medians``) are not shuffled again.
    """
    referred = curated
    if "median_psf" not in curated.columns:
        reference = cohorts.select("request_id", "cohort_year", "median_psf", "basis")
        referred = spread_join(curated, reference, ["request_id", "cohort_year"], by=["comp_key"], how="left")
    return (
        referred.withColumn("premium", premium(F.col("psf"), F.col("median_psf")))
        .withColumn("premium_basis", F.when(F.col("premium").isNotNull(), F.col("basis")))
        .withColumn("sqft_suspect", sqft_suspect(F.col("premium")))
        .withColumn("bucket", bucket_of(F.col("premium"), half_width_pct))
        .drop("median_psf", "basis")
    )


def drift_edges(drift_pct: Column) -> Column:
    """The three drift assumptions as an array of ``(edge, drift)``."""
    steps = (-DRIFT_SENSITIVITY_PTS, 0.0, DRIFT_SENSITIVITY_PTS)
    return F.array(
        *[
            F.struct(F.lit(edge).alias("edge"), (drift_pct + step).alias("edge_drift"))
            for edge, step in zip(EDGES, steps)
        ]
    )


def anchors(curated: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request with evidence and drift edge: anchor psf and rent.

    Every comp is moved from its cohort year to the year of observation; equal
    prices of a year are merged before the three edges triple the rows.
    """
    merged = (
        _evidence(curated)
        .groupBy("request_id", F.year("as_of").alias("_year"), "cohort_year", "psf", "drift_pct")
        .agg(F.sum("weight").alias("weight"))
    )
    rate = F.lit(1.0) + F.col("edge_drift") / 100.0
    adjusted = (
        merged.select("*", F.inline(drift_edges(F.col("drift_pct"))))
        .withColumn("adjusted", F.col("psf") * F.pow(rate, F.col("_year") - F.col("cohort_year")))
    )
    # equal prices were merged per year, and a year moves them to one value
    medians = weighted_median(adjusted, ["request_id", "edge"], "adjusted", out="anchor_psf", merged=True)
    counts = _evidence(curated).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_comps"))
    return (
        requests.select("request_id", "subject_sqft", F.inline(drift_edges(F.col("drift_pct"))))
        .join(medians, ["request_id", "edge"])
        .join(counts, "request_id")
        .withColumn("anchor_rent", F.col("anchor_psf") * F.col("subject_sqft"))
    )


def anchor_bands(edges: DataFrame) -> DataFrame:
    """Anchor edges pivoted to one row per request with low/mid/high structs."""

    def at(edge: str, column: str) -> Column:
        return F.max(F.when(F.col("edge") == edge, F.col(column))).alias(edge)

    return edges.groupBy("request_id").agg(
        F.struct(*[at(e, "anchor_rent") for e in EDGES]).alias("rent"),
        F.struct(*[at(e, "anchor_psf") for e in EDGES]).alias("psf"),
        F.max(F.when(F.col("edge") == "mid", F.col("edge_drift"))).alias("drift_pct"),
        F.max("subject_sqft").alias("subject_sqft"),
        F.max("n_comps").alias("n_comps"),
    ).withColumn("drift_sensitivity_pts", F.lit(DRIFT_SENSITIVITY_PTS))


def anchor_evidence(curated: DataFrame) -> DataFrame:
    """The comps behind each anchor, one row each."""
    return _evidence(curated).select("request_id", "comp_key")
