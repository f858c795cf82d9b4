"""Counts and the comps behind them, as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = (
    "pulled",
    "included",
    "excluded",
    "filtered",
    "censored",
    "pending",
    "provisional",
    "confirmed",
    "withdrawal_suspect",
    "missing_sqft",
)


def breakdown_evidence(curated: DataFrame) -> DataFrame:
    """One row per request, comp and label that the comp carries."""
    labels = F.array_compact(
        F.array(
            F.lit("pulled"),
            F.col("state"),
            F.when(F.col("censored"), "censored").otherwise(F.col("removal_class")),
            F.when(F.col("withdrawal_suspect"), "withdrawal_suspect"),
            F.when(F.col("psf").isNull(), "missing_sqft"),
        )
    )
    return curated.select("request_id", F.explode(labels).alias("label"), "comp_key")


def breakdown(curated: DataFrame, requests: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """One row per request; also for a request whose pull has no comps.

    ``dropped`` is the shaping summary, whose window drops the comps themselves
    cannot tell.
    """
    removal = F.col("removal_class")
    counts = curated.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("pulled"),
        F.count_if(F.col("state") == "included").alias("included"),
        F.count_if(F.col("state") == "excluded").alias("excluded"),
        F.count_if(F.col("state") == "filtered").alias("filtered"),
        F.count_if("censored").alias("censored"),
        F.count_if(~F.col("censored") & (removal == "pending")).alias("pending"),
        F.count_if(~F.col("censored") & (removal == "provisional")).alias("provisional"),
        F.count_if(~F.col("censored") & (removal == "confirmed")).alias("confirmed"),
        F.count_if("withdrawal_suspect").alias("withdrawal_suspect"),
        F.count_if(F.col("psf").isNull()).alias("missing_sqft"),
    )
    rows = requests.select("request_id", "pull_ref").join(counts, "request_id", "left").fillna(0, subset=list(LABELS))
    if dropped is not None:
        rows = rows.join(dropped.select("pull_ref", "dropped_outside_window"), "pull_ref", "left")
    return rows.drop("pull_ref")


def cohort_counts(curated: DataFrame) -> DataFrame:
    return curated.groupBy("request_id", "cohort_year").agg(F.count(F.lit(1)).alias("count"))


def derive_warnings(curated: DataFrame, requests: DataFrame, edges: DataFrame) -> DataFrame:
    """``missing_sqft`` with its count, and ``no_anchor`` for untestable rents."""
    missing = (
        curated.where(F.col("psf").isNull())
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("request_id", F.lit("missing_sqft").alias("code"), "n")
    )
    unanchored = (
        requests.where(F.col("candidate_rent").isNotNull())
        .select("request_id")
        .join(edges.select("request_id"), "request_id", "left_anti")
        .select("request_id", F.lit("no_anchor").alias("code"), F.lit(None).cast("bigint").alias("n"))
    )
    return missing.unionByName(unanchored)
