"""Outcome statistics per premium bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.operators.cohorts import EDGES, anchor_bands

BUCKETS = ("below", "at", "above")


def bucket_frame(requests: DataFrame, half_width_pct: float) -> DataFrame:
    """Three rows per request with the premium bounds of each bucket."""
    half = half_width_pct / 100.0
    bounds = {"below": (None, -half), "at": (-half, half), "above": (half, None)}
    rows = F.array(
        *[
            F.struct(
                F.lit(order).alias("bucket_order"),
                F.lit(name).alias("bucket"),
                F.lit(bounds[name][0]).cast("double").alias("premium_min"),
                F.lit(bounds[name][1]).cast("double").alias("premium_max"),
            )
            for order, name in enumerate(BUCKETS)
        ]
    )
    return requests.select("request_id", F.inline(rows))


def bucket_stats(
    scored: DataFrame, requests: DataFrame, edges: DataFrame, half_width_pct: float, min_cohort_size: int
) -> DataFrame:
    """Three rows per request, in bucket order, also for empty buckets.

    Only included comps count. Leased means a provisional or confirmed removal;
    pending removals and open listings never enter a leased statistic. The
    leased median interpolates; it merges equal day counts before the shuffle.
    """
    leased = F.coalesce(F.col("removal_class").isin("provisional", "confirmed"), F.lit(False))
    days = F.when(leased, F.col("effective_dom"))
    cut = F.when(leased, (F.col("cut_count") > 0).cast("double"))
    stats = (
        scored.where("included")
        .where(F.col("bucket").isNotNull())
        .groupBy("request_id", "bucket")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(leased).alias("leased_count"),
            F.median(days).alias("leased_dom_median"),
            F.min(days).alias("leased_dom_min"),
            F.max(days).alias("leased_dom_max"),
            F.avg(cut).alias("cut_before_lease_rate"),
            F.count_if(F.col("removal_class") == "provisional").alias("provisional_count"),
            F.count_if("withdrawal_suspect").alias("withdrawal_suspect_count"),
        )
    )
    counts = ["count", "leased_count", "provisional_count", "withdrawal_suspect_count"]
    framed = (
        bucket_frame(requests, half_width_pct)
        .join(stats, ["request_id", "bucket"], "left")
        .fillna(0, subset=counts)
        .withColumn("thin", (F.col("leased_count") > 0) & (F.col("leased_count") < min_cohort_size))
    )
    rent = anchor_bands(edges).select("request_id", F.col("rent").alias("_rent"))

    def dollars(bound: str) -> Column:
        band = F.struct(*[(F.col(f"_rent.{e}") * (1.0 + F.col(bound))).alias(e) for e in EDGES])
        return F.when(F.col("_rent").isNotNull() & F.col(bound).isNotNull(), band)

    return (
        framed.join(rent, "request_id", "left")
        .withColumn("dollar_min", dollars("premium_min"))
        .withColumn("dollar_max", dollars("premium_max"))
        .drop("_rent")
    )


def censored_floors(scored: DataFrame) -> DataFrame:
    """Open listings per bucket as a histogram of days so far.

    Rows and not a list: the list of a large bucket would not fit one task.
    """
    return (
        scored.where(F.col("included") & F.col("censored") & F.col("bucket").isNotNull())
        .groupBy("request_id", "bucket", "effective_dom")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bucket_evidence(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("included") & F.col("bucket").isNotNull()).select(
        "request_id", "bucket", "comp_key"
    )
