"""A candidate rent against its nearest comps: guard or survival curve."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.config import DAYS_PER_MONTH, GUARD_MINIMUM, GUARD_RANGE
from leasegrain.operators.cohorts import EDGES, bucket_of
from leasegrain.operators.spread import spread_join
from leasegrain.operators.statistics import expected_days, km_steps, survival_at

_EDGE = ["request_id", "edge"]
_OUTCOME = ["effective_dom", "censored", "removal_class", "weight", "cohort_year", "cut_count"]


def candidate_edges(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """The candidate's premium at each drift edge, for requests that have both
    a candidate rent and an anchor."""
    asked = requests.where(F.col("candidate_rent").isNotNull()).select("request_id", "candidate_rent")
    return (
        edges.select(*_EDGE, "anchor_rent")
        .join(asked, "request_id")
        .withColumn("candidate_premium", F.col("candidate_rent") / F.col("anchor_rent") - 1.0)
        .drop("anchor_rent")
    )


def nearest(pool: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k comps nearest in premium for each request and edge.

    Only the premium and the comps' fixed order decide. Each task keeps its k
    best per edge before the shuffle (``WindowGroupLimit``); only those meet for
    the final choice, however large a pool is.
    """
    closest = Window.partitionBy(*_EDGE).orderBy("_away", "group_key", "first_listed")
    edges = candidates.groupBy("request_id", "candidate_rent").agg(
        F.collect_list(F.struct("edge", "candidate_premium")).alias("_edges")  # three
    )
    return (
        spread_join(pool, edges, ["request_id"], by=["comp_key"])
        .select("*", F.inline("_edges"))
        .withColumn("_away", F.abs(F.col("premium") - F.col("candidate_premium")))
        .withColumn("neighbor_rank", F.row_number().over(closest))
        .where(F.col("neighbor_rank") <= k)
        .drop("_away", "_edges")
    )


def neighbor_pool(scored: DataFrame) -> DataFrame:
    """Included comps with a premium. Outcomes ride along for later; the
    retrieval above never looks at them."""
    return scored.where(F.col("included") & F.col("premium").isNotNull()).select(
        "request_id",
        "comp_key",
        "group_key",
        "first_listed",
        "premium",
        *_OUTCOME,
    )


def neighbor_union(neighbors: DataFrame) -> DataFrame:
    """Comps that any edge retrieved, with their distance to the mid candidate."""
    mid = F.col("_mid")
    return (
        neighbors.groupBy("request_id", "comp_key")
        .agg(*[F.first(c).alias(c) for c in ["group_key", "first_listed", "premium", *_OUTCOME]])
        .join(
            neighbors.where(F.col("edge") == "mid")
            .groupBy("request_id")
            .agg(F.first("candidate_premium").alias("_mid")),
            "request_id",
        )
        .withColumn("distance", F.abs(mid - F.col("premium")))
        .drop("_mid")
    )


def edge_guards(candidates: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Per request and edge: is the evidence too weak, and why."""
    near = F.abs(F.col("candidate_premium") - F.col("premium")) <= GUARD_RANGE
    found = neighbors.groupBy(*_EDGE).agg(
        F.count(F.lit(1)).alias("n_neighbors"),
        F.bool_and("censored").alias("_all_open"),
        F.count_if(near).alias("n_in_range"),
    )
    reason = F.when(F.coalesce("_all_open", F.lit(False)), "all_censored").when(
        F.col("n_in_range") < GUARD_MINIMUM, "too_few_in_range"
    )
    return (
        candidates.join(found, _EDGE, "left")
        .fillna(0, subset=["n_neighbors", "n_in_range"])
        .withColumn("reason", reason)
        .drop("_all_open")
    )


def guard(edge_reasons: DataFrame) -> DataFrame:
    """Per request: the guard's reason, null when no edge trips."""
    return edge_reasons.groupBy("request_id").agg(
        F.when(F.coalesce(F.bool_or(F.col("reason") == "all_censored"), F.lit(False)), "all_censored")
        .when(F.coalesce(F.bool_or(F.col("reason") == "too_few_in_range"), F.lit(False)), "too_few_in_range")
        .alias("reason"),
        *_band("candidate_premium"),
        F.max("candidate_rent").alias("candidate_rent"),
    )


def _band(column: str) -> list[Column]:
    return [
        F.max(F.when(F.col("edge") == e, F.col(column))).alias(f"{column}_{e}") for e in EDGES
    ]


def price_tests(
    scored: DataFrame,
    requests: DataFrame,
    edges: DataFrame,
    k: int,
    half_width_pct: float,
    horizons: Sequence[int],
    keep: Callable[[DataFrame, str], DataFrame],
) -> dict[str, DataFrame]:
    """The price test of every request with a candidate rent and an anchor.

    ``result`` has one row per tested request with ``state`` guard or curve;
    curve columns are null under a guard. ``neighbors``, ``curve`` and
    ``horizons`` are long tables. ``keep`` materializes what several of them read.
    """
    candidates = candidate_edges(requests, edges)
    pool = neighbor_pool(scored)
    neighbors = keep(nearest(pool, candidates, k), "neighbors")
    guards = edge_guards(candidates, neighbors)
    verdict = keep(guard(guards), "verdicts")
    trusted = verdict.where(F.col("reason").isNull()).select("request_id")
    shown = neighbors.join(trusted, "request_id", "left_semi")
    curve = keep(km_steps(shown, _EDGE), "curves")
    curves = candidates.join(trusted, "request_id", "left_semi").select(*_EDGE, "candidate_rent")
    readouts = survival_at(curves, curve, _EDGE, horizons)

    limits = curves.join(vacancy_limit(curve), "request_id")
    vacancy = (
        expected_days(limits, curve, _EDGE, "truncated_at")
        .withColumn("cost", F.col("days") * F.col("candidate_rent") / float(DAYS_PER_MONTH))
        .groupBy("request_id")
        .agg(F.max("truncated_at").alias("truncated_at"), *_band("days"), *_band("cost"))
    )
    result = (
        verdict.withColumn("state", F.when(F.col("reason").isNull(), "curve").otherwise("guard"))
        .withColumn("bucket", bucket_of(F.col("candidate_premium_mid"), half_width_pct))
        .join(vacancy, "request_id", "left")
    )
    return {
        "result": result,
        "edge_neighbors": neighbors,
        "edge_guards": guards,
        "neighbors": neighbor_union(neighbors),
        "curve": curve,
        "horizons": readouts,
    }


def vacancy_limit(curve: DataFrame) -> DataFrame:
    """The common observation window of a request's three curves."""
    return curve.groupBy("request_id").agg(F.min("truncated_at").alias("truncated_at"))
