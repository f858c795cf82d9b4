"""Weighted order statistics and survival curves, keyed by any columns.

No group is ever handed whole to one task. Quantiles first merge equal values
and then look only inside the one value bin that holds the answer; survival
curves first merge rows of the same day, so that a curve has at most one row
per distinct day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bins per e-fold of a value: neighbouring bins are about 0.0015 % apart.
_BINS_PER_EFOLD = 1 << 16
# The logarithm of a positive double lies between -745.2 and 709.8.
_LOG_RANGE = 746


def checked_weight(weight: Column) -> Column:
    """The weight; a negative or undefined one fails the job with a message."""
    bad = (weight < 0) | F.isnan(weight)
    return F.when(bad, F.raise_error(F.lit("weights must be non-negative")).cast("double")).otherwise(weight)


def _value_bin(value: Column) -> Column:
    """A bin number that never decreases as the value grows; never null, so that
    no null check on it keeps Spark from sharing a shuffle.

    Bins are relative to the value down to the smallest one; 0, infinities and
    NaN (the largest value, as in Spark's order) have their own.
    """
    size = F.floor((F.ln(F.abs(value)) + _LOG_RANGE) * _BINS_PER_EFOLD) + 1
    last = F.lit(2 * _LOG_RANGE * _BINS_PER_EFOLD)
    infinite = F.lit(float("inf"))
    return (
        F.when(F.isnan(value), last + 1)
        .when(value == infinite, last)
        .when(value == -infinite, -last)
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0).cast("bigint"))
    )


def weighted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | Column,
    qs: Mapping[str, float],
    merged: bool = False,
) -> DataFrame:
    """One row per key with a column per entry ``name: q`` of ``qs``: the
    smallest value whose cumulative weight share is >= q.

    Never interpolates. Rows without a value or with weight 0 are no evidence,
    and keys without evidence have no row. Equal values are merged first, unless
    the caller says that they are ``merged`` already: a value that fills a
    large part of the table is added up before it moves. All quantiles share
    that one pass; then only the bins that hold an answer are put in order.
    """
    for q in qs.values():
        if not 0.0 <= q <= 1.0:
            raise ValueError(f"q must lie in [0, 1], got {q!r}")
    keys = list(keys)
    weight = F.col(weight) if isinstance(weight, str) else weight
    points = (
        df.select(*keys, F.col(value).cast("double").alias("_v"), checked_weight(weight).cast("double").alias("_w"))
        .where(F.col("_v").isNotNull() & (F.col("_w") > 0))
    )
    if not merged:
        points = points.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    points = points.withColumn("_bin", _value_bin(F.col("_v")))

    asked = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(float(q)).alias("_q")) for name, q in qs.items()])
    ordered = Window.partitionBy(*keys).orderBy("_bin")
    crossing = (
        points.groupBy(*keys, "_bin")
        .agg(F.sum("_w").alias("_bin_w"))
        .withColumn("_upto", F.sum("_bin_w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_before", F.lag("_upto", 1, 0.0).over(ordered))
        .withColumn("_total", F.max("_upto").over(Window.partitionBy(*keys)))
        .select(*keys, "_bin", "_upto", "_before", "_total", F.inline(asked))
        .where(
            (F.col("_upto") / F.col("_total") >= F.col("_q"))
            & ((F.col("_before") == 0) | (F.col("_before") / F.col("_total") < F.col("_q")))
        )
        .groupBy(*keys, "_bin", "_before", "_total")
        .agg(F.collect_list(F.struct("_name", "_q")).alias("_asked"))  # as many as asked for
    )

    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    share = (
        F.col("_before") + F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ) / F.col("_total")
    answers = (
        points.join(crossing, [*keys, "_bin"])
        .withColumn("_share", share)
        .withColumn("_previous", F.lag("_share").over(inside))
        .withColumn("_next", F.lead("_share").over(inside))
        .select(*keys, "_v", "_share", "_previous", "_next", F.inline("_asked"))
        # the last value of the bin answers if rounding leaves its share just below q
        .where(
            (F.col("_previous").isNull() | (F.col("_previous") < F.col("_q")))
            & ((F.col("_share") >= F.col("_q")) | F.col("_next").isNull())
        )
    )
    if len(qs) == 1:
        return answers.select(*keys, F.col("_v").alias(next(iter(qs))))
    return answers.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in qs])


def weighted_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | Column = "weight",
    q: float = 0.5,
    out: str = "quantile",
    merged: bool = False,
) -> DataFrame:
    """``weighted_quantiles`` for one q."""
    return weighted_quantiles(df, keys, value, weight, {out: q}, merged)


def weighted_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | Column = "weight",
    out: str = "median",
    merged: bool = False,
) -> DataFrame:
    return weighted_quantile(df, keys, value, weight, 0.5, out, merged)


def _whole_days(duration: Column) -> Column:
    bad = duration.isNull() | (duration < 0) | (duration != F.floor(duration))
    message = F.lit("durations must be whole, non-negative day counts")
    return F.when(bad, F.raise_error(message).cast("int")).otherwise(duration.cast("int"))


def km_steps(
    df: DataFrame,
    keys: Sequence[str],
    duration: str = "effective_dom",
    censored: str = "censored",
    weight: str = "weight",
) -> DataFrame:
    """The weighted product-limit curve: one row per key and event day.

    A row censored on an event day is still at risk on that day. A key without
    events has no rows: nothing was observed to end.
    """
    keys = list(keys)
    by_day = (
        df.select(
            *keys,
            _whole_days(F.col(duration)).alias("day"),
            F.col(censored).alias("_open"),
            checked_weight(F.col(weight)).alias("_w"),
        )
        .where(F.col("_w") > 0)
        .groupBy(*keys, "day")
        .agg(
            F.sum("_w").alias("_at_day"),
            F.sum(F.when(~F.col("_open"), F.col("_w")).otherwise(0.0)).alias("events"),
            F.count_if(F.col("_open")).alias("_open_n"),
        )
    )
    up = Window.partitionBy(*keys).orderBy("day")
    down = Window.partitionBy(*keys).orderBy(F.desc("day"))
    running = up.rowsBetween(Window.unboundedPreceding, 0)
    return (
        by_day.withColumn("at_risk", F.sum("_at_day").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_open_upto", F.sum("_open_n").over(running))
        .withColumn("truncated_at", F.max("day").over(Window.partitionBy(*keys)))
        .where(F.col("events") > 0)
        .withColumn("survival", F.product(1.0 - F.col("events") / F.col("at_risk")).over(running))
        .withColumn("censored_count", F.col("_open_upto") - F.lag("_open_upto", 1, 0).over(up))
        .select(*keys, "day", "survival", "at_risk", "events", "censored_count", "truncated_at")
    )


def survival_at(curves: DataFrame, steps: DataFrame, keys: Sequence[str], days: Sequence[int]) -> DataFrame:
    """One row per key of ``curves`` and horizon: survival at the end of that day.

    1.0 before the first step, the last step's value after it.
    """
    keys = list(keys)
    looked_up = steps.groupBy(*keys).agg(
        *[F.max_by("survival", F.when(F.col("day") <= d, F.col("day"))).alias(f"_s{d}") for d in days]
    )
    readouts = F.array(
        *[
            F.struct(F.lit(d).alias("day"), F.coalesce(F.col(f"_s{d}"), F.lit(1.0)).alias("survival"))
            for d in days
        ]
    )
    return (
        curves.select(*keys)
        .join(looked_up, keys, "left")
        .select(*keys, F.inline(readouts))
    )


def expected_days(
    limits: DataFrame, steps: DataFrame, keys: Sequence[str], limit: str, out: str = "days"
) -> DataFrame:
    """Area under each curve on [0, limit]; ``limits`` has one row per key."""
    keys = list(keys)
    up = Window.partitionBy(*keys).orderBy("day")
    strips = (
        steps.select(*keys, "day", "survival")
        .withColumn("_width", F.col("day") - F.lag("day", 1, 0).over(up))
        .withColumn("_height", F.lag("survival", 1, 1.0).over(up))
        .join(limits.select(*keys, F.col(limit).alias("_limit")), keys)
        .where(F.col("day") < F.col("_limit"))
        .groupBy(*keys)
        .agg(
            F.sum(F.col("_height") * F.col("_width")).alias("_area"),
            F.max("day").alias("_last_day"),
            F.max_by("survival", "day").alias("_last_s"),
        )
    )
    tail = F.coalesce(F.col("_last_s"), F.lit(1.0)) * (F.col(limit) - F.coalesce(F.col("_last_day"), F.lit(0)))
    area = F.coalesce(F.col("_area"), F.lit(0.0)) + tail
    return (
        limits.join(strips, keys, "left")
        .withColumn(out, F.when(F.col(limit) <= 0, F.lit(0.0)).otherwise(area))
        .drop("_area", "_last_day", "_last_s")
    )
