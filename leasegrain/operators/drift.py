"""Drift of asking rents read from the comps themselves.

Cohort medians are rolled up from zip and bedrooms over zip and bedrooms alone to
the whole pull. Within each such group the medians of years with enough comps are
chained to a yearly growth; a subject takes the growth of the finest group around
it that has two such years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.config import Knobs
from leasegrain.operators.spread import spread_join
from leasegrain.operators.statistics import weighted_quantiles

#: Finest first; what a group is bound to.
LEVELS = (("zip and beds", ("zip", "beds")), ("zip", ("zip",)), ("beds", ("beds",)), ("pull", ()))
ANY = "*"
GROUP = ["pull_ref", "level", "zip", "beds"]
MANUAL = "manual"


def _groups(zip_code: Column, beds: Column) -> Column:
    """The groups of all levels around a place; one that needs an unknown value is null."""
    values = {"zip": zip_code.cast("string"), "beds": beds.cast("string")}
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.lit(True) if not bound else F.forall(F.array(*[values[b] for b in bound]), lambda v: v.isNotNull()),
                    F.struct(F.lit(place).alias("level"), *[(values[c] if c in bound else F.lit(ANY)).alias(c) for c in ("zip", "beds")]),
                )
                for place, (_, bound) in enumerate(LEVELS)
            ]
        )
    )


def cohort_ratios(comps: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """``pull_ref, level, zip, beds, cohort_year, median_psf, n, enough, prior_year, growth`` of every group and year.

    ``comps`` has ``pull_ref, zip, beds, cohort_year, psf``. Only years with
    ``min_cohort_size`` comps are linked; ``growth`` is per year, also across
    years without evidence. The median is the lower one, as for cohorts.
    """
    known = comps.where(F.col("psf").isNotNull())
    rows = known.select("pull_ref", "cohort_year", "psf", F.inline(_groups(F.col("zip"), F.col("beds"))))
    keys = [*GROUP, "cohort_year"]
    # equal values are merged before the shuffle; four rows per comp never move as such
    merged = rows.groupBy(*keys, "psf").agg(F.count(F.lit(1)).cast("double").alias("times"))
    medians = weighted_quantiles(merged, keys, "psf", "times", {"median_psf": 0.5}, merged=True)
    sized = medians.join(merged.groupBy(*keys).agg(F.sum("times").cast("long").alias("n")), keys)
    sized = sized.withColumn("enough", F.col("n") >= knobs.min_cohort_size)
    years = Window.partitionBy(*GROUP).orderBy("cohort_year").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("enough"), F.struct("cohort_year", "median_psf")), ignorenulls=True).over(years)
    linked = F.col("enough") & F.col("_before").isNotNull()
    growth = F.pow(F.col("median_psf") / F.col("_before.median_psf"), 1.0 / (F.col("cohort_year") - F.col("_before.cohort_year"))) - 1
    return (
        sized.withColumn("_before", before)
        .withColumn("prior_year", F.when(linked, F.col("_before.cohort_year")))
        .withColumn("growth", F.when(linked & (F.col("_before.median_psf") > 0), growth))
        .drop("_before")
    )


def group_drifts(ratios: DataFrame) -> DataFrame:
    """``drift_pct, years, evidence`` of every group with two linked years: the chained growth per year."""
    linked = F.col("growth").isNotNull()
    span = F.when(linked, F.col("cohort_year") - F.col("prior_year"))
    total = F.sum(F.when(linked, F.log1p("growth") * (F.col("cohort_year") - F.col("prior_year"))))
    return (
        ratios.where("enough")
        .groupBy(*GROUP)
        .agg(total.alias("_log"), F.sum(span).cast("int").alias("years"), F.min("n").alias("evidence"))
        .where(F.col("years") > 0)
        .select(*GROUP, (F.expm1(F.col("_log") / F.col("years")) * 100).alias("drift_pct"), "years", "evidence")
    )


def subject_drifts(requests: DataFrame, drifts: DataFrame) -> DataFrame:
    """``request_id, drift_source, drift_pct, cohort_drift_pct, years, evidence`` per request.

    ``requests`` has ``request_id, pull_ref, drift_source`` (``zip``, ``cohort`` or
    ``manual``), ``subject_zip, subject_beds, drift_pct``. ``zip`` takes the finest
    group with evidence, ``cohort`` the whole pull; without any, and for
    ``manual``, the request's own value stays. ``cohort_drift_pct`` is the pull's
    own figure to check the others against.
    """
    asked = requests.select(
        "request_id", "pull_ref", "drift_source", F.col("drift_pct").alias("_own"), F.inline(_groups(F.col("subject_zip"), F.col("subject_beds")))
    )
    found = spread_join(asked, drifts, GROUP, by=["request_id"], how="left")
    names = F.array(*[F.lit(name) for name, _ in LEVELS])
    usable = F.col("drift_pct").isNotNull() & (
        (F.col("drift_source") == "zip") | ((F.col("drift_source") == "cohort") & (F.col("level") == len(LEVELS) - 1))
    )
    best = F.min(F.when(usable, F.struct("level", "drift_pct", "years", "evidence")))
    pull = F.max(F.when(F.col("level") == len(LEVELS) - 1, F.col("drift_pct")))
    return (
        found.groupBy("request_id")
        .agg(best.alias("b"), pull.alias("cohort_drift_pct"), F.max("_own").alias("_own"))
        .select(
            "request_id",
            F.coalesce(F.get(names, F.col("b.level")), F.lit(MANUAL)).alias("drift_source"),
            F.coalesce("b.drift_pct", "_own").alias("drift_pct"),
            "cohort_drift_pct",
            "b.years",
            "b.evidence",
        )
    )
