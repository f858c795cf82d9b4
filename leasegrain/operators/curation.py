"""Requests against comps: weights, distance and membership.

Everything below is keyed by ``request_id``. The one large product, requests
times the comps of their pull, is an equi-join on ``pull_ref``: Spark chooses
the broadcast side by size and AQE splits a pull that holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.functions.geo import haversine_miles
from leasegrain.operators.spread import spread_join
from leasegrain.operators.statistics import checked_weight

CURATED_COMP = [
    "comp_key",
    "group_key",
    "first_listed",
    "lat",
    "lng",
    "psf",
    "cohort_year",
    "effective_dom",
    "censored",
    "removal_class",
    "withdrawal_suspect",
]

#: About how many requests a comp meets in one row.
BLOCK = 64


def requests_from_json(documents: DataFrame) -> DataFrame:
    """Flat requests from documents ``request_id`` + request fields."""
    return documents.select(
        "request_id",
        "pull_ref",
        F.col("subject.lat").alias("subject_lat"),
        F.col("subject.lng").alias("subject_lng"),
        F.col("subject.sqft").alias("subject_sqft"),
        F.coalesce("drift_pct", F.lit(0.0)).alias("drift_pct"),
        "candidate_rent",
        F.col("filters.max_distance_mi").alias("max_distance_mi"),
        F.coalesce("filters.hide_censored", F.lit(False)).alias("hide_censored"),
        F.coalesce("filters.leased_only", F.lit(False)).alias("leased_only"),
    )


def weights_from_json(documents: DataFrame) -> DataFrame:
    return documents.select("request_id", F.explode("weights").alias("comp_key", "weight"))


def overrides_from_json(documents: DataFrame) -> DataFrame:
    return documents.select(
        "request_id", F.explode(F.array_distinct("include_overrides")).alias("comp_key")
    )


def request_errors() -> Column:
    """Array of messages for a flat request row; empty when it is valid."""
    return F.array_compact(
        F.array(
            F.when(F.col("pull_ref").isNull(), "pull_ref is required"),
            F.when(F.col("subject_lat").isNull() | F.isnan("subject_lat"), "subject latitude is required"),
            F.when(F.col("subject_lng").isNull() | F.isnan("subject_lng"), "subject longitude is required"),
            F.when(F.coalesce(F.col("subject_sqft") <= 0, F.lit(True)), "subject sqft must be positive"),
            F.when(F.col("candidate_rent") <= 0, "candidate rent must be positive"),
            F.when(F.col("max_distance_mi") < 0, "maximum distance must not be negative"),
        )
    )


def split_requests(requests: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests with their ``errors``).

    Weights are judged per comp first, so a request with very many is merged
    before it is gathered; two weights on one comp would double its pairs.
    """
    bad = (F.col("weight") < 0) | F.isnan("weight")
    per_comp = weights.groupBy("request_id", "comp_key").agg(F.bool_or(bad).alias("bad"), (F.count(F.lit(1)) > 1).alias("twice"))
    faulty = (
        per_comp.where("bad or twice")
        .groupBy("request_id")
        .agg(
            F.when(F.bool_or("bad"), "weights must be non-negative").alias("_negative"),
            F.when(F.bool_or("twice"), "weights must name a comp once").alias("_twice"),
        )
    )
    judged = (
        requests.join(faulty, "request_id", "left")
        .withColumn("errors", F.concat(request_errors(), F.array_compact(F.array("_negative", "_twice"))))
        .drop("_negative", "_twice")
    )
    return (
        judged.where(F.size("errors") == 0).drop("errors"),
        judged.where(F.size("errors") > 0),
    )


def _narrow(comps: DataFrame) -> DataFrame:
    return comps.select("pull_ref", "as_of", *CURATED_COMP, F.size("cut_history").alias("cut_count"))


def _blocks(requests: DataFrame) -> DataFrame:
    """``pull_ref, _blocks``: into how many blocks the requests of a pull are dealt."""
    return requests.groupBy("pull_ref").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))


def _block() -> Column:
    return F.pmod(F.xxhash64("request_id"), F.col("_blocks")).cast("int").alias("_block")


def in_blocks(requests: DataFrame) -> DataFrame:
    """Add ``_block``; requests without a pull have no comps and go."""
    return requests.join(_blocks(requests), "pull_ref").select(*requests.columns, _block())


def cohort_number() -> Column:
    """The cohort year as a key that is never null."""
    return F.coalesce(F.col("cohort_year").cast("bigint"), F.lit(-1 << 40))


def marked_comps(requests: DataFrame, comps: DataFrame, weights: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every comp once per block of its pull's requests, with what those requests ask of it.

    A comp meets several requests, so its row and the few weights and overrides on it
    are far less to move than its pairs. Blocks of about ``BLOCK`` requests bound what
    a row carries, however many requests a pull has. Adds ``_block`` and ``_marks``, a
    map of ``weights`` and ``lifted`` by request.
    """
    blocks = _blocks(requests)
    homes = requests.select("request_id", "pull_ref").distinct().join(blocks, "pull_ref").select("request_id", "pull_ref", _block())
    place = ["comp_key", "pull_ref", "_block"]
    asked = (
        weights.select("request_id", "comp_key", "weight", F.lit(False).alias("lifts"))
        .unionByName(overrides.select("request_id", "comp_key", F.lit(None).cast("double").alias("weight"), F.lit(True).alias("lifts")))
        .join(homes, "request_id")
        .groupBy(*place)
        .agg(F.collect_list(F.struct("request_id", "weight", "lifts")).alias("_asked"))
    )

    def of(request: Column) -> Column:
        own = lambda lifts: F.filter("_asked", lambda m: (m["request_id"] == request) & (m["lifts"] == lifts))
        # structs, so that a weight that is null stays a row
        given = F.transform(own(False), lambda m: F.struct(m["weight"].alias("weight")))
        return F.struct(given.alias("weights"), (F.size(own(True)) > 0).alias("lifted"))

    names = F.array_distinct(F.transform("_asked", lambda m: m["request_id"]))
    marks = asked.withColumn("_names", names).select(*place, F.map_from_arrays("_names", F.transform("_names", of)).alias("_marks"))
    numbers = F.sequence(F.lit(0), F.col("_blocks") - 1)
    met = spread_join(_narrow(comps), blocks, ["pull_ref"], by=["comp_key"])
    return met.select("*", F.explode(numbers).alias("_block")).drop("_blocks").join(marks, place, "left")


def pair(requests: DataFrame, comps: DataFrame) -> DataFrame:
    """Every request with every comp of its pull, and the distance between them.

    ``comps`` may be ``marked_comps`` of the same requests, which may then have
    been put into blocks and cohorts (``cohorts.beside_medians``) already.
    """
    keys = ["pull_ref"]
    if "_block" in comps.columns:
        requests = requests if "_block" in requests.columns else in_blocks(requests)
        keys = ["pull_ref", "_block"]
    else:
        comps = _narrow(comps)
    if "_cohort" in requests.columns:
        comps = comps.withColumn("_cohort", cohort_number())
        keys = [*keys, "_cohort"]
    return spread_join(comps, requests, keys, by=["comp_key"]).withColumn(
        "distance_mi",
        haversine_miles(F.col("subject_lat"), F.col("subject_lng"), F.col("lat"), F.col("lng")),
    )


def effective_weight(requested: Column, psf: Column) -> Column:
    """An explicit weight wins; otherwise 1, or 0 where there is no price per sqft."""
    return F.coalesce(requested, F.when(psf.isNotNull(), 1.0).otherwise(0.0))


def membership(weight: Column, overridden: Column, distance: Column) -> Column:
    """``filtered``, ``included`` or ``excluded``; exactly one for each comp.

    An override lifts the filters only; weight 0 still excludes.
    """
    too_far = F.coalesce(distance > F.col("max_distance_mi"), F.lit(False))
    open_hidden = F.col("hide_censored") & F.col("censored")
    leased = F.coalesce(F.col("removal_class").isin("provisional", "confirmed"), F.lit(False))
    hidden = too_far | open_hidden | (F.col("leased_only") & ~leased)
    return F.when(hidden & ~overridden, "filtered").when(weight > 0, "included").otherwise("excluded")


def _asked(pairs: DataFrame, weights: DataFrame, overrides: DataFrame) -> DataFrame:
    """Both curation tables share one key, so the pairs are shuffled once."""
    marked = overrides.select("request_id", "comp_key").distinct().withColumn("_override", F.lit(True))
    asked = weights.select("request_id", "comp_key", F.col("weight").alias("_asked"))
    return pairs.join(asked, ["request_id", "comp_key"], "left").join(marked, ["request_id", "comp_key"], "left")


def _marked(pairs: DataFrame) -> DataFrame:
    """The same where the comps brought their marks: a weight named twice gives two rows here too."""
    return (
        pairs.withColumn("_mark", F.try_element_at("_marks", F.col("request_id")))
        .withColumn("_given", F.explode_outer("_mark.weights"))
        .withColumns({"_asked": F.col("_given.weight"), "_override": F.col("_mark.lifted")})
        .drop("_marks", "_mark", "_given", "_block", "_cohort")
    )


def curate(pairs: DataFrame, weights: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Add ``weight``, ``overridden``, ``state`` and ``included`` to every pair.

    Without tables of ``weights`` and ``overrides`` the pairs are of ``marked_comps``
    and carry theirs; nothing is shuffled. A negative weight fails the job;
    ``split_requests`` keeps such requests aside.
    """
    return (
        (_marked(pairs) if weights is None else _asked(pairs, weights, overrides))
        .withColumn("weight", effective_weight(checked_weight(F.col("_asked")), F.col("psf")))
        .withColumn("overridden", F.coalesce("_override", F.lit(False)))
        .withColumn("state", membership(F.col("weight"), F.col("overridden"), F.col("distance_mi")))
        .withColumn("included", F.col("state") == "included")
        .drop("_asked", "_override")
    )


def total_weights(curated: DataFrame) -> DataFrame:
    """``request_id, total_weight``: the included weight of every request that includes a comp."""
    return curated.where("included").groupBy("request_id").agg(F.sum("weight").alias("total_weight"))


def contribution_shares(curated: DataFrame) -> DataFrame:
    """Each included comp's share of its request's included weight.

    Totals are aggregated and joined back: a window over a request would put
    all its comps into one task. Pairs that carry ``total_weight`` already, as
    scored ones do, need neither.
    """
    share = F.when(F.col("included") & (F.col("total_weight") > 0), F.col("weight") / F.col("total_weight"))
    joined = curated
    if "total_weight" not in curated.columns:
        joined = spread_join(curated, total_weights(curated), ["request_id"], by=["comp_key"], how="left")
    return joined.withColumn("contribution_share", share).drop("total_weight")
