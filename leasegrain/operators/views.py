"""The rules of the result view that change or label data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.config import DOMINANT_SHARE
from leasegrain.functions.geo import placeable

# Link formats of the listing site and the street-level viewer.
LISTING_LINK = ("https://www.zillow.com/homes/", "_rb/")
STREET_LINK = "https://www.google.com/maps/@?api=1&map_action=pano&viewpoint="
FRAME_PADDING = 0.08


def visible(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("state") != "filtered")


def filtered_out(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("state") == "filtered")


def _overwrite(weights: DataFrame, changes: DataFrame) -> DataFrame:
    keys = ["request_id", "comp_key"]
    new = changes.select(*keys, F.col("weight").alias("_new"))
    return weights.join(new, keys, "full").select(*keys, F.coalesce("_new", "weight").alias("weight"))


def select_all(weights: DataFrame, scored: DataFrame) -> DataFrame:
    """New weights: 1 for every visible comp with a price per square foot."""
    chosen = visible(scored).where(F.col("psf").isNotNull())
    return _overwrite(weights, chosen.withColumn("weight", F.lit(1.0)))


def select_none(weights: DataFrame, scored: DataFrame) -> DataFrame:
    """New weights: 0 for every visible comp."""
    return _overwrite(weights, visible(scored).withColumn("weight", F.lit(0.0)))


def include_comps(
    weights: DataFrame, overrides: DataFrame, scored: DataFrame, chosen: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(weights, overrides) after the chosen comps are included by hand.

    An override lifts the filters; a weight of 0 also becomes 1.
    """
    keys = ["request_id", "comp_key"]
    picked = chosen.select(*keys).distinct()
    added = picked.join(overrides.select(*keys), keys, "left_anti")
    raised = scored.join(picked, keys, "left_semi").where(F.col("weight") <= 0).withColumn("weight", F.lit(1.0))
    return _overwrite(weights, raised), overrides.select(*keys).unionByName(added)


def outcome_text() -> Column:
    """How a comp's vacancy ended, in words; an open listing is never leased."""
    days = F.col("effective_dom").cast("string")
    since = F.col("days_since_removal").cast("string")
    kind = F.col("removal_class")
    return (
        F.when(F.col("censored"), F.concat(F.lit("active "), days, F.lit("+ days")))
        .when(kind == "confirmed", F.concat(F.lit("leased "), days, F.lit(" days")))
        .when(kind == "provisional", F.concat(F.lit("leased "), days, F.lit(" days · provisional")))
        .when((kind == "pending") & since.isNull(), F.lit("removed recently — classifying"))
        .when(kind == "pending", F.concat(F.lit("removed "), since, F.lit(" days ago — classifying")))
        .otherwise(F.concat(F.lit("off market "), days, F.lit(" days")))
    )


def dominates(share: Column) -> Column:
    return F.coalesce(share > DOMINANT_SHARE, F.lit(False))


def map_frames(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: the box around its subject and all placeable comps, padded."""
    points = scored.where(placeable(F.col("lat"), F.col("lng"))).groupBy("request_id").agg(
        F.min("lat").alias("_south"), F.max("lat").alias("_north"), F.min("lng").alias("_west"), F.max("lng").alias("_east")
    )
    framed = requests.select("request_id", "subject_lat", "subject_lng").join(points, "request_id", "left").select(
        "request_id",
        F.least("subject_lat", "_south").alias("_south"),
        F.greatest("subject_lat", "_north").alias("_north"),
        F.least("subject_lng", "_west").alias("_west"),
        F.greatest("subject_lng", "_east").alias("_east"),
    )
    tall = (F.col("_north") - F.col("_south")) * FRAME_PADDING
    wide = (F.col("_east") - F.col("_west")) * FRAME_PADDING
    return framed.select(
        "request_id",
        (F.col("_south") - tall).alias("south"),
        (F.col("_north") + tall).alias("north"),
        (F.col("_west") - wide).alias("west"),
        (F.col("_east") + wide).alias("east"),
    )


def listing_link(address: Column) -> Column:
    slug = F.regexp_replace(F.btrim(address), r"(?U)\s+", "-")
    encoded = F.url_encode(slug)
    # a URI component keeps these, form encoding does not
    for code, plain in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(LISTING_LINK[0]), encoded, F.lit(LISTING_LINK[1]))


def street_link(lat: Column, lng: Column) -> Column:
    return F.format_string(STREET_LINK + "%.4f,%.4f", lat, lng)
