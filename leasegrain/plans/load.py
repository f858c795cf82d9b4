"""A store of raw responses, shaped into comps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leasegrain.config import Knobs
from leasegrain.operators.shaping import Shaped, shape
from leasegrain.operators.spread import spread_join
from leasegrain.sources.bookkeeping import read_manifests
from leasegrain.sources.responses import listing_records, parse_responses, read_responses


def shape_store(spark: SparkSession, root: str, knobs: Knobs = Knobs()) -> Shaped:
    """Comps of every pull that has a readable manifest and a usable response."""
    parsed = parse_responses(read_responses(spark, root))
    return shape(listing_records(parsed), read_manifests(spark, root), knobs)


def shape_pulls(responses: DataFrame, manifests: DataFrame, wanted: DataFrame, knobs: Knobs = Knobs()) -> Shaped:
    """The same for the pulls in ``wanted`` only, for incremental runs."""
    chosen = spread_join(responses, wanted.select("pull_ref"), ["pull_ref"], by=["file_name"], how="left_semi")
    return shape(listing_records(parse_responses(chosen)), manifests, knobs)
