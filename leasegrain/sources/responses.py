"""Raw responses: reading, parsing, quarantine and appending.

A store is a folder ``<root>/<pull_ref>/raw/<sig>-off<offset>.json`` with
``.meta.json`` sidecars and one ``<root>/<pull_ref>/manifest.json`` per pull.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrain.schemas import LISTING

_PAGE = "-off"
_SIDECAR = ".meta.json"


def read_responses(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored response: ``pull_ref, file_name, body, ...``.

    Files are read whole; a response holds one page of a search.
    """
    files = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(root)
        .select(
            F.col("value").alias("body"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("file_name"),
        )
    )
    stored = files.where(F.col("_path").rlike(r"/raw/[^/]+$") & ~F.col("file_name").endswith(_SIDECAR))
    return with_file_facts(
        stored.withColumn("pull_ref", F.regexp_extract("_path", r"/([^/]+)/raw/[^/]+$", 1)).drop("_path")
    )


def with_file_facts(responses: DataFrame) -> DataFrame:
    """Add ``sig``, ``status``, ``year`` and ``page_offset`` out of the name.

    ``inactive`` contains ``active``, so it is tested first.
    """
    stem = F.regexp_replace("file_name", r"\.json$", "")
    return responses.withColumns(
        {
            "sig": F.regexp_replace(stem, rf"{_PAGE}(?!.*{_PAGE}).*$", ""),
            "status": F.when(stem.contains("inactive"), "Inactive").otherwise("Active"),
            "year": F.regexp_extract(stem, r"^y(\d{4})-", 1).try_cast("int"),
            "page_offset": F.coalesce(F.regexp_extract(stem, rf"{_PAGE}(\d+)$", 1).try_cast("int"), F.lit(0)),
        }
    )


def _is_object(value: Column) -> Column:
    """Whether a variant is an object, whatever its fields: a schema of it would walk through all of them."""
    return F.try_variant_get(value, "$", "struct<_:variant>").isNotNull()


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``usable``, ``entries`` (the objects of the body, as variants) and ``n_records``.

    A usable body is an array, or an object with an array of ``listings``; an
    empty array is usable, which is not the same as no evidence. A body is
    parsed once; what follows reads its variant.
    """
    # a value of another kind, or a path that leads nowhere, gives null
    bare, inner = (F.try_variant_get("_json", path, "array<variant>") for path in ("$", "$.listings"))
    return (
        responses.withColumn("_json", F.try_parse_json("body"))
        .withColumn("_all", F.coalesce(bare, inner))
        .withColumn("usable", F.col("_all").isNotNull())
        .withColumn("entries", F.filter("_all", _is_object))
        .withColumn("n_records", F.coalesce(F.size("entries"), F.lit(0)))
        .drop("_json", "_all")
    )


def listing_records(parsed: DataFrame, *keep: str) -> DataFrame:
    """The listings of all usable responses, one row each, with the columns ``keep`` of their response.

    Fields are read from the variant by type; a field of another type is null. They are
    read inside the explosion, and responses without entries are left out after it: a
    filter on a listing's fields is pushed down to where they are read, and would read
    all of them again for each it names, or parse the body again.
    """
    typed = F.transform("entries", lambda e: F.try_variant_get(e, "$", LISTING.simpleString()))
    return (
        parsed.select("pull_ref", F.col("status").alias("response_status"), *keep, F.explode_outer(typed).alias("listing"))
        .where(F.col("listing").isNotNull())
        .select("pull_ref", "response_status", *keep, "listing.*")
    )


def unusable_responses(parsed: DataFrame) -> DataFrame:
    """Responses that are no evidence; an empty market is not among them."""
    return parsed.where(~F.col("usable")).drop("usable", "entries", "n_records")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """When each response arrived; unreadable sidecars give nulls."""
    meta = "sig string, `offset` int, total_count int, as_of string, fetched_at string"
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{_SIDECAR}")
        .text(root)
        .select(
            F.regexp_extract("_metadata.file_path", r"/([^/]+)/raw/[^/]+$", 1).alias("pull_ref"),
            F.regexp_replace("_metadata.file_name", r"\.meta\.json$", "").alias("stem"),
            F.from_json("value", meta).alias("m"),
        )
        .select("pull_ref", "stem", "m.*")
    )


def append_responses(responses: DataFrame, path: str) -> None:
    """Append bodies unmodified to the raw table; empty bodies are refused.

    ``responses`` has ``pull_ref, file_name, body`` and the sidecar columns
    ``as_of, fetched_at, total_count``.
    """
    (
        responses.where(F.length("body") > 0)
        .write.mode("append")
        .partitionBy("pull_ref")
        .parquet(path)
    )
