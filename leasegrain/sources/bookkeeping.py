"""Manifests, workspaces, the call log, knobs and pre-shaped pulls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leasegrain.config import KnobError, Knobs
from leasegrain.functions.dates import calendar_date, valid_month_day
from leasegrain.operators.shaping import price_per_sqft, with_final_keys
from leasegrain.schemas import LEDGER, MANIFEST, SHAPED_PULL, WORKSPACE


def _whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


# ---- manifests


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable manifest: ``pull_ref, as_of, window_start, window_end,
    planned, fetchable, windows``."""
    files = _whole_files(spark, root, "manifest.json")
    parsed = files.select(
        F.regexp_extract("path", r"/([^/]+)/manifest\.json$", 1).alias("pull_ref"),
        F.from_json("value", MANIFEST).alias("m"),
    )
    return parsed.select(
        "pull_ref",
        calendar_date(F.col("m.as_of")).alias("as_of"),
        F.get("m.window", F.lit(0)).alias("window_start"),
        F.get("m.window", F.lit(1)).alias("window_end"),
        F.coalesce("m.planned", F.lit(0)).alias("planned"),
        F.coalesce("m.fetchable", F.lit(0)).alias("fetchable"),
        F.coalesce("m.queries", F.array().cast(MANIFEST["queries"].dataType)).alias("windows"),
    ).where(
        F.col("as_of").isNotNull() & valid_month_day(F.col("window_start")) & valid_month_day(F.col("window_end"))
    )


def manifest_windows(manifests: DataFrame) -> DataFrame:
    """Recorded windows; ``owed`` is null where an old manifest does not say."""
    return manifests.select("pull_ref", F.inline("windows")).withColumn(
        "satisfied", F.coalesce("satisfied", F.lit(False))
    )


def write_manifests(manifests: DataFrame, windows: DataFrame, path: str) -> None:
    """Replace the manifest tables of exactly the pulls given.

    The writer overwrites only the partitions it has rows for.
    """
    for frame, name in ((manifests.drop("windows"), "pull_manifest"), (windows, "pull_windows")):
        (
            frame.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("pull_ref")
            .parquet(f"{path}/{name}")
        )


# ---- workspaces


def save_workspaces(workspaces: DataFrame, path: str) -> None:
    """Append a version; the latest one replaces, it is never merged.

    ``workspaces`` has ``key, saved_at`` (timestamp) and ``document`` (JSON).
    """
    workspaces.select("key", "saved_at", "document").write.mode("append").parquet(path)


def latest_workspaces(versions: DataFrame) -> DataFrame:
    """The last saved version per key, merged before the shuffle."""
    return (
        versions.groupBy("key")
        .agg(F.max(F.struct("saved_at", "document")).alias("last"))
        .select("key", "last.saved_at", "last.document")
    )


def parse_workspaces(versions: DataFrame) -> DataFrame:
    """Add the parsed ``state`` and ``error``; a bad document keeps its row."""
    schema = T.StructType([*WORKSPACE.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("document", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    negative = F.exists(F.map_values("state.weights"), lambda w: w < 0)
    error = (
        F.when(F.col("state").isNull() | F.col("state._corrupt_record").isNotNull(), "unreadable")
        .when(F.col("state.pull_ref").isNull() | F.col("state.subject").isNull(), "incomplete")
        .when(F.coalesce(negative, F.lit(False)), "negative weight")
    )
    return versions.withColumn("state", parsed).withColumn("error", error)


def list_workspaces(parsed: DataFrame) -> DataFrame:
    """Newest first; ties by key, also descending."""
    return parsed.orderBy(F.desc_nulls_last("saved_at"), F.desc("key"))


def read_workspaces(spark: SparkSession, root: str) -> DataFrame:
    """Workspace files as versions; ``saved_at`` falls back to the file's time."""
    files = _whole_files(spark, root, "*.json")
    stated = F.get_json_object("value", "$.saved_at").try_cast("timestamp")
    return files.select(
        F.regexp_replace("file_name", r"(\.workspace)?\.json$", "").alias("key"),
        F.coalesce(stated, "modified").alias("saved_at"),
        F.col("value").alias("document"),
    )


# ---- call log


def read_ledgers(spark: SparkSession, root: str) -> DataFrame:
    """One row per ledger file with its month, spent calls and ``error``.

    A ledger is an object whose count is absent or a whole number of at least 0;
    anything else is an error, as a guess would hand back paid calls.
    """
    files = _whole_files(spark, root, "ledger*.json").withColumn("_json", F.try_parse_json("value"))
    count = F.try_variant_get("_json", "$.calls_this_month", "variant")
    good = (F.schema_of_variant(count) == "BIGINT") & (F.try_variant_get("_json", "$.calls_this_month", "bigint") >= 0)
    cause = (
        F.when(F.col("_json").isNull(), "not JSON")
        .when(~F.ltrim("value").startswith("{"), "not an object")
        .when(~F.coalesce(good, F.lit(True)), "bad call count")
    )
    return files.select("path", F.from_json("value", LEDGER).alias("ledger"), cause.alias("error"))


def current_spend(ledgers: DataFrame, month_now: str) -> DataFrame:
    """Calls spent in ``month_now``: a past month's count has rolled over, an
    absent or malformed month counts as the current one."""
    month = F.col("ledger.month")
    past = month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") & (month < month_now)
    spent = F.when(F.coalesce(past, F.lit(False)), 0).otherwise(F.coalesce("ledger.calls_this_month", F.lit(0)))
    return ledgers.withColumn("calls_this_month", F.when(F.col("error").isNull(), spent))


def ledger_calls(ledgers: DataFrame) -> DataFrame:
    return ledgers.select("path", F.inline("ledger.history"))


# ---- knobs


def load_knobs(spark: SparkSession, path: str) -> Knobs:
    """Knobs from a JSON file; the defaults if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return Knobs()
    # one small file by definition: the driver needs it before it can plan
    text = spark.read.option("wholetext", True).text(path).first()[0]
    try:
        payload = json.loads(text)
    except json.JSONDecodeError as error:
        raise KnobError(f"{path} is not valid JSON: {error}") from error
    return Knobs.from_mapping(payload)


def save_knobs(spark: SparkSession, knobs: Knobs, path: str) -> None:
    row = spark.createDataFrame([(json.dumps(knobs.to_mapping()),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


# ---- pre-shaped pulls


def read_shaped_pulls(spark: SparkSession, path: str) -> DataFrame:
    """Comps from pre-shaped pull documents, in the layout of shaped comps."""
    documents = spark.read.schema(SHAPED_PULL).option("multiLine", True).json(path)
    rows = documents.select(
        F.col("ref").alias("pull_ref"),
        F.col("fetched_at").alias("as_of"),
        F.posexplode("comps").alias("_place", "c"),
    ).select("pull_ref", "as_of", "_place", "c.*")
    filled = rows.fillna(0, subset=["relist_count", "gap_days"]).fillna(False, subset=["withdrawal_suspect"])
    empty = F.array().cast(SHAPED_PULL["comps"].dataType.elementType["cut_history"].dataType)
    comps = filled.withColumns(
        {
            "cut_history": F.coalesce("cut_history", empty),
            "psf": price_per_sqft(F.col("initial_ask"), F.col("sqft")),
            # the document's own order stands in for the unit order
            "group_key": F.format_string("%010d", "_place"),
        }
    ).drop("_place")
    return with_final_keys(comps)
