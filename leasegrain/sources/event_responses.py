"""Stored responses, manifests, calls and workspaces read out of event tables.

An event is one arrived response (or one saved workspace); a user's day is a
pull with four planned windows. As with the order tables, ``oracles/`` states
the same input in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrain.sources.order_listings import table
from leasegrain.sources.responses import with_file_facts

# event type -> window it answers; anything else answers none
WINDOWS = {
    "click": "y2024-active",
    "view": "y2024-inactive",
    "purchase": "y2023-active",
    "signup": "y2023-inactive",
}


def _pull_ref() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies of every event but failed calls; a ninth of them each is
    cut off, in an unknown envelope, empty, or holds something else as well."""
    sig = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])
    event = F.col("event_id")
    listing = F.concat(F.lit('{"id":"e'), event.cast("string"), F.lit('"}'))
    kind = event % 9
    body = (
        F.when(kind == 0, F.lit('{"listings": ['))
        .when(kind == 1, F.lit('{"data": []}'))
        .when(kind == 2, F.lit("[]"))
        .when(kind == 3, F.concat(F.lit('{"listings": ['), listing, F.lit(", 7]}")))
        .otherwise(F.concat(F.lit("["), listing, F.lit("]")))
    )
    named = (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*WINDOWS))
        .select(
            "event_id",
            _pull_ref().alias("pull_ref"),
            F.concat(
                F.element_at(sig, F.col("event_type")), F.lit("-off"), F.format_string("%03d", event), F.lit(".json")
            ).alias("file_name"),
            body.alias("body"),
            F.when(event % 4 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("as_of"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
            F.when(event % 3 != 0, F.from_json("props", "k int")["k"] % 3).alias("total_count"),
        )
    )
    return with_file_facts(named)


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's day: ``pull_ref, user_id, today``."""
    return (
        table(spark, sf_dir, "events")
        .select("user_id", F.dayofmonth("ts").alias("day"), _pull_ref().alias("pull_ref"))
        .distinct()
        .withColumn("today", F.make_date(F.lit(2024), F.lit(1), F.least(F.lit(20), F.col("day"))))
    )


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four windows of every pull."""
    windows = F.array(
        *[
            F.struct(
                F.lit(place).alias("place"),
                F.lit(sig).alias("sig"),
                F.lit(f"{sig[1:5]} {sig[6:].capitalize()}").alias("label"),
            )
            for place, sig in enumerate(WINDOWS.values())
        ]
    )
    return pulls(spark, sf_dir).select("pull_ref", "user_id", "day", F.inline(windows))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows noted in manifests: of three, one claimed, one failed, one absent."""
    mark = (F.col("user_id") + F.col("day") + F.col("place")) % 3
    return (
        planned(spark, sf_dir)
        .where(mark < 2)
        .select(
            "pull_ref",
            "sig",
            "label",
            (mark == 0).alias("satisfied"),
            F.when(mark == 1, "HTTP 500").alias("error"),
            F.when((mark == 1) & (F.col("day") % 2 == 0), True).alias("owed"),
        )
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of three quarters of the pulls."""
    return (
        pulls(spark, sf_dir)
        .where(F.col("user_id") % 4 != 0)
        .select(
            "pull_ref",
            F.make_date(F.lit(2024), F.lit(1), F.col("day")).alias("as_of"),
            F.lit("06-01").alias("window_start"),
            F.lit("06-16").alias("window_end"),
        )
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one call of the user's account."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("account"), F.to_date("ts").alias("called_on")
    )


def workspace_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one save of the user's workspace; some are broken."""
    event = F.col("event_id")
    document = (
        F.when(event % 7 == 0, F.lit("{broken"))
        .when(event % 7 == 1, F.lit('{"drift_pct": 7.0}'))
        .when(
            event % 7 == 2,
            F.concat(F.lit('{"pull_ref":"'), _pull_ref(), F.lit('","subject":{"sqft":900},"weights":{"a|":-1}}')),
        )
        .otherwise(
            F.concat(F.lit('{"pull_ref":"'), _pull_ref(), F.lit('","subject":{"sqft":900},"weights":{"a|":2}}'))
        )
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.col("ts").alias("saved_at"),
        document.alias("document"),
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per supplier, as typed: many are incomplete or wrong."""
    s = F.col("s_suppkey")

    def pick(values: list, key: Column) -> Column:
        column = F.lit(None)
        for place, value in enumerate(values):
            value = F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(v) for v in value]).cast("array<string>")
            column = F.when(key == place, value) if place == 0 else column.when(key == place, value)
        return column

    starts = [None, "06-01", "11-15", "02-29", "02-30", " 01-01 ", "04-15", "13-01"]
    ends = [None, "06-16", "02-15", "03-10", "03-10", "12-31", "05-20", "02-01"]
    types = [["Apartment", "Condo"], [" Apartment ", "Multi-Family", "Townhouse", "Single Family"], None]
    return table(spark, sf_dir, "supplier").select(
        s.alias("search_id"),
        F.lit("2001-08-01").cast("date").alias("today"),
        F.when(s % 23 != 0, F.concat(F.lit(" "), s.cast("string"), F.lit("  West OAK Street "))).alias("address"),
        F.when(s % 29 != 0, 900.0).alias("subject_sqft"),
        (41.8 + s * 37 % 1000 / 10000.0).alias("center_lat"),
        (-87.7 + s * 53 % 777 / 10000.0).alias("center_lng"),
        F.when(s % 17 == 0, 0.0)
        .when(s % 19 == 0, 150.0)
        .when(s % 97 == 0, 40.0)
        .when(s % 5 != 4, (s % 4 + 1) / 10.0)
        .alias("radius"),
        pick(["2", "1-3", " 0-1 ", "3-1", "1.5", "2:3"], s % 6).alias("bedrooms"),
        pick([None, "", "1-1.5", "1.5", "1:*"], s % 5).alias("bathrooms"),
        F.when(s % 7 == 0, F.array().cast("array<string>")).otherwise(pick(types, s % 3)).alias("property_types"),
        F.when(s % 11 == 0, 6).when(s % 4 != 0, (1 + s % 5).cast("int")).alias("years_back"),
        pick(starts, s % 8).alias("window_start"),
        pick(ends, s % 8).alias("window_end"),
    )
