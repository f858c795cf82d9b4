"""A report on raw records: yields, completeness, gaps and extremes.

A record gives a few tagged measures, which are merged in one aggregate (map-side,
so only the keys of units are many) and then shaped into ``report, item, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.functions.dates import calendar_date
from leasegrain.operators.shaping import with_identity

_EDGE = "\x1f"

_FIELDS = (
    "price",
    "listedDate",
    "bedrooms",
    "bathrooms",
    "removedDate",
    "history",
    "squareFootage",
    "yearBuilt",
)


def _gap_class(days: Column) -> Column:
    return (
        F.when(days <= 1, "0-1")
        .when(days <= 7, "2-7")
        .when(days <= 42, "8-42")
        .when(days <= 180, "43-180")
        .otherwise("over 180")
    )


def _measure(report: str, item: Column, value: Column | None = None) -> Column:
    number = F.lit(None).cast("double") if value is None else value.cast("double")
    return F.struct(F.lit(report).alias("report"), item.cast("string").alias("item"), number.alias("v"))


def _gaps() -> tuple[Column, Column]:
    """Classes of the days between one history event's removal and the next one's start.

    Inside one record, so an array of its own few events is enough.
    """
    events = F.array_sort(
        F.transform(
            F.map_values("history"),
            lambda e: F.struct(calendar_date(e["listedDate"]).alias("s"), calendar_date(e["removedDate"]).alias("e")),
        )
    )
    days = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("_events") - 1), lambda i: F.get("_events", i)["s"].isNotNull() & F.get("_events", i - 1)["e"].isNotNull()),
        lambda i: F.datediff(F.get("_events", i)["s"], F.get("_events", i - 1)["e"]),
    )
    several = F.coalesce(F.size("_events") > 1, F.lit(False))
    return events, F.when(several, F.transform(days, lambda d: _measure("gap days", _gap_class(d)))).otherwise(F.array())


def profile(records: DataFrame) -> DataFrame:
    """``report, item, value`` of all records; an empty table gives no rows.

    ``history events``, ``gap days`` and ``property type`` count records (or
    gaps) per class, ``missing share`` is per field, ``duplicate addresses``
    counts units that several records of a pull state, ``extremes`` are of
    prices.
    """
    named = with_identity(records, "propertyType", "status", "bedrooms", "bathrooms", "squareFootage", "yearBuilt")
    psf = F.when(F.col("squareFootage") > 0, F.col("price") / F.col("squareFootage"))
    events, gaps = _gaps()
    singles = F.array(
        _measure("history events", F.when(F.col("history").isNull(), 0).otherwise(F.size("history"))),
        _measure("property type", F.concat_ws(" / ", "propertyType", "status")),
        _measure("extremes", F.lit("price"), F.col("price")),
        _measure("extremes", F.lit("price per sqft"), psf),
        _measure("unit", F.concat_ws(_EDGE, "pull_ref", "own_key")),
        *[_measure("missing share", F.lit(f), F.col(f).isNull().cast("int")) for f in _FIELDS],
    )
    measures = named.withColumn("_events", events).select(F.inline(F.concat(singles, gaps)))
    merged = measures.groupBy("report", "item").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("share"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    # units, the only large part, become one row
    is_unit = F.col("report") == "unit"
    rolled = merged.groupBy(
        F.when(is_unit, "duplicate addresses").otherwise(F.col("report")).alias("report"),
        F.when(is_unit, "units").otherwise(F.col("item")).alias("item"),
    ).agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("n"), F.max("share").alias("share"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    row = lambda item, value: F.struct(item.alias("item"), value.cast("double").alias("value"))
    report, item = F.col("report"), F.col("item")
    values = (
        F.when(report == "extremes", F.array(row(F.concat(item, F.lit(" min")), F.col("least")), row(F.concat(item, F.lit(" max")), F.col("most"))))
        .when(report == "missing share", F.array(row(item, F.col("share"))))
        .when(report == "duplicate addresses", F.array(row(item, F.col("repeated"))))
        .otherwise(F.array(row(item, F.col("n"))))
    )
    return rolled.select("report", F.inline(values))
