"""Listings, pulls, requests and curation read out of order tables.

The benchmark tables hold no listings. These views map them onto the listing
model with plain arithmetic, so that another engine can state the same input:
an order is a listing, a customer is a unit, a hundred customers are a pull and
a supplier asks for a price. ``oracle/`` holds the same views in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrain.operators.curation import curate, pair
from leasegrain.operators.shaping import Shaped, shape
from leasegrain.plans.derive import results, score
from leasegrain.schemas import LISTING
from leasegrain.session import staged

UNITS_PER_PULL = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pull_ref(number: Column) -> Column:
    return F.concat(F.lit("pull-"), number.cast("string"))


def _pull_number(unit: Column) -> Column:
    return F.floor(unit / UNITS_PER_PULL)


def _iso(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))


#: An earlier observation of all pulls: removals after this day are not known yet.
EARLIER = "2001-02-01"


def listing_records(spark: SparkSession, sf_dir: str, version: str | None = None) -> DataFrame:
    """Raw listing records with ``pull_ref`` and ``status``.

    ``version`` gives two observations of one search instead: ``before``, what
    was known on ``EARLIER``, and ``after``, in which some listings are gone.

    Every order is an Inactive record; one in eleven also has an Active copy
    that names a different address, so that one listing id disagrees with
    itself. Some records have no id, no address, no area or an unreadable date.
    """
    order = F.col("o_orderkey")
    unit = F.col("o_custkey")
    listed = F.col("o_orderdate").cast("date")
    removed = F.when(order % 23 != 0, F.date_add(listed, (order * 37 % 200 + 1).cast("int")))
    orders = table(spark, sf_dir, "orders")
    if version == "before":
        orders = orders.where(listed <= F.lit(EARLIER).cast("date"))
        removed = F.when(removed <= F.lit(EARLIER).cast("date"), removed)
    elif version == "after":
        orders = orders.where(order % 31 != 5)
    number = (unit % 5).cast("string")
    label = F.when(unit % 5 != 0, F.element_at(
        F.array(
            F.concat(F.lit("Unit "), number),
            F.concat(F.lit("Apt "), number),
            F.concat(F.lit("#"), number),
            F.concat(F.lit("# "), number),
        ),
        (order % 4 + 1).cast("int"),
    ))
    house = unit.cast("string")
    street = F.element_at(
        F.array(
            F.concat(house, F.lit(" West Oak Street")),
            F.concat(house, F.lit(" W. Oak St")),
            F.concat(house, F.lit("  w oak street,")),
        ),
        (order % 3 + 1).cast("int"),
    )
    sqft = F.when(order % 29 == 0, 0.0).when(order % 7 != 0, 500.0 + order * 13 % 1500)
    event_type = LISTING["history"].dataType.valueType

    def event(start: Column, end: Column, price: Column) -> Column:
        return F.struct(
            F.lit("Rental Listing").alias("event"),
            price.alias("price"),
            F.lit("Standard").alias("listingType"),
            _iso(start).alias("listedDate"),
            end.alias("removedDate"),
            F.lit(None).cast("int").alias("daysOnMarket"),
        ).cast(event_type)

    earlier = F.date_sub(listed, 400)
    price = F.col("o_totalprice")
    history = F.when(
        order % 5 == 0,
        F.create_map(
            F.date_format(listed, "yyyy-MM-dd"),
            event(listed, _iso(removed), price),
            F.date_format(earlier, "yyyy-MM-dd"),
            event(earlier, _iso(F.date_add(earlier, 50)), price - 50.0),
        ),
    )
    nameless = order % 251 == 0
    main = orders.select(
        _pull_ref(_pull_number(unit)).alias("pull_ref"),
        F.when(order % 97 != 0, order.cast("string")).alias("id"),
        F.lit(None).cast("string").alias("formattedAddress"),
        F.when(~nameless, street).alias("addressLine1"),
        F.when(~nameless, label).alias("addressLine2"),
        F.when(order % 13 != 0, 41.8 + (unit % 1000) / 10000.0).alias("latitude"),
        F.when(order % 13 != 0, -87.7 + (unit % 777) / 10000.0).alias("longitude"),
        F.element_at(
            F.array(*[F.lit(t) for t in ("Apartment", "Single Family", "Condo", "Townhouse", "Multi-Family")]),
            (unit % 5 + 1).cast("int"),
        ).alias("propertyType"),
        (unit % 4).cast("double").alias("bedrooms"),
        F.when(order % 5 != 0, 1 + unit % 3 * 0.5).alias("bathrooms"),
        sqft.alias("squareFootage"),
        F.lit(None).cast("int").alias("yearBuilt"),
        F.lit("Inactive").alias("status"),
        price.alias("price"),
        _iso(listed).alias("listedDate"),
        F.when(order % 499 == 0, F.lit("unknown")).otherwise(_iso(removed)).alias("removedDate"),
        history.alias("history"),
    )
    copies = (
        orders.where(order % 11 == 0)
        .select(
            _pull_ref(_pull_number(unit)).alias("pull_ref"),
            F.when(order % 97 != 0, order.cast("string")).alias("id"),
            F.concat(house, F.lit(" West Oak Street Rear")).alias("formattedAddress"),
            F.lit(None).cast("string").alias("addressLine1"),
            label.alias("addressLine2"),
            F.lit(None).cast("double").alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
            F.lit("Apartment").alias("propertyType"),
            (unit % 4).cast("double").alias("bedrooms"),
            F.lit(None).cast("double").alias("bathrooms"),
            F.lit(None).cast("double").alias("squareFootage"),
            F.lit(None).cast("int").alias("yearBuilt"),
            F.lit("Active").alias("status"),
            (price + 100.0).alias("price"),
            _iso(listed).alias("listedDate"),
            F.lit(None).cast("string").alias("removedDate"),
            F.lit(None).cast(LISTING["history"].dataType).alias("history"),
        )
    )
    return copies.unionByName(main)


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pull with its observation date and season window."""
    number = F.col("number")
    start = F.element_at(F.array(F.lit("01-01"), F.lit("03-15"), F.lit("11-15")), (number % 3 + 1).cast("int"))
    end = F.element_at(F.array(F.lit("12-31"), F.lit("09-30"), F.lit("02-15")), (number % 3 + 1).cast("int"))
    return (
        table(spark, sf_dir, "customer")
        .select(_pull_number(F.col("c_custkey")).alias("number"))
        .distinct()
        .select(
            _pull_ref(number).alias("pull_ref"),
            F.date_add(F.lit("2001-08-01").cast("date"), (number % 5).cast("int")).alias("as_of"),
            start.alias("window_start"),
            end.alias("window_end"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pricing request per supplier, about seven per pull."""
    s = F.col("s_suppkey")
    pull = F.floor(s * 3 / 20)
    centre = pull * 100 + 50
    sqft = 800.0 + s % 25 * 20
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("req-"), s.cast("string")).alias("request_id"),
        _pull_ref(pull).alias("pull_ref"),
        (41.8 + centre % 1000 / 10000.0).alias("subject_lat"),
        (-87.7 + centre % 777 / 10000.0).alias("subject_lng"),
        sqft.alias("subject_sqft"),
        (s % 5 + 3).cast("double").alias("drift_pct"),
        F.when(s % 2 == 1, sqft * 200).when(s % 4 == 0, sqft * 450).alias("candidate_rent"),
        F.when(s % 3 == 0, 0.35).alias("max_distance_mi"),
        (s % 4 == 1).alias("hide_censored"),
        (s % 7 == 2).alias("leased_only"),
    )


def _asked_pairs(requests: DataFrame, comps: DataFrame) -> DataFrame:
    """Each comp's house number plus the request's number as ``mark``.

    Both are read out of their text before the rows multiply; text that is no
    number fails as it would in the pairs, and only where there is a pair.
    """
    house = F.split_part("comp_key", F.lit(" "), F.lit(1))
    number = F.split_part("request_id", F.lit("-"), F.lit(2))
    mark = F.coalesce("_house", house.cast("bigint")) + F.coalesce("_number", number.cast("bigint"))
    return (
        requests.select("request_id", "pull_ref", number.try_cast("bigint").alias("_number"))
        .join(comps.select("pull_ref", "comp_key", house.try_cast("bigint").alias("_house")), "pull_ref")
        .withColumn("mark", mark)
        .drop("_house", "_number")
    )


def request_weights(requests: DataFrame, comps: DataFrame) -> DataFrame:
    """An explicit weight of 0 to 3 for a third of the comps."""
    return (
        _asked_pairs(requests, comps)
        .where("mark % 3 = 0")
        .select("request_id", "comp_key", (F.floor(F.col("mark") / 3) % 4).cast("double").alias("weight"))
    )


def request_overrides(requests: DataFrame, comps: DataFrame) -> DataFrame:
    return _asked_pairs(requests, comps).where("mark % 10 = 0").select("request_id", "comp_key")


class Workbench:
    """The views above and the jobs over them.

    Tables that many results read are written once per session, as the jobs
    themselves would do between their stages.
    """

    _written: dict[tuple[str, str, str], object] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def once(self, name: str, make: Callable[[], object]) -> object:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in self._written:
            self._written[key] = make()
        return self._written[key]

    def records(self) -> DataFrame:
        return listing_records(self.spark, self.sf_dir)

    def pulls(self) -> DataFrame:
        return pulls(self.spark, self.sf_dir)

    def version(self, name: str) -> DataFrame:
        """The comps of one of two observations, ``before`` or ``after``."""
        pulls = self.pulls()
        if name == "before":
            number = F.split_part("pull_ref", F.lit("-"), F.lit(2)).cast("int")
            pulls = pulls.withColumn("as_of", F.date_add(F.lit(EARLIER).cast("date"), number % 5))
        records = listing_records(self.spark, self.sf_dir, name)
        return self.once(name, lambda: staged(shape(records, pulls).comps, f"comps-{name}"))

    def shaped(self) -> Shaped:
        return shape(self.records(), self.pulls())

    def shaped_once(self) -> Shaped:
        """The same with its chains written, for what reads more than one result."""
        return self.once("shaped", lambda: shape(self.records(), self.pulls(), keep=staged))

    def comps(self) -> DataFrame:
        """The comps table: the shaping job's output, read by all that follows."""
        return self.once("comps", lambda: staged(self.shaped_once().comps, "comps"))

    def requests(self) -> DataFrame:
        return requests(self.spark, self.sf_dir)

    def weights(self) -> DataFrame:
        return request_weights(self.requests(), self.comps())

    def overrides(self) -> DataFrame:
        return request_overrides(self.requests(), self.comps())

    def curated(self) -> DataFrame:
        return curate(pair(self.requests(), self.comps()), self.weights(), self.overrides())

    def scored(self) -> tuple[DataFrame, DataFrame]:
        """(scored pairs, cohort medians)."""
        return self.once(
            "scored", lambda: score(self.requests(), self.comps(), self.weights(), self.overrides())
        )

    def derived(self) -> dict[str, DataFrame]:
        """All results of all requests."""
        scored, medians = self.scored()
        return self.once(
            "derived",
            lambda: results(
                scored, medians, self.requests(), self.comps(), summary=self.shaped_once().summary
            ),
        )
