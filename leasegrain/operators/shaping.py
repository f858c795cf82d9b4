"""Raw listing records to comps: one row per continuous vacancy of a unit.

Shuffles, in order: copies of one listing, observations of one listing start,
and one unit. Each of the first two merges rows before it moves them, and a
unit keeps at most one row per calendar day, so the windows over a unit stay
small however often it was observed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrain.config import CONFIRMED_DAYS, DAYS_PER_MONTH, WITHDRAWAL_FLOOR_DAYS, Knobs
from leasegrain.functions.address import SEPARATOR, has_text, names_something, with_comp_key
from leasegrain.functions.dates import calendar_date, in_season, month_day
from leasegrain.operators.spread import spread_join
from leasegrain.session import discard, staged

UNIT = ["pull_ref", "group_key"]
_OBSERVED = ["address", "unit", "lat", "lng", "beds", "baths", "sqft"]


def _stated_address() -> Column:
    line = F.when(F.col("addressLine1") != "", F.col("addressLine1"))
    whole = F.when(F.col("formattedAddress") != "", F.col("formattedAddress"))
    return F.coalesce(line, whole, F.lit(""))


def with_identity(records: DataFrame, *keep: str) -> DataFrame:
    """Add the display fields and ``own_key``, the record's own unit identity.

    Records keep ``pull_ref``, ``id``, the raw dates, price and history, and the
    columns ``keep``.
    """
    named = records.select(
        *keep,
        "pull_ref",
        "id",
        "listedDate",
        "removedDate",
        "price",
        "history",
        _stated_address().alias("address"),
        F.col("addressLine2").alias("unit"),
        F.coalesce("latitude", F.lit(0.0)).alias("lat"),
        F.coalesce("longitude", F.lit(0.0)).alias("lng"),
        F.coalesce("bedrooms", F.lit(0.0)).alias("beds"),
        F.col("bathrooms").alias("baths"),
        F.col("squareFootage").alias("sqft"),
    )
    return with_comp_key(named, "address", "unit", "own_key")


def observations(identified: DataFrame) -> DataFrame:
    """One row per reported listing start: the record's own and its history's.

    A record without any usable start still gives one row with a null
    ``listed``, because its address takes part in naming the listing.
    """
    own = F.array(F.struct("listedDate", "removedDate", "price"))
    past = F.transform(
        F.map_values(F.coalesce("history", F.create_map().cast(identified.schema["history"].dataType))),
        lambda e: F.struct(e["listedDate"].alias("listedDate"), e["removedDate"].alias("removedDate"), e["price"].alias("price")),
    )
    starts = identified.select(
        "pull_ref", "id", "own_key", *_OBSERVED, F.explode(F.concat(own, past)).alias("e")
    )
    dated = starts.select(
        "pull_ref",
        "id",
        "own_key",
        calendar_date(F.col("e.listedDate")).alias("listed"),
        calendar_date(F.col("e.removedDate")).alias("removed"),
        F.coalesce("e.price", F.lit(0.0)).alias("price"),
        *_OBSERVED,
        (F.coalesce("e.listedDate", F.lit("")) != "").alias("_says_listed"),
        (F.coalesce("e.removedDate", F.lit("")) != "").alias("_says_removed"),
    )
    # stated but unreadable: such a report is no spell, rather than an open one
    unreadable = (F.col("_says_listed") & F.col("listed").isNull()) | (
        F.col("_says_removed") & F.col("removed").isNull()
    )
    return (
        dated.withColumn("bad_date", unreadable)
        .withColumn("listed", F.when(~F.col("bad_date"), F.col("listed")))
        .drop("_says_listed", "_says_removed")
    )


def _best_observation() -> Column:
    """Order of observations of one start; the greatest is kept.

    A known removal beats none, a later removal an earlier one, then more
    reported attributes, then the price; the rest only makes it total.
    """
    reported = sum(F.col(c).isNotNull().cast("int") for c in ("unit", "baths", "sqft"))
    return F.struct(
        F.col("removed").isNotNull().alias("known"),
        "removed",
        reported.alias("reported"),
        "price",
        *_OBSERVED,
    )


def collapse(observed: DataFrame) -> DataFrame:
    """One spell per unit and listing start, keyed by ``group_key``.

    All copies of one listing id belong to the unit with the smallest key that
    any copy states. A record without an id stands for itself.
    """
    copy = F.when(F.col("id").isNull(), F.col("own_key"))
    per_copy = (
        observed.withColumn("_anonymous", copy)
        # what tells rows apart fastest comes first: these groups are sorted
        .groupBy("id", "listed", "pull_ref", "_anonymous")
        .agg(F.max(_best_observation()).alias("best"), F.min("own_key").alias("own_key"))
    )
    # at most one row per day and listing is left in each of these partitions
    copies = Window.partitionBy("id", "pull_ref", "_anonymous")
    return (
        per_copy.withColumn("group_key", F.min("own_key").over(copies))
        .where(F.col("listed").isNotNull())
        .groupBy("group_key", "listed", "pull_ref")
        .agg(F.max("best").alias("best"))
        .select("pull_ref", "group_key", "listed", "best.removed", "best.price", *[f"best.{c}" for c in _OBSERVED])
    )


def stitch(spells: DataFrame, gap_days: int | Column, keys: list[str] = UNIT) -> DataFrame:
    """Number the chains of spells that form one continuous vacancy.

    Adds ``chain`` (1, 2, ... within the unit), ``off_market`` (days between the
    chain's latest removal and this start, never negative, null where the chain
    before is open or there is none) and ``starts_chain``.
    """
    unit = Window.partitionBy(*keys).orderBy("listed")
    earlier = unit.rowsBetween(Window.unboundedPreceding, -1)
    still_open = F.sum(F.when(F.col("removed").isNull(), 1).otherwise(0))
    # An open spell ends its chain. Rows after it form a new stretch, and a
    # removal seen in an older stretch says nothing about the new one: comparing
    # (stretch, removed) pairs keeps the latest removal of the newest stretch.
    latest = F.max(F.struct("_stretch", "removed")).over(earlier)
    off = F.greatest(F.lit(0), F.datediff("listed", "_latest.removed"))
    return (
        spells.withColumn("_stretch", F.coalesce(still_open.over(earlier), F.lit(0)))
        .withColumn("_latest", latest)
        .withColumn(
            "off_market",
            F.when((F.col("_latest._stretch") == F.col("_stretch")) & F.col("_latest.removed").isNotNull(), off),
        )
        .withColumn("starts_chain", F.coalesce(F.col("off_market") >= gap_days, F.lit(True)))
        .withColumn(
            "chain",
            F.sum(F.col("starts_chain").cast("int")).over(unit.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("_stretch", "_latest")
    )


def fold_chains(stitched: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """One row per chain with its dates, price history and described unit.

    Each described field comes from the latest spell that reports a usable
    value; coordinates are taken as a pair; bedrooms from the last spell.

    The rows of a unit already lie together, so they are merged where they are.
    A chain holds at most one spell per day, which bounds the list of its cuts.
    """
    unit = Window.partitionBy(*keys).orderBy("listed")
    cut = F.when(
        ~F.col("starts_chain") & (F.col("price") < F.col("_previous_price")),
        F.struct(
            F.col("listed").alias("on"),
            F.col("_previous_price").alias("from_price"),
            F.col("price").alias("to_price"),
        ),
    )

    def latest(value: Column, usable: Column = F.lit(True)) -> Column:
        return F.max_by(value, F.when(usable, F.col("listed")))

    address, point = F.col("address"), F.struct("lat", "lng")
    merged = (
        stitched.withColumn("_previous_price", F.lag("price").over(unit))
        .groupBy(*keys, "chain")
        .agg(
            F.min("listed").alias("first_listed"),
            F.when(~F.bool_or(F.col("removed").isNull()), F.max("removed")).alias("chain_end"),
            F.max(F.when(F.col("starts_chain"), F.col("price"))).alias("initial_ask"),
            (F.count(F.lit(1)) - 1).cast("int").alias("relist_count"),
            F.coalesce(F.sum(F.when(~F.col("starts_chain"), F.col("off_market"))), F.lit(0)).cast("int").alias("gap_days"),
            F.array_sort(F.collect_list(cut)).alias("cut_history"),
            F.coalesce(latest(address, has_text(address)), latest(address)).alias("address"),
            latest(F.col("unit"), has_text(F.col("unit"))).alias("unit"),
            latest(F.col("beds")).alias("beds"),
            latest(F.col("baths"), F.col("baths").isNotNull()).alias("baths"),
            latest(F.col("sqft"), F.col("sqft") > 0).alias("sqft"),
            F.coalesce(latest(point, (F.col("lat") != 0) & (F.col("lng") != 0)), latest(point)).alias("_point"),
        )
    )
    return merged.select("*", "_point.lat", "_point.lng").drop("_point")


def flag_withdrawals(chains: DataFrame, months: int, keys: list[str] = UNIT) -> DataFrame:
    """Flag a closed chain whose unit came back 42 days to ``months`` later.

    Runs before the season filter: the returning chain may lie outside it.
    """
    # chains are numbered by their start
    unit = Window.partitionBy(*keys).orderBy("chain")
    gap = F.datediff(F.lead("first_listed").over(unit), F.col("chain_end"))
    suspect = (gap >= WITHDRAWAL_FLOOR_DAYS) & (gap < months * DAYS_PER_MONTH)
    return chains.withColumn("withdrawal_suspect", F.coalesce(suspect, F.lit(False)))


def removal_class(chain_end: Column, as_of: Column, provisional_days: int) -> Column:
    since = F.datediff(as_of, chain_end)
    return (
        F.when(chain_end.isNull(), F.lit(None).cast("string"))
        .when(since < provisional_days, "pending")
        .when(since < CONFIRMED_DAYS, "provisional")
        .otherwise("confirmed")
    )


def price_per_sqft(price: Column, sqft: Column) -> Column:
    return F.when(sqft > 0, price / sqft)


def classify(
    chains: DataFrame, pulls: DataFrame, knobs: Knobs, counts: DataFrame | None = None
) -> DataFrame:
    """Vacancy length, censoring, removal class, cohort and season per chain.

    ``pulls`` has ``pull_ref, as_of, window_start, window_end``; the date of
    observation is data and never the clock. ``counts`` (``pull_ref, rows``)
    tells how the chains spread over the pulls, where that is known cheaply.
    """
    end = F.col("chain_end")
    seasons = pulls.select(
        "pull_ref",
        "as_of",
        month_day(F.col("window_start")).alias("_opens"),
        month_day(F.col("window_end")).alias("_closes"),
    )
    return (
        spread_join(chains, seasons, ["pull_ref"], by=["group_key"], counts=counts)
        .withColumn("effective_dom", F.datediff(F.coalesce(end, F.col("as_of")), F.col("first_listed")))
        .withColumn("censored", end.isNull())
        .withColumn("removal_class", removal_class(end, F.col("as_of"), knobs.provisional_lease_days))
        .withColumn("cohort_year", F.year("first_listed"))
        .withColumn("psf", price_per_sqft(F.col("initial_ask"), F.col("sqft")))
        .withColumn("in_window", in_season(F.col("first_listed"), F.col("_opens"), F.col("_closes")))
        .drop("_opens", "_closes")
    )


def with_final_keys(comps: DataFrame) -> DataFrame:
    """Add ``comp_key``, unique within a pull.

    The address key, then the start date only where the address key repeats,
    then a number only where that repeats too. A unit starts at most one chain
    a day, which bounds the partitions.
    """
    same = Window.partitionBy("pull_ref", "_base")
    twin = Window.partitionBy("pull_ref", "_base", "first_listed").orderBy("group_key")
    start = F.coalesce(F.date_format("first_listed", "yyyy-MM-dd"), F.lit("unknown-start"))
    dated = F.when(F.col("_n") > 1, F.concat("_base", F.lit(SEPARATOR), start)).otherwise(F.col("_base"))
    ordinal = F.when(F.col("_twin") > 1, F.concat(F.lit(SEPARATOR), F.col("_twin").cast("string"))).otherwise(F.lit(""))
    return (
        with_comp_key(comps, "address", "unit", "_base")
        # stated, as rows that arrive grouped by pull alone would stay so
        .repartition("pull_ref", "_base")
        .withColumn("_n", F.count(F.lit(1)).over(same))
        .withColumn("_twin", F.row_number().over(twin))
        .withColumn("comp_key", F.concat(dated, ordinal))
        .drop("_base", "_n", "_twin")
    )


def removed_on(first_listed: Column, effective_dom: Column, removal: Column) -> Column:
    return F.when(removal.isNotNull(), F.date_add(first_listed, effective_dom))


def with_row_dates(comps: DataFrame) -> DataFrame:
    """Add ``removed_on``, ``days_since_removal`` and ``cuts`` with day offsets."""
    gone = removed_on(F.col("first_listed"), F.col("effective_dom"), F.col("removal_class"))
    return (
        comps.withColumn("removed_on", gone)
        .withColumn("days_since_removal", F.datediff("as_of", "removed_on"))
        .withColumn(
            "cuts",
            F.transform(
                "cut_history",
                lambda c: F.struct(
                    c["on"].alias("on"),
                    c["from_price"].alias("from_price"),
                    c["to_price"].alias("to_price"),
                    F.datediff(c["on"], F.col("first_listed")).alias("day_offset"),
                ),
            ),
        )
    )


@dataclass(frozen=True)
class Shaped:
    """The results of shaping; lazy, but for what ``keep`` wrote.

    ``comps`` are in the reference order when sorted by ``group_key`` and
    ``first_listed`` within a pull; no row number is computed, as it would pull
    every comp of a pull through one task. ``rejected`` has a row with its
    reason for everything that was left out, ``quarantine`` counts them.
    """

    chains: DataFrame
    comps: DataFrame
    summary: DataFrame
    rejected: DataFrame

    @property
    def quarantine(self) -> DataFrame:
        return self.rejected.groupBy("pull_ref", "reason").agg(F.count(F.lit(1)).alias("n")).select("pull_ref", "n", "reason")


def shape(
    records: DataFrame, pulls: DataFrame, knobs: Knobs = Knobs(), keep: Callable[[DataFrame, str], DataFrame] | None = None
) -> Shaped:
    """Shape raw listing records of many pulls into comps.

    With ``keep`` (such as ``session.staged``) the judged chains are written
    once, and comps, summary and the chains left out are read from them; without
    it each result that is used shapes the records for itself. The spells are
    written on the way, so that the shuffles before them need not stay on disk
    with those after.
    """
    # records without any address would all fall into one unit
    nameless = ~names_something(_stated_address()) & ~names_something(F.col("addressLine2"))
    observed = observations(with_identity(records.where(~nameless)))
    spells = collapse(observed) if keep is None else keep(collapse(observed), "spells")
    folded = fold_chains(stitch(spells, knobs.stitch_gap_days))
    counts = records.groupBy("pull_ref").agg(F.count(F.lit(1)).alias("rows"))
    judged = classify(flag_withdrawals(folded, knobs.withdrawal_suspect_months), pulls, knobs, counts)
    chains = judged if keep is None else keep(judged, "judged-chains")
    discard(spells)
    sound = chains.where(F.col("effective_dom") >= 0)
    comps = with_final_keys(sound.where("in_window").drop("in_window"))

    def left_out(frame: DataFrame, id: str | None, unit: str | None, started: Column, reason: str) -> DataFrame:
        name = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
        return frame.select("pull_ref", name(id).alias("id"), name(unit).alias("unit_key"), started.alias("started"), F.lit(reason).alias("reason"))

    rejected = (
        left_out(records.where(nameless), "id", None, calendar_date(F.col("listedDate")), "no address")
        .unionByName(left_out(observed.where("bad_date"), "id", "own_key", F.lit(None).cast("date"), "unreadable date"))
        .unionByName(left_out(chains.where(F.col("effective_dom") < 0), None, "group_key", F.col("first_listed"), "removed before listed"))
    )
    return Shaped(chains=sound, comps=comps, summary=shaping_summary(sound), rejected=rejected)


def shaping_summary(chains: DataFrame) -> DataFrame:
    """Chains (not records) kept and dropped by the season window, per pull."""
    return chains.groupBy("pull_ref").agg(
        F.count_if("in_window").alias("kept"),
        F.count_if(~F.col("in_window")).alias("dropped_outside_window"),
    )


def with_sequence(comps: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """Add ``comp_seq``, the comp's place in its pull's fixed order.

    A pull may be too large to number in one task. The comps are sorted into
    ranges of about equal size, whatever their keys look like, and written; the
    sizes of a pull's earlier ranges are where a range starts to count.
    """
    order = ["pull_ref", "group_key", "first_listed"]
    ranges = keep(comps.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered-comps")
    earlier = Window.partitionBy("pull_ref").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("pull_ref", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("pull_ref", "_range").orderBy("group_key", "first_listed")
    return (
        ranges.join(offsets, ["pull_ref", "_range"])
        .withColumn("comp_seq", F.col("_before") + F.row_number().over(inside))
        .drop("_range", "_before")
    )
