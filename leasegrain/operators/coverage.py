"""What a pull holds, what it lacks, and what completing it would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.config import MONTHLY_CALLS
from leasegrain.functions.dates import calendar_date

UNREADABLE = "the stored response cannot be read as listings; fetching it again returns the same bytes"
GONE = "the response that answered this window is no longer stored"
NOT_FETCHED = "not fetched"


def stored_index(responses: DataFrame) -> DataFrame:
    """Per pull and window: is any response filed, and is any usable."""
    return responses.groupBy("pull_ref", "sig").agg(
        F.lit(True).alias("filed"), F.bool_or("usable").alias("held")
    )


def _with_store(windows: DataFrame, stored: DataFrame) -> DataFrame:
    return (
        windows.join(stored.select("pull_ref", "sig", "filed", "held"), ["pull_ref", "sig"], "left")
        .fillna(False, subset=["filed", "held"])
    )


def corroborate(recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """Recorded windows, judged by what is stored.

    Storage only ever demotes here: a window claimed as satisfied without a
    usable response is missing. It is owed if the response is gone, and not
    owed if it is there but unreadable. A recorded failure stands.
    """
    return _with_store(recorded, stored).select(
        "pull_ref", "sig", "label", *_judged(F.col("satisfied"), F.col("owed"), F.col("error"))
    )


def _judged(satisfied: Column, owed: Column, error: Column) -> list[Column]:
    claimed_only = satisfied & ~F.col("held")
    return [
        (satisfied & F.col("held")).alias("satisfied"),
        F.when(claimed_only, ~F.col("filed")).otherwise(F.coalesce(owed, ~satisfied)).alias("owed"),
        F.when(claimed_only & F.col("filed"), UNREADABLE)
        .when(claimed_only, GONE)
        .otherwise(error)
        .alias("error"),
    ]


def reconcile(planned: DataFrame, recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """Every fetchable planned window with its state.

    A window that nothing records is satisfied if a usable response is stored
    for it, else it has not been fetched.
    """
    notes = recorded.select(
        "pull_ref",
        "sig",
        F.lit(True).alias("_recorded"),
        F.col("satisfied").alias("_satisfied"),
        F.col("owed").alias("_owed"),
        F.col("error").alias("_error"),
    )
    merged = _with_store(planned.select("pull_ref", "sig", "label").join(notes, ["pull_ref", "sig"], "left"), stored)
    known = F.coalesce("_recorded", F.lit(False))
    satisfied, owed, error = _judged(F.col("_satisfied"), F.col("_owed"), F.col("_error"))
    return merged.select(
        "pull_ref",
        "sig",
        "label",
        F.when(known, satisfied).otherwise(F.col("held")).alias("satisfied"),
        F.when(known, owed).otherwise(~F.col("held")).alias("owed"),
        F.when(known, error).when(~F.col("held"), NOT_FETCHED).alias("error"),
    )


def pull_gaps(windows: DataFrame) -> DataFrame:
    """Per pull: missing windows (a pull has at most ten), calls owed, complete."""
    return (
        windows.groupBy("pull_ref")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("satisfied"), F.col("label")))).alias("missing"),
            F.count_if("owed").alias("calls_to_complete"),
        )
        .withColumn("complete", F.size("missing") == 0)
    )


def partial_pulls(gaps: DataFrame) -> DataFrame:
    """Pulls whose numbers must be shown with their gap."""
    return gaps.where(~F.col("complete")).select("pull_ref", "missing", "calls_to_complete")


def observation_dates(pulls: DataFrame, manifests: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``as_of`` per pull of ``pulls(pull_ref, today)``, never after today.

    The manifest's date, or else the latest date any response was filed with.
    """
    filed = sidecars.groupBy("pull_ref").agg(
        F.max(F.coalesce(calendar_date(F.col("as_of")), calendar_date(F.col("fetched_at")))).alias("_filed")
    )
    return (
        pulls.join(manifests.select("pull_ref", F.col("as_of").alias("_noted")), "pull_ref", "left")
        .join(filed, "pull_ref", "left")
        .select(
            "pull_ref",
            F.least(F.col("today"), F.coalesce("_noted", "_filed", "today")).alias("as_of"),
        )
    )


def truncation(pages: DataFrame) -> DataFrame:
    """Per pull and window: records that arrived against the announced total.

    ``pages`` has ``pull_ref, sig, n_records, total_count``. Without a total
    the pages that arrived are the whole answer.
    """
    total = F.col("total_count")
    return (
        pages.groupBy("pull_ref", "sig")
        .agg(F.sum("n_records").alias("fetched"), F.max("total_count").alias("total_count"))
        .withColumn("complete", F.coalesce(F.col("fetched") >= total, F.lit(True)))
        .withColumn("missing_records", F.coalesce(F.greatest(F.lit(0), total - F.col("fetched")), F.lit(0)))
    )


def cache_status(searches: DataFrame, gaps: DataFrame) -> DataFrame:
    """``hit``, ``stale`` or ``miss`` for each search's ``pull_ref``."""
    status = F.when(F.col("complete"), "hit").when(F.col("complete").isNotNull(), "stale").otherwise("miss")
    return searches.join(gaps.select("pull_ref", "complete"), "pull_ref", "left").withColumn("cache_status", status).drop("complete")


def monthly_calls(calls: DataFrame) -> DataFrame:
    """Calls and the allowance left per account and month."""
    return (
        calls.groupBy("account", F.date_format("called_on", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(MONTHLY_CALLS) - F.col("calls")))
    )


def affordable(gaps: DataFrame, budgets: DataFrame) -> DataFrame:
    """Whether the month can pay for what each pull still owes.

    ``gaps`` carries ``account`` and ``month``; an account without calls has
    the whole allowance.
    """
    left = F.coalesce("remaining", F.lit(MONTHLY_CALLS))
    return (
        gaps.join(budgets.select("account", "month", "remaining"), ["account", "month"], "left")
        .withColumn("remaining", left)
        .withColumn("refused", F.col("calls_to_complete") > F.col("remaining"))
    )


def hash_sums(digest: Column) -> Column:
    """The count and four sums over a group's hex digests, as one text.

    Whatever the order of the rows, and merged before the shuffle.
    """

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")

    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(16), part(31), part(46))


def evidence_digests(responses: DataFrame, manifests: DataFrame) -> DataFrame:
    """A digest per pull of everything its comps are shaped from.

    Sums of per-file digests, so a pull of any number of files is never gathered
    in one place.
    """
    file = F.sha2(F.concat_ws(":", "file_name", F.sha2("body", 256)), 256)
    files = responses.groupBy("pull_ref").agg(hash_sums(file).alias("_files"))
    noted = manifests.select(
        "pull_ref", F.concat_ws(":", F.col("as_of").cast("string"), "window_start", "window_end").alias("_noted")
    )
    return files.join(noted, "pull_ref", "full").select(
        "pull_ref", F.sha2(F.concat_ws("|", F.coalesce("_noted", F.lit("-")), F.coalesce("_files", F.lit("-"))), 256).alias("digest")
    )


def changed_pulls(now: DataFrame, shaped: DataFrame) -> DataFrame:
    """Pulls to shape again: new, or with another digest than when shaped."""
    before = shaped.select("pull_ref", F.col("digest").alias("_before"))
    return (
        now.join(before, "pull_ref", "left")
        .where(~F.col("digest").eqNullSafe(F.col("_before")))
        .drop("_before")
    )


def recents(workspaces: DataFrame, manifests: DataFrame, responses: DataFrame) -> DataFrame:
    """Latest workspaces with the reason why one cannot be opened.

    ``workspaces`` has one row per key with ``pull_ref`` and ``error``. A pull
    is evidence if it has a manifest and at least one stored response.
    """
    held = manifests.select("pull_ref").join(
        responses.select("pull_ref").distinct(), "pull_ref", "left_semi"
    ).withColumn("_held", F.lit(True))
    lost = F.when(F.col("_held").isNull(), "evidence missing")
    return (
        workspaces.join(held, "pull_ref", "left")
        .withColumn("error", F.coalesce("error", lost))
        .withColumn("offer_refresh", F.col("error").isNotNull())
        .drop("_held")
    )


def empty_results(summary: DataFrame, gaps: DataFrame, searches: DataFrame) -> DataFrame:
    """Which constraint left a pull without comps, and how to widen it.

    ``searches`` has ``pull_ref, radius, years_back``.
    """
    constraint = (
        F.when(F.col("kept") > 0, F.lit(None).cast("string"))
        .when(F.col("dropped_outside_window") > 0, "date window")
        .otherwise("radius, beds or types")
    )
    return (
        searches.join(summary, "pull_ref", "left")
        .join(gaps.select("pull_ref", "complete"), "pull_ref", "left")
        .fillna(0, subset=["kept", "dropped_outside_window"])
        .select(
            "pull_ref",
            "kept",
            "dropped_outside_window",
            constraint.alias("constraint"),
            F.coalesce(~F.col("complete"), F.lit(False)).alias("has_gap"),
            F.least(F.lit(100.0), F.round(F.col("radius") * 2, 2)).alias("wider_radius"),
            F.least(F.lit(5), F.col("years_back") + 1).alias("more_years"),
        )
    )
