import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leasegrain.config import Knobs
from leasegrain.functions.address import with_comp_key
from leasegrain.operators.shaping import shape, stitch, with_final_keys, with_row_dates, with_sequence
from leasegrain.schemas import LISTING
from tests import plain

AS_OF = date(2026, 7, 27)


def listing(id="a", line="1 Elm St", unit=None, **fields):
    row = dict.fromkeys(LISTING.names)
    row.update(
        id=id, addressLine1=line, addressLine2=unit, latitude=41.8, longitude=-87.7, bedrooms=2.0, bathrooms=1.0,
        squareFootage=800.0, price=1600.0, listedDate="2025-06-01T00:00:00.000Z",
    )
    row.update(fields)
    return row


def past(price, listed, removed):
    return {"event": "Rental Listing", "price": price, "listingType": None, "listedDate": listed, "removedDate": removed, "daysOnMarket": None}


def shaped(spark, rows, window=("01-01", "12-31"), knobs=Knobs(), as_of=AS_OF):
    records = spark.createDataFrame([tuple(r[n] for n in LISTING.names) for r in rows], LISTING).withColumn("pull_ref", F.lit("p"))
    pulls = spark.createDataFrame([("p", as_of, *window)], "pull_ref string, as_of date, window_start string, window_end string")
    return shape(records, pulls, knobs)


def comps(spark, rows, **options):
    return shaped(spark, rows, **options).comps.orderBy("group_key", "first_listed").collect()


@pytest.mark.parametrize(
    "one, two",
    [
        (("218 West Linden Street", "Unit 3"), ("218 W Linden St.", "#3")),
        (("218  w. linden\tst", "apartment 3"), ("218 W Linden St", "3")),
        (("12 E Avenue", "# 4B"), ("12 east ave", "Apt 4b")),
        (("9 Straße", None), ("9 STRASSE", "")),
    ],
)
def test_spellings_of_one_unit_share_a_key(spark, one, two):
    df = spark.createDataFrame([one, two], "address string, unit string")
    assert with_comp_key(df, "address", "unit", "k").select("k").distinct().count() == 1


@pytest.mark.parametrize(
    "address, unit, key",
    [
        ("77 N St Charles Ave", None, "77 n st charles ave|"),
        ("5 Oak", "Units 3-4", "5 oak|units 3-4"),
        ("1 Elm", "Unit", "1 elm|unit"),
        ("1 Elm", "Unit #", "1 elm|unit #"),
        ("1 Elm", "##3", "1 elm|3"),
        ("1 Elm", "# # 4", "1 elm|4"),
        ("1 Elm", " ., ", "1 elm|"),
        (None, None, "|"),
    ],
)
def test_key_of(spark, address, unit, key):
    df = spark.createDataFrame([(address, unit)], "address string, unit string")
    assert with_comp_key(df, "address", "unit", "k").first().k == key


@pytest.mark.parametrize("gap_days", [0, 7, 42])
def test_stitching_agrees_with_a_sequential_fold(spark, gap_days):
    rng = random.Random(gap_days)
    rows, expected = [], {}
    for unit in range(400):
        starts = sorted({date(2024, 1, 1) + timedelta(days=rng.randint(0, 300)) for _ in range(rng.randint(1, 7))})
        spells = [
            (s, None if rng.random() < 0.2 else s + timedelta(days=rng.randint(-5, 120))) for s in starts
        ]
        rows += [("p", str(unit), s, e, 1.0) for s, e in spells]
        expected[str(unit)] = [len(c) for c in plain.chains_of(spells, gap_days)]
    df = spark.createDataFrame(rows, "pull_ref string, group_key string, listed date, removed date, price double")
    counts = stitch(df, gap_days).groupBy("group_key", "chain").count().orderBy("group_key", "chain").collect()
    found: dict[str, list[int]] = {}
    for r in counts:
        found.setdefault(r.group_key, []).append(r["count"])
    assert found == expected


def test_an_open_spell_hides_older_removals_from_the_next_chain(spark):
    rows = [
        ("p", "u", date(2024, 1, 1), date(2024, 12, 31), 1.0),
        ("p", "u", date(2024, 2, 1), None, 1.0),
        ("p", "u", date(2024, 3, 1), date(2024, 3, 5), 1.0),
    ]
    df = spark.createDataFrame(rows, "pull_ref string, group_key string, listed date, removed date, price double")
    assert [r.chain for r in stitch(df, 42).orderBy("listed").collect()] == [1, 1, 2]


def test_history_gives_one_spell_per_start_and_cuts(spark):
    history = {
        "2025-06-01": past(1700.0, "2025-06-01", "2025-07-10"),
        "2025-07-20": past(1600.0, "2025-07-20", "2025-08-01"),
    }
    row = listing(listedDate="2025-07-20T00:00:00.000Z", removedDate="2025-08-01T00:00:00.000Z", price=1600.0, history=history)
    (comp,) = comps(spark, [row])
    assert (comp.initial_ask, comp.relist_count, comp.gap_days, comp.effective_dom) == (1700.0, 1, 10, 61)
    assert [(c.on, c.from_price, c.to_price) for c in comp.cut_history] == [(date(2025, 7, 20), 1700.0, 1600.0)]
    dated = with_row_dates(shaped(spark, [row]).comps).first()
    assert (dated.removed_on, dated.days_since_removal, dated.cuts[0].day_offset) == (date(2025, 8, 1), 360, 49)


@pytest.mark.parametrize("gap, chains", [(41, 1), (42, 2)])
def test_a_gap_at_the_threshold_splits(spark, gap, chains):
    back = date(2025, 3, 1) + timedelta(days=gap)
    history = {"a": past(1.0, "2025-02-01", "2025-03-01"), "b": past(1.0, back.isoformat(), None)}
    assert len(comps(spark, [listing(listedDate=None, history=history)])) == chains


def test_overlapping_spells_end_with_the_latest_removal(spark):
    history = {"a": past(9.0, "2025-01-01", "2025-05-01"), "b": past(9.0, "2025-02-01", "2025-02-10")}
    (comp,) = comps(spark, [listing(listedDate=None, history=history)])
    assert (comp.effective_dom, comp.gap_days, comp.relist_count) == (120, 0, 1)


def test_copies_of_one_id_are_one_unit_and_a_removal_wins(spark):
    rows = [
        listing(line="2 Oak Street", removedDate=None, squareFootage=None),
        listing(line="1 Oak St", removedDate="2025-07-01T00:00:00.000Z"),
    ]
    for order in (rows, rows[::-1]):
        (comp,) = comps(spark, order)
        assert (comp.group_key, comp.censored, comp.effective_dom, comp.sqft) == ("1 oak st|", False, 30, 800.0)


def test_records_without_an_id_stand_alone(spark):
    rows = [listing(id=None, line="1 A St"), listing(id=None, line="2 A St")]
    assert [c.group_key for c in comps(spark, rows)] == ["1 a st|", "2 a st|"]


@pytest.mark.parametrize(
    "days, rung", [(-3, "pending"), (0, "pending"), (6, "pending"), (7, "provisional"), (41, "provisional"), (42, "confirmed")]
)
def test_removal_ladder(spark, days, rung):
    removed = AS_OF - timedelta(days=days)
    (comp,) = comps(spark, [listing(removedDate=removed.isoformat())])
    assert comp.removal_class == rung


@pytest.mark.parametrize("gap, suspect", [(41, None), (42, True), (179, True), (180, False)])
def test_withdrawal_suspect_bounds(spark, gap, suspect):
    back = date(2025, 3, 1) + timedelta(days=gap)
    history = {"a": past(1.0, "2025-02-01", "2025-03-01"), "b": past(1.0, back.isoformat(), None)}
    found = comps(spark, [listing(listedDate=None, history=history)])
    if suspect is None:
        assert len(found) == 1
    else:
        assert [c.withdrawal_suspect for c in found] == [suspect, False]


def test_suspicion_looks_past_the_season_window(spark):
    history = {"a": past(1.0, "2025-06-05", "2025-07-01"), "b": past(1.0, "2025-09-01", None)}
    result = shaped(spark, [listing(listedDate=None, history=history)], window=("06-01", "06-16"))
    (comp,) = result.comps.collect()
    assert comp.withdrawal_suspect
    summary = result.summary.first()
    assert (summary.kept, summary.dropped_outside_window) == (1, 1)


@pytest.mark.parametrize(
    "day, window, kept",
    [
        ("2025-06-01", ("06-01", "06-16"), True),
        ("2025-06-17", ("06-01", "06-16"), False),
        ("2025-12-31", ("11-15", "02-15"), True),
        ("2025-02-15", ("11-15", "02-15"), True),
        ("2025-02-16", ("11-15", "02-15"), False),
    ],
)
def test_season_window(spark, day, window, kept):
    assert len(comps(spark, [listing(listedDate=day)], window=window)) == int(kept)


def test_identity_is_the_latest_usable_value_per_field(spark):
    rows = [
        listing(id="a", listedDate="2025-01-01", removedDate="2025-02-01", squareFootage=700.0, bathrooms=None, unit="Unit 3", bedrooms=1.0),
        listing(id="b", listedDate="2025-02-05", removedDate="2025-03-01", squareFootage=0.0, bathrooms=2.5, unit="3", latitude=None, bedrooms=0.0),
    ]
    (comp,) = comps(spark, rows)
    assert (comp.sqft, comp.baths, comp.unit, comp.lat, comp.lng, comp.beds) == (700.0, 2.5, "3", 41.8, -87.7, 0.0)
    assert comp.psf == comp.initial_ask / 700.0


def test_dates_are_those_the_string_states(spark):
    (comp,) = comps(spark, [listing(listedDate="2025-06-02T23:30:00-05:00")])
    assert comp.first_listed == date(2025, 6, 2)


def test_quarantine_counts_what_shaping_leaves_out(spark):
    rows = [
        listing(id="ok"),
        listing(id="x", line=None, unit=" "),
        listing(id="y", line="5 B St", removedDate="soon"),
        listing(id="z", line="6 B St", removedDate="2025-05-01"),
    ]
    result = shaped(spark, rows)
    assert {r.reason: r.n for r in result.quarantine.collect()} == {
        "no address": 1, "unreadable date": 1, "removed before listed": 1,
    }
    assert [c.comp_key for c in result.comps.collect()] == ["1 elm st|"]


def test_final_keys_extend_only_where_they_collide(spark):
    schema = "pull_ref string, group_key string, first_listed date, address string, unit string"
    rows = [
        ("p", "g1", date(2025, 1, 1), "1 A St", None),
        ("p", "g1", date(2025, 6, 1), "1 A Street", None),
        ("p", "g2", date(2025, 6, 1), "1 a st", ""),
        ("p", "g3", None, "2 A St", "4"),
        ("q", "g1", date(2025, 1, 1), "1 A St", None),
    ]
    keys = [r.comp_key for r in with_final_keys(spark.createDataFrame(rows, schema)).orderBy("pull_ref", "group_key", "first_listed").collect()]
    assert keys == ["1 a st||2025-01-01", "1 a st||2025-06-01", "1 a st||2025-06-01|2", "2 a st|4", "1 a st|"]


def test_sequence_is_the_order_within_a_pull(spark):
    rng = random.Random(1)
    rows = [(p, f"{rng.randint(1, 400)} elm|", date(2020, 1, 1) + timedelta(days=rng.randint(0, 900))) for p in "ab" for _ in range(300)]
    df = spark.createDataFrame(sorted(set(rows)), "pull_ref string, group_key string, first_listed date")
    for pull in "ab":
        found = with_sequence(df).where(F.col("pull_ref") == pull).orderBy("group_key", "first_listed").collect()
        assert [r.comp_seq for r in found] == list(range(1, len(found) + 1))


def test_shaping_does_not_depend_on_the_order_of_records(spark):
    rng = random.Random(5)
    rows = []
    for n in range(120):
        start = date(2024, 1, 1) + timedelta(days=rng.randint(0, 700))
        end = None if rng.random() < 0.2 else (start + timedelta(days=rng.randint(1, 90))).isoformat()
        rows.append(listing(id=str(rng.randint(0, 60)), line=f"{rng.randint(1, 9)} Elm {rng.choice(['St', 'Street'])}",
                            unit=rng.choice([None, "1", "#1", "Apt 2"]), listedDate=start.isoformat(), removedDate=end,
                            price=float(rng.randint(900, 3000)), squareFootage=rng.choice([None, 0.0, 700.0])))
    once = comps(spark, rows)
    rng.shuffle(rows)
    assert comps(spark, rows) == once


def test_kept_chains_are_shaped_once(spark):
    from leasegrain.session import staged

    rows = [
        listing("1", removedDate="2025-07-01"), listing("2", "2 Elm St", removedDate="2025-05-01"),
        listing("3", None), listing("4", "4 Elm St", listedDate="soon"),
    ]
    schema = "pull_ref string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING)
    records = spark.createDataFrame([("p", *[r[c] for c in LISTING.names]) for r in rows], schema)
    pulls = spark.createDataFrame([("p", AS_OF, "01-01", "12-31")], "pull_ref string, as_of date, window_start string, window_end string")
    once = shape(records, pulls, keep=staged)
    assert {(r.id, r.unit_key, r.reason) for r in once.rejected.collect()} == {
        (None, "2 elm st|", "removed before listed"), ("3", None, "no address"), ("4", "4 elm st|", "unreadable date")
    }
    assert {(r.reason, r.n) for r in once.quarantine.collect()} == {("removed before listed", 1), ("no address", 1), ("unreadable date", 1)}
    assert once.summary.first().kept == 1 and [r.comp_key for r in once.comps.collect()] == ["1 elm st|"]
    for result in (once.comps, once.summary):
        assert "listedDate" not in result._jdf.queryExecution().optimizedPlan().toString()
