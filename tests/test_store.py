import json
from datetime import date

import pytest

from leasegrain.config import KnobError, Knobs
from leasegrain.operators import coverage
from leasegrain.operators.shaping import shape
from leasegrain.plans.load import shape_store
from leasegrain.sources import bookkeeping, responses
from leasegrain.streaming import incremental


def record(id, line, **more):
    return {"id": id, "addressLine1": line, "latitude": 41.8, "longitude": -87.7, "bedrooms": 2, "bathrooms": 1,
            "squareFootage": 800, "price": 1600, "listedDate": "2025-06-02T00:00:00.000Z", "removedDate": None, **more}


def put(path, payload):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")


@pytest.fixture
def store(tmp_path):
    raw = tmp_path / "pull-a" / "raw"
    put(raw / "y2025-active-off000.json", [record("1", "1 Elm St"), 7])
    put(raw / "y2025-active-off000.meta.json", {"as_of": "2026-07-20", "total_count": 2})
    put(raw / "y2025-inactive-off000.json", {"listings": [record("1", "1 Elm Street", removedDate="2025-07-01", history={"2025-06-02": {"price": 1600, "listedDate": "2025-06-02", "removedDate": "2025-07-01"}})]})
    put(raw / "y2025-inactive-off500.json", "[]")
    put(raw / "y2024-active-off000.json", '{"data": []}')
    put(raw / "y2024-inactive-off000.json", '[{"id": "cut')
    put(tmp_path / "pull-a" / "manifest.json", {
        "as_of": "2026-07-27", "window": ["06-01", "06-16"], "planned": 4, "fetchable": 4,
        "queries": [
            {"label": "2025 Active", "sig": "y2025-active", "satisfied": True, "error": None, "owed": False},
            {"label": "2024 Active", "sig": "y2024-active", "satisfied": True, "error": None},
            {"label": "2023 Active", "sig": "y2023-active", "satisfied": True, "error": None},
            {"label": "2022 Active", "sig": "y2022-active", "satisfied": False, "error": "HTTP 429"},
        ]})
    put(tmp_path / "pull-b" / "manifest.json", "{not json")
    return str(tmp_path)


def test_a_store_is_read_parsed_and_shaped(spark, store):
    parsed = responses.parse_responses(responses.read_responses(spark, store))
    rows = {r.file_name: (r.sig, r.status, r.year, r.page_offset, r.usable, r.n_records) for r in parsed.collect()}
    assert rows["y2025-active-off000.json"] == ("y2025-active", "Active", 2025, 0, True, 1)
    assert rows["y2025-inactive-off500.json"] == ("y2025-inactive", "Inactive", 2025, 500, True, 0)
    assert {r.file_name for r in responses.unusable_responses(parsed).collect()} == {"y2024-active-off000.json", "y2024-inactive-off000.json"}
    assert len(rows) == 5
    (comp,) = shape_store(spark, store).comps.collect()
    assert (comp.pull_ref, comp.comp_key, comp.effective_dom, comp.removal_class, comp.as_of) == ("pull-a", "1 elm st|", 29, "confirmed", date(2026, 7, 27))
    assert responses.read_sidecars(spark, store).first().total_count == 2


def test_manifests_are_judged_by_what_is_stored(spark, store):
    manifests = bookkeeping.read_manifests(spark, store)
    assert [r.pull_ref for r in manifests.collect()] == ["pull-a"]
    stored = coverage.stored_index(responses.parse_responses(responses.read_responses(spark, store)))
    judged = coverage.corroborate(bookkeeping.manifest_windows(manifests), stored)
    found = {r.sig: (r.satisfied, r.owed, r.error) for r in judged.collect()}
    assert found == {
        "y2025-active": (True, False, None),
        "y2024-active": (False, False, coverage.UNREADABLE),
        "y2023-active": (False, True, coverage.GONE),
        "y2022-active": (False, True, "HTTP 429"),
    }
    gap = coverage.pull_gaps(judged).first()
    assert (gap.missing, gap.calls_to_complete, gap.complete) == (["2022 Active", "2023 Active", "2024 Active"], 2, False)


def test_manifest_tables_replace_only_their_pulls(spark, tmp_path):
    schema = "pull_ref string, as_of date, window_start string, window_end string, planned int, fetchable int"
    windows = "pull_ref string, label string, sig string, satisfied boolean, error string, owed boolean"
    out = str(tmp_path / "tables")

    def write(rows):
        bookkeeping.write_manifests(
            spark.createDataFrame([(r, date(2026, 1, d), "06-01", "06-16", 2, 2) for r, d in rows], schema),
            spark.createDataFrame([(r, "2025 Active", "y2025-active", True, None, None) for r, _ in rows], windows), out)

    write([("a", 1), ("b", 1)])
    write([("b", 9)])
    assert {(r.pull_ref, r.as_of.day) for r in spark.read.parquet(f"{out}/pull_manifest").collect()} == {("a", 1), ("b", 9)}
    assert spark.read.parquet(f"{out}/pull_windows").count() == 2


def test_empty_bodies_are_refused_and_empty_markets_kept(spark, tmp_path):
    rows = [("p", "y2025-active-off000.json", "", None, None, None), ("p", "y2025-active-off001.json", "[]", None, None, None)]
    df = spark.createDataFrame(rows, incremental.RESPONSE_COLUMNS)
    responses.append_responses(df, str(tmp_path / "raw"))
    responses.append_responses(df, str(tmp_path / "raw"))
    assert [r.body for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == ["[]", "[]"]


MANIFEST = "pull_ref string, as_of date, window_start string, window_end string"


def body(name, pull, *listings):
    return {"pull_ref": pull, "file_name": f"{name}.json", "body": json.dumps(listings)}


def test_incremental_job_shapes_only_touched_units_and_resumes(spark, tmp_path):
    manifests = spark.createDataFrame([(p, date(2026, 7, 27), "01-01", "12-31") for p in "ab"], MANIFEST)
    landing, root, state = (str(tmp_path / n) for n in ("landing", "store", "state"))
    incremental.put_manifests(spark, root, manifests, 0)

    def run(name=None, *rows):
        if name:
            put(tmp_path / "landing" / f"{name}.json", "\n".join(json.dumps(r) for r in rows))
        incremental.run_once(spark, landing, root, state).awaitTermination(180)
        return {(r.pull_ref, r.comp_key, r.censored) for r in incremental.current_comps(spark, root).collect()}

    def versions():
        rows = spark.read.parquet(f"{root}/versions").select("pull_ref", "group_key", "version").collect()
        return {(r.pull_ref, r.group_key[0], r.version) for r in rows}

    first = {("a", "1 elm st|", True), ("a", "3 elm st|", True), ("b", "2 elm st|", True)}
    assert run("1", body("y2025-active", "a", record("1", "1 Elm St"), record("3", "3 Elm St")), body("y2025-active", "b", record("2", "2 Elm St"))) == first
    second = first - {("a", "1 elm st|", True)} | {("a", "1 elm st|", False)}
    assert run("2", body("y2025-inactive", "a", record("1", "1 Elm St", removedDate="2025-07-01"))) == second
    assert versions() == {("a", "1", 0), ("a", "3", 0), ("b", "2", 0), ("a", "1", 1)}
    assert run() == second


def test_units_follow_listings_that_move_leave_and_come_back(spark, tmp_path):
    """After every batch the store gives what shaping all its current bodies gives."""
    root = str(tmp_path / "store")
    manifests = spark.createDataFrame([("a", date(2026, 7, 27), "01-01", "12-31")], MANIFEST)
    incremental.put_manifests(spark, root, manifests, 0)
    batches = [
        [body("y2025-active", "a", record("1", "5 Elm St"), record("2", "5 Elm St", listedDate="2025-03-01", removedDate="2025-03-20"), record(None, "7 Oak St"), record("9", ""))],
        # another copy moves listing 1, and with it its spells, to a smaller key
        [body("y2024-active", "a", record("1", "4 Elm St", listedDate="2024-05-01", removedDate="2024-06-01"))],
        # the first file comes again without listing 2, and a listing without id joins its unit
        [body("y2025-active", "a", record("1", "5 Elm St"), record(None, "7 Oak St", listedDate="2025-01-05", removedDate="2025-01-30"))],
        [{"pull_ref": "a", "file_name": "y2024-active.json", "body": "[]"}, {"pull_ref": "a", "file_name": "y2023-active.json", "body": ""}],
    ]
    columns = ("comp_key", "group_key", "first_listed", "chain_end", "initial_ask", "relist_count", "withdrawal_suspect")
    for number, rows in enumerate(batches):
        arrived = spark.createDataFrame([(r["pull_ref"], r["file_name"], r["body"], None, None, None) for r in rows], incremental.RESPONSE_COLUMNS)
        for _ in range(2 if number == 2 else 1):
            incremental.ingest(spark, root, arrived, number)
        whole = shape(responses.listing_records(responses.parse_responses(incremental.stored_responses(spark, root))), manifests).comps
        found = sorted(map(str, incremental.current_comps(spark, root).select(*columns).collect()))
        assert found and found == sorted(map(str, whole.select(*columns).collect()))
        if number == 1:
            incremental.compact(spark, root)
    incremental.compact(spark, root)
    assert sorted(map(str, incremental.current_comps(spark, root).select(*columns).collect())) == found
    for name in ("responses", "listings", "units", "chains", "versions"):
        (folder,) = (tmp_path / "store" / name).glob("batch=*")
        assert folder.name.startswith("batch=-")
    assert {r.file_name for r in incremental.stored_responses(spark, root).collect()} == {"y2025-active.json", "y2024-active.json"}


def test_listings_are_read_from_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [(p, "y2025-active.json", json.dumps([record(f"{p}{k}", f"{k} Elm St") for k in range(30)]), None, None, None) for p in ("a", "b", "c")]
    incremental.ingest(spark, root, spark.createDataFrame(rows, incremental.RESPONSE_COLUMNS), 0)
    one = spark.createDataFrame([("b", "id b7")], "pull_ref string, listing string")
    found = incremental.current_listings(spark, root, one)
    assert [r.own_key for r in found.collect()] == ["7 elm st|"]
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters" in s and "bucket#" in s.split("PartitionFilters")[1] for s in scans)
    assert not any("body" in s.split("ReadSchema")[1] for s in scans)
    # folders follow buckets, not pulls
    assert len(list((tmp_path / "store" / "responses").glob("batch=0/bucket=*"))) <= 3


def test_a_body_is_parsed_once(spark):
    df = spark.createDataFrame([("p", "y2025-active-off000.json", json.dumps([record("1", "1 Elm St")]))], "pull_ref string, file_name string, body string")
    records = responses.listing_records(responses.parse_responses(responses.with_file_facts(df)))
    assert records._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
    assert records.count() == 1


def test_workspaces_replace_and_bad_ones_stay_listed(spark, tmp_path):
    put(tmp_path / "k1.json", {"pull_ref": "p", "subject": {"sqft": 900.0}, "weights": {"a|": 2.0}, "saved_at": "2026-01-02T00:00:00Z"})
    put(tmp_path / "k2.json", "{broken")
    versions = bookkeeping.read_workspaces(spark, str(tmp_path))
    listed = bookkeeping.list_workspaces(bookkeeping.parse_workspaces(versions)).collect()
    assert [(r.key, r.error) for r in listed] == [("k2", "unreadable"), ("k1", None)]
    assert listed[1].state.weights == {"a|": 2.0}
    table = str(tmp_path / "versions")
    bookkeeping.save_workspaces(versions, table)
    later = versions.where("key = 'k1'").selectExpr("key", "timestamp'2027-01-01' AS saved_at", "'{}' AS document")
    bookkeeping.save_workspaces(later, table)
    assert {r.key: r.document for r in bookkeeping.latest_workspaces(spark.read.parquet(table)).collect()} == {"k1": "{}", "k2": "{broken"}


def test_call_log_months(spark, tmp_path):
    put(tmp_path / "ledger-a.json", {"month": "2026-06", "calls_this_month": 9, "history": [{"sig": "s", "params": {"radius": "2"}, "status": 200, "total_count": 39}]})
    put(tmp_path / "ledger-b.json", {"calls_this_month": 8, "history": []})
    put(tmp_path / "ledger-c.json", {"month": "2026-07", "calls_this_month": -1})
    put(tmp_path / "ledger-d.json", "nope")
    for k, bad in enumerate(([], {"calls_this_month": "8"}, {"calls_this_month": None}, {"calls_this_month": 2.5})):
        put(tmp_path / f"ledger-x{k}.json", bad)
    read = bookkeeping.read_ledgers(spark, str(tmp_path))
    spend = bookkeeping.current_spend(read, "2026-07")
    found = {r.path[-6]: (r.calls_this_month, r.error) for r in spend.collect()}
    assert found == {"a": (0, None), "b": (8, None), "c": (None, "bad call count"), "d": (None, "not JSON"), "0": (None, "not an object")} | dict.fromkeys(
        "123", (None, "bad call count")
    )
    (call,) = bookkeeping.ledger_calls(read).collect()
    assert (call.sig, call.params, call.total_count) == ("s", {"radius": "2"}, 39)


def test_knobs_are_validated_and_round_trip(spark, tmp_path):
    assert bookkeeping.load_knobs(spark, str(tmp_path / "none.json")) == Knobs()
    knobs = Knobs(knn_k=5, km_horizons_days=(7, 90))
    bookkeeping.save_knobs(spark, knobs, str(tmp_path / "knobs"))
    assert bookkeeping.load_knobs(spark, str(tmp_path / "knobs")) == knobs
    put(tmp_path / "bad.json", {"padding": 90})
    with pytest.raises(KnobError, match="unknown"):
        bookkeeping.load_knobs(spark, str(tmp_path / "bad.json"))
    for broken in ({"knn_k": 2}, {"knn_k": 7.5}, {"km_horizons_days": []}, {"km_horizons_days": [30, 14]}, {"drift_source": "Zip"}):
        with pytest.raises(KnobError):
            Knobs.from_mapping(broken)


def test_shaped_pull_documents(spark, tmp_path):
    comp = {"address": "1 Elm St", "unit": "Apt 2", "lat": 41.8, "lng": -87.7, "beds": 2.0, "initial_ask": 1600.0, "sqft": 800.0,
            "effective_dom": 12, "censored": False, "removal_class": "confirmed", "cohort_year": 2025}
    put(tmp_path / "pull.json", {"ref": "demo", "fetched_at": "2026-07-01", "note": "n", "comps": [comp, comp]})
    rows = bookkeeping.read_shaped_pulls(spark, str(tmp_path / "pull.json")).orderBy("group_key").collect()
    assert [(r.comp_key, r.psf, r.relist_count, r.cut_history) for r in rows] == [
        ("1 elm st|2|unknown-start", 2.0, 0, []), ("1 elm st|2|unknown-start|2", 2.0, 0, []),
    ]
