"""What grows with the pairs and the bodies: shuffles, tables on the way, and how often a value is read."""

import glob
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from leasegrain.config import Knobs
from leasegrain.operators import cohorts, curation, shaping
from leasegrain.plans.catalog import QUERIES
from leasegrain.plans.derive import SCORED_COLUMNS, score
from leasegrain.schemas import STORED_RESPONSE
from leasegrain.session import discard, staged
from leasegrain.sources import order_listings
from leasegrain.sources.responses import parse_responses
from leasegrain.streaming import incremental
from tests.test_derive import comp, frames, request

TINY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.count() == 7


def test_only_staged_tables_are_discarded(spark, tmp_path):
    table = staged(spark.range(3), "short")
    path = re.sub(r"^file:", "", table.inputFiles()[0].replace("file://", "file:"))
    discard(table)
    assert not os.path.exists(path)
    spark.range(3).write.parquet(f"{tmp_path}/t")
    own = spark.read.parquet(f"{tmp_path}/t")
    discard(own)
    assert own.count() == 3


@pytest.fixture(scope="module")
def crowd(spark):
    """More requests than a block holds, on one pull, and odd keys: repeated, null and unknown ones."""
    comps = [comp(f"c{n}", psf=None if n % 5 == 0 else 1.0 + n % 7, year=2020 + n % 3, lat=41.8 + n / 100) for n in range(12)]
    comps += [comp("c1", pull_ref="q"), comp(None, pull_ref="q"), comp("c3", pull_ref="q", year=2019)]
    requests = [request(request_id=f"r{n}", max_distance_mi=4.0 if n % 2 else None) for n in range(3 * curation.BLOCK)]
    requests += [request(request_id="r1"), request(request_id="r2", pull_ref="q"), request(request_id=None), request(request_id="lone", pull_ref=None)]
    requests += [request(request_id="empty", pull_ref="nowhere")]
    weights = [(f"r{n}", f"c{n % 12}", float(n % 3)) for n in range(150)]
    weights += [("r1", "c1", 2.0), ("r1", "c1", 3.0), ("r2", "c3", None), ("r2", "c3", None), (None, "c1", 5.0), ("r4", None, 5.0), ("?", "c1", 1.0)]
    overrides = [("r1", "c9"), ("r1", "c9"), ("r3", "c11"), (None, "c11"), ("r5", None)]
    return frames(spark, comps, requests, weights, overrides)


def test_scored_pairs_are_those_of_plain_joins(crowd):
    requests, comps, weights, overrides = crowd
    half, least = Knobs().bucket_half_width_pct, Knobs().min_cohort_size
    curated = curation.curate(curation.pair(requests, comps), weights, overrides)
    medians = cohorts.cohort_medians(curated, comps, least)
    plain = cohorts.with_premiums(curated, medians, half).join(curation.total_weights(curated), "request_id", "left")
    scored, found = score(requests, comps, weights, overrides)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(scored.select(*SCORED_COLUMNS)) == rows(plain.select(*SCORED_COLUMNS))
    assert rows(found) == rows(medians)
    shares = lambda df: rows(curation.contribution_shares(df).select("request_id", "comp_key", "contribution_share"))
    assert shares(scored) == shares(scored.drop("total_weight"))


def test_no_weight_is_lost_or_taken_negative(spark, crowd):
    requests, comps, weights, overrides = crowd
    bad = weights.unionByName(spark.createDataFrame([("r7", "c2", -1.0)], weights.schema))
    with pytest.raises(Exception, match="weights must be non-negative"):
        score(requests, comps, bad, overrides)


def test_pairs_are_not_shuffled_for_their_curation(crowd):
    plans = {}

    def keep(df, label):
        plans[label] = plan(df)
        return staged(df, label)

    score(*crowd, keep=keep)
    for label in ("curated", "scored"):
        # by request and comp, or request and cohort, every pair would move
        assert not re.search(r"hashpartitioning\([^)]*request_id#\d+, (comp_key|cohort_year)", plans[label])


def test_shaping_writes_its_spells_on_the_way(spark):
    labels = []
    shaped = shaping.shape(
        order_listings.listing_records(spark, TINY), order_listings.pulls(spark, TINY), keep=lambda df, label: labels.append(label) or staged(df, label)
    )
    assert labels == ["spells", "judged-chains"] and shaped.summary.count() > 0


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no benchmark tables here")
@pytest.mark.parametrize("name", ["breakdowns", "decision_outcomes", "decision_records"])
def test_records_are_shaped_once(spark, name):
    assert "orders.parquet" not in plan(QUERIES[name](spark, TINY))


def test_fields_of_a_body_are_read_once(spark):
    bodies = spark.createDataFrame([("p", "y2000-active-off1.json", "[]", None, None, None)], STORED_RESPONSE)
    reads = [line.count("variant_get(entry") + line.count("variant_get(lambda") for line in plan(incremental._listings(bodies)).split("\n") if "Filter" in line]
    assert sum(reads) == 0


KINDS = {
    '[{"id":"a"},7,null,{}, [1], "x"]': (True, 2), '{"listings":[{"id":1},2]}': (True, 1), '{"listings":7}': (False, 0), "[]": (True, 0),
    '{"data":[]}': (False, 0), '{"listings": [': (False, 0), "7": (False, 0), "null": (False, 0), '{"listings":null}': (False, 0),
    "[null]": (True, 0), '[[{"id":2}]]': (True, 0), '{"a":{"listings":[{"id":1}]}}': (False, 0), '{"listings":{"x":1}}': (False, 0), "": (False, 0),
}


def test_kinds_of_bodies(spark):
    parsed = parse_responses(spark.createDataFrame([(k,) for k in [*KINDS, None]], "body string")).collect()
    assert {r.body: (r.usable, r.n_records) for r in parsed} == {**KINDS, None: (False, 0)}
