"""Listing selection against every pair, also around poles and the date line."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from leasegrain.functions.geo import cell_column, cell_number, cell_row
from leasegrain.operators import planning


def miles(a, b, c, d):
    p, q, x = math.radians(a), math.radians(c), math.radians(d - b) / 2
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(x) ** 2
    return 2 * 3958.7613 * math.asin(math.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(5)
    centers = [(41.8, -87.7), (0.0, 179.99), (0.0, -179.995), (89.9, 10.0), (-89.95, -120.0), (60.0, 0.0), (90.0, 0.0)]
    searches = [(7 * k + j, *center, radius) for k, center in enumerate(centers) for j, radius in enumerate([0.1, 0.5, 1.0, 4.0, 12.0, 30.0, 100.0])]
    points = []
    for lat, lng in centers:
        for _ in range(300):
            reach = 10 ** r.uniform(-4, 0.3)
            y = max(-90.0, min(90.0, lat + r.uniform(-reach, reach)))
            x = (lng + r.uniform(-reach, reach) / max(0.003, math.cos(math.radians(y))) + 180) % 360 - 180
            points.append((y, x))
    points += points[:200] + [(41.8, -87.7)] * 50
    return searches, points


def test_circles_find_what_lies_in_them(spark, world):
    searches, points = world
    listings = spark.createDataFrame([(k, *p, 2.0, 1.0, "Condo", "Active", date(2024, 1, 1)) for k, p in enumerate(points)] + [(-1, None, 1.0, 2.0, 1.0, "Condo", "Active", date(2024, 1, 1))], "listing_id long, lat double, lng double, beds double, baths double, property_type string, status string, listed date")
    asked = spark.createDataFrame(searches, "search_id long, center_lat double, center_lng double, radius double").select(
        "*", F.array(F.lit("Condo")).alias("property_types"), F.lit(date(2024, 2, 1)).alias("today"),
        *[F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")).alias(c) for c in ("bed", "bath")],
    )
    windows = asked.select("search_id", F.lit("Active").alias("status"), F.lit(2024).alias("year"), F.lit(1).alias("days_old_min"), F.lit(90).alias("days_old_max"), F.lit(True).alias("fetchable"))
    found = planning.select_listings(asked, windows, listings)
    want = {(s, k) for s, y, x, radius in searches for k, (a, b) in enumerate(points) if miles(y, x, a, b) <= radius}
    rows = [(r.search_id, r.listing_id) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # one row per listing reaches the join
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") <= 1


def test_cell_numbers_start_with_their_larger_cells(spark, world):
    points = world[1]
    df = spark.createDataFrame([p for p in points], "lat double, lng double")
    rows = df.select("lat", "lng", cell_number(cell_row(F.col("lat")), cell_column(F.col("lng"))).alias("n")).collect()
    for r in rows[:500]:
        y, x = min(65535, math.floor((r.lat + 90) / 180 * 65536)), math.floor((r.lng + 180) / 360 * 65536) % 65536
        assert r.n == sum((y >> b & 1) << (2 * b + 1) | (x >> b & 1) << (2 * b) for b in range(16))
