"""Explicit schemas; raw input is never inferred."""

from pyspark.sql import types as T

_EVENT = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("listingType", T.StringType()),
        T.StructField("listedDate", T.StringType()),
        T.StructField("removedDate", T.StringType()),
        T.StructField("daysOnMarket", T.IntegerType()),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("formattedAddress", T.StringType()),
        T.StructField("addressLine1", T.StringType()),
        T.StructField("addressLine2", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("propertyType", T.StringType()),
        T.StructField("bedrooms", T.DoubleType()),
        T.StructField("bathrooms", T.DoubleType()),
        T.StructField("squareFootage", T.DoubleType()),
        T.StructField("yearBuilt", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("listedDate", T.StringType()),
        T.StructField("removedDate", T.StringType()),
        # keyed by event date, so it must be a map: a struct would grow one field per date
        T.StructField("history", T.MapType(T.StringType(), _EVENT)),
    ]
)

CUTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("on", T.DateType()),
            T.StructField("from_price", T.DoubleType()),
            T.StructField("to_price", T.DoubleType()),
        ]
    )
)

COMP = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("beds", T.DoubleType()),
        T.StructField("baths", T.DoubleType()),
        T.StructField("sqft", T.DoubleType()),
        T.StructField("initial_ask", T.DoubleType()),
        T.StructField("effective_dom", T.IntegerType()),
        T.StructField("censored", T.BooleanType()),
        T.StructField("removal_class", T.StringType()),
        T.StructField("cohort_year", T.IntegerType()),
        T.StructField("first_listed", T.DateType()),
        T.StructField("withdrawal_suspect", T.BooleanType()),
        T.StructField("cut_history", CUTS),
        T.StructField("relist_count", T.IntegerType()),
        T.StructField("gap_days", T.IntegerType()),
    ]
)

SHAPED_PULL = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField("fetched_at", T.DateType()),
        T.StructField("note", T.StringType()),
        T.StructField("comps", T.ArrayType(COMP)),
    ]
)

SUBJECT = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("sqft", T.DoubleType()),
        T.StructField("beds", T.DoubleType()),
        T.StructField("baths", T.DoubleType()),
    ]
)

FILTERS = T.StructType(
    [
        T.StructField("max_distance_mi", T.DoubleType()),
        T.StructField("hide_censored", T.BooleanType()),
        T.StructField("leased_only", T.BooleanType()),
    ]
)

SEARCH = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("radius", T.DoubleType()),
        T.StructField("bedrooms", T.StringType()),
        T.StructField("bathrooms", T.StringType()),
        T.StructField("property_types", T.ArrayType(T.StringType())),
        T.StructField("years_back", T.IntegerType()),
        T.StructField("window_start", T.StringType()),
        T.StructField("window_end", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("pull_ref", T.StringType()),
        T.StructField("subject", SUBJECT),
        T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("include_overrides", T.ArrayType(T.StringType())),
        T.StructField("filters", FILTERS),
        T.StructField("drift_pct", T.DoubleType()),
        T.StructField("candidate_rent", T.DoubleType()),
    ]
)

WORKSPACE = T.StructType(
    REQUEST.fields
    + [
        T.StructField("search", SEARCH),
        T.StructField("saved_at", T.StringType()),
    ]
)

WINDOW_STATUS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("sig", T.StringType()),
        T.StructField("satisfied", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("owed", T.BooleanType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("as_of", T.StringType()),
        T.StructField("window", T.ArrayType(T.StringType())),
        T.StructField("planned", T.IntegerType()),
        T.StructField("fetchable", T.IntegerType()),
        T.StructField("queries", T.ArrayType(WINDOW_STATUS)),
    ]
)

CALL = T.StructType(
    [
        T.StructField("sig", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("status", T.IntegerType()),
        T.StructField("total_count", T.IntegerType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("month", T.StringType()),
        T.StructField("calls_this_month", T.IntegerType()),
        T.StructField("history", T.ArrayType(CALL)),
    ]
)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


# ---- tables of the incremental store

_TEXT, _DAY, _REAL, _WHOLE = T.StringType(), T.DateType(), T.DoubleType(), T.IntegerType()
STORED_FILE = _fields(pull_ref=_TEXT, file_name=_TEXT)
STORED_RESPONSE = _fields(pull_ref=_TEXT, file_name=_TEXT, body=_TEXT, as_of=_TEXT, fetched_at=_TEXT, total_count=_WHOLE)
STORED_MANIFEST = _fields(pull_ref=_TEXT, as_of=_DAY, window_start=_TEXT, window_end=_TEXT, planned=_WHOLE, fetchable=_WHOLE)
STORED_LISTING = _fields(
    pull_ref=_TEXT, listing=_TEXT, file_name=_TEXT, id=_TEXT, own_key=_TEXT, listedDate=_TEXT, removedDate=_TEXT, price=_REAL,
    history=LISTING["history"].dataType, address=_TEXT, unit=_TEXT, lat=_REAL, lng=_REAL, beds=_REAL, baths=_REAL, sqft=_REAL,
)
STORED_MEMBER = _fields(pull_ref=_TEXT, group_key=_TEXT, listing=_TEXT)
STORED_UNIT = _fields(pull_ref=_TEXT, group_key=_TEXT)
STORED_CHAIN = _fields(
    pull_ref=_TEXT, group_key=_TEXT, chain=T.LongType(), first_listed=_DAY, chain_end=_DAY, initial_ask=_REAL, relist_count=_WHOLE,
    gap_days=_WHOLE, cut_history=CUTS, address=_TEXT, unit=_TEXT, beds=_REAL, baths=_REAL, sqft=_REAL, lat=_REAL, lng=_REAL,
    withdrawal_suspect=T.BooleanType(),
)
