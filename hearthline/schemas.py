"""Record types. A listing has one row per advert; null and '' both mean "missing" for strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How exactly coordinates are known, best first, and the kilometres of slack each gets.
PRECISIONS = ("rooftop", "source", "street", "barrio_centroid", "city")
PRECISION_SLACK_KM = {"rooftop": 0.0, "source": 0.2, "street": 0.3, "barrio_centroid": 1.0, "city": 4.0}

_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()

LISTING = T.StructType(
    [T.StructField(n, _STRING) for n in ("source", "source_listing_id", "url", "title", "barrio", "conjunto", "city", "address")]
    + [T.StructField(n, _DOUBLE) for n in ("lat", "lng")]
    + [T.StructField("geocode_precision", _STRING), T.StructField("area_m2", _DOUBLE)]
    + [T.StructField(n, _INT) for n in ("bedrooms", "bathrooms", "parking")]
    + [T.StructField("price", _DOUBLE), T.StructField("admin", _DOUBLE), T.StructField("estrato", _INT)]
    + [T.StructField(n, _STRING) for n in ("currency", "agency", "phone")]
    + [T.StructField("has_whatsapp", T.BooleanType()), T.StructField("raw_json", _STRING)]
)
LISTING_COLUMNS = tuple(LISTING.names)

SNAPSHOT = T.StructType(LISTING.fields + [T.StructField(n, T.TimestampType()) for n in ("first_seen", "last_seen", "last_verified_at")] + [T.StructField("is_active", T.BooleanType())])
LINK = T.StructType([T.StructField("source", _STRING), T.StructField("url", _STRING)])
GEOCACHE = T.StructType([T.StructField("query", _STRING), T.StructField("lat", _DOUBLE), T.StructField("lng", _DOUBLE), T.StructField("precision", _STRING), T.StructField("provider", _STRING), T.StructField("place_id", _STRING), T.StructField("created_at", T.TimestampType())])
RUN = T.StructType([T.StructField("id", _STRING), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()), T.StructField("status", _STRING), T.StructField("params", _STRING), T.StructField("stats", _STRING)])
REVIEW = T.StructType([T.StructField("key", _STRING), T.StructField("seen", T.BooleanType()), T.StructField("eligible", T.BooleanType())])
PAYLOAD = T.StructType([T.StructField("source", _STRING), T.StructField("url", _STRING), T.StructField("city", _STRING), T.StructField("page_no", _INT), T.StructField("fetched_at", T.TimestampType()), T.StructField("status", _INT), T.StructField("body", _STRING)])


def as_listing(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the listing columns by name from `columns`; what is not given is null (has_whatsapp: false, currency: COP)."""
    given = {"has_whatsapp": F.lit(False), "currency": F.lit("COP")} | columns
    unknown = set(given) - set(LISTING_COLUMNS)
    if unknown:
        raise ValueError(f"not listing columns: {sorted(unknown)}")
    return df.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING.fields))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def missing(c: Column) -> Column:
    """Null for '' too."""
    return F.nullif(c, F.lit(""))


def violations(listings: DataFrame) -> DataFrame:
    """source, source_listing_id, violation: one row for each rule a listing breaks. A report, not a gate."""
    rules = {
        "source": missing(F.col("source")).isNull(),
        "source_listing_id": missing(F.col("source_listing_id")).isNull(),
        "url": F.coalesce(~F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/]+"), F.lit(True)),
        "area_m2": ~(finite(F.col("area_m2")) > 0) | F.isnan("area_m2"),
        "price": ~(finite(F.col("price")) > 0) | F.isnan("price"),
        "admin": finite(F.col("admin")) < 0,
        "estrato": ~F.col("estrato").between(1, 6),
        "geocode_precision": ~F.col("geocode_precision").isin(*PRECISIONS),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return listings.select("source", "source_listing_id", F.explode(found).alias("violation"))
