"""Coordinates from a cache of geocoded queries. What the cache lacks is a worklist for whoever asks the geocoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import coarser, geocode_query, valid
from ..functions.text import norm
from .merge import upsert

#: Days that coordinates of this provider may be kept.
STALE_DAYS, AGEING_PROVIDER = 30, "google"


def with_query(listings: DataFrame) -> DataFrame:
    """Adds query (normalised; null where the listing has coordinates or names no place) and query_precision."""
    asked = geocode_query(*(F.col(c) for c in ("address", "conjunto", "barrio", "city")))
    located = valid(F.col("lat")) & valid(F.col("lng"))
    return listings.withColumn("_q", F.when(~located, asked)).withColumn("query", F.nullif(norm(F.col("_q.query")), F.lit(""))).withColumn("query_precision", F.col("_q.precision")).drop("_q")


def stale(now: Column) -> Column:
    return (F.col("provider") == AGEING_PROVIDER) & (F.col("created_at") < now - F.expr(f"interval {STALE_DAYS} days"))


def fill_coordinates(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Listings with the coordinates of the cache where they have none; stale rows still serve. Own coordinates without a precision are "source"."""
    found = cache.select("query", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("precision").alias("_precision"))
    # Rows that ask for nothing have a key of their own each, so that they spread like all others.
    asked = with_query(listings).withColumn("_ask", F.coalesce("query", F.concat(F.lit("\u0000"), F.col("source"), F.lit("\u0000"), F.col("source_listing_id"))))
    joined = asked.join(found.withColumnRenamed("query", "_ask"), "_ask", "left")
    located = valid(F.col("lat")) & valid(F.col("lng"))
    hit = ~located & F.col("_lat").isNotNull()
    precision = F.when(located, F.coalesce("geocode_precision", F.lit("source"))).when(hit, coarser(F.col("query_precision"), F.col("_precision"))).otherwise(F.col("geocode_precision"))
    return joined.withColumn("geocode_precision", precision).withColumn("lat", F.when(hit, F.col("_lat")).otherwise(F.col("lat"))).withColumn("lng", F.when(hit, F.col("_lng")).otherwise(F.col("lng"))).select(*listings.columns)


def worklist(listings: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """The distinct queries that no fresh cache row answers."""
    fresh = cache.where(~F.coalesce(stale(now), F.lit(False))).select("query")
    return with_query(listings).select("query").where("query is not null").distinct().join(fresh, "query", "left_anti")


def refresh_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers (of its columns) over old ones, their created_at renewed."""
    return upsert(cache, answers, "query")
