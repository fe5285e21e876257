"""Filters that drop listings for a reason, and the score that orders the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, slack_km
from ..functions.text import norm, norm_text, positive
from .numbering import number_rows

# Barrios and comunas of the default zone, and the city it belongs to.
SOUTHERN_ZONES = (
    "ciudad jardin", "pance", "valle del lili", "el caney", "caney", "el limonar", "gran limonar", "el ingenio", "bochalema", "ciudad 2000", "la hacienda",
    "los portales", "capri", "mayapan", "las vegas", "el refugio", "alferez real", "la maria", "holguines", "comuna 17", "comuna 22", "sur",
)
ZONED_CITY = "cali"

OUTSIDE_ZONE = "outside southern Cali"
TOO_FAR_BY_ROAD = "driving distance > max"


@dataclass(frozen=True)
class RankOptions:
    """What a search asks for. Bounds of 0 are no bounds; weights that sum to 0 are taken as they are."""

    lat: float = 3.4516
    lng: float = -76.532
    max_km: float = 8.0
    min_area: float = 80.0
    min_bedrooms: int = 0
    min_price: float = 0.0
    max_price: float = 0.0
    w_cost: float = 0.5
    w_area: float = 0.3
    w_dist: float = 0.2
    cities: tuple[str, ...] = ()
    zones: tuple[str, ...] = SOUTHERN_ZONES
    zone_filter: bool = True
    top: int = 10


def in_cities(city: Column, cities: tuple[str, ...]) -> Column:
    wanted = [norm_text(c) for c in cities if norm_text(c)]
    return norm(city).isin(*wanted) if wanted else F.lit(True)


def in_zones(barrio: Column, city: Column, zones: tuple[str, ...]) -> Column:
    """Whether a listing passes the zone filter: only the zoned city's must match a zone, in either direction."""
    b = norm(barrio)
    wanted = F.array(*(F.lit(norm_text(z)) for z in zones)) if zones else F.array().cast("array<string>")
    hit = (b != "") & F.exists(wanted, lambda z: F.contains(b, z) | F.contains(z, b))
    return (norm(city) != ZONED_CITY) | hit


def drop_reason(o: RankOptions) -> Column:
    """The first constraint a listing fails, as a template; null for one that stays."""
    area, price, km = F.col("area_m2"), F.col("price"), F.col("distance_km")
    out = F.when(area.isNull() | F.isnan(area), "missing area").when(area < o.min_area, "area # < min #")
    if o.min_bedrooms > 0:
        out = out.when(F.col("bedrooms") < o.min_bedrooms, "bedrooms # < min #")
    out = out.when(positive(price).isNull(), "missing price")
    if o.min_price > 0:
        out = out.when(price < o.min_price, "price # < min #")
    if o.max_price > 0:
        out = out.when(price > o.max_price, "price # > max #")
    return out.when(km.isNull(), "no location / distance").when(km > o.max_km + slack_km(F.col("geocode_precision")), "distance #km > max #km")


def evaluate(listings: DataFrame, o: RankOptions) -> DataFrame:
    """Adds distance_km, in_zone and reason (of the zone, then of the hard filters; null: kept)."""
    far = listings.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lng"), o.lat, o.lng))
    zone = in_zones(F.col("barrio"), F.col("city"), o.zones) if o.zone_filter else F.lit(True)
    return far.withColumn("in_zone", zone).withColumn("reason", F.when(~F.col("in_zone"), OUTSIDE_ZONE).otherwise(drop_reason(o)))


def with_driving(evaluated: DataFrame, driving: DataFrame, o: RankOptions) -> DataFrame:
    """Adds driving_km and driving_min of the kept rows from driving(dest_lat, dest_lng, km, min), and drops what they put too far.

    A table with origin_lat and origin_lng holds the answers of several points; only those from the options' point count. Rows
    without an answer keep the straight line. Road bounds come after the straight one, which road distances only exceed.
    Only kept rows with coordinates are joined; dropped ones and those without coordinates go round the shuffle.
    """
    if "origin_lat" in driving.columns:
        driving = driving.where((F.col("origin_lat") == o.lat) & (F.col("origin_lng") == o.lng))
    answers = driving.groupBy("dest_lat", "dest_lng").agg(F.min(F.struct("km", "min")).alias("d")).select(F.col("dest_lat").alias("lat"), F.col("dest_lng").alias("lng"), F.col("d.km").alias("driving_km"), F.col("d.min").alias("driving_min"))
    asked = F.col("reason").isNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    joined = evaluated.where(asked).join(answers, ["lat", "lng"], "left").select(*evaluated.columns, "driving_km", "driving_min")
    beyond = F.col("driving_km") > o.max_km + slack_km(F.col("geocode_precision"))
    joined = joined.withColumn("reason", F.when(beyond, TOO_FAR_BY_ROAD)).withColumn("distance_km", F.coalesce("driving_km", "distance_km"))
    none = F.lit(None).cast("double")
    return joined.unionByName(evaluated.where(~asked).withColumns({"driving_km": none, "driving_min": none}))


def reasons(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("reason is not null").groupBy("reason").count().withColumnRenamed("count", "n")


def stats(evaluated: DataFrame, driven: bool = False) -> DataFrame:
    """One row: input, with_location, after_zone, kept, dropped, driving_computed."""
    kept = F.count_if(F.col("reason").isNull())
    return evaluated.agg(
        F.count("*").alias("input"), F.count("distance_km").alias("with_location"), F.count_if("in_zone").alias("after_zone"), kept.alias("kept"), (F.count("*") - kept).alias("dropped"),
        (F.count("driving_km") if driven else F.lit(0).cast("bigint")).alias("driving_computed"),
    )


def cost_per_m2() -> Column:
    return (F.col("price") + F.coalesce("admin", F.lit(0.0))) / F.col("area_m2")


def _scaled(x: Column, lo: Column, hi: Column, invert: bool) -> Column:
    """0 to 1 between the least and the greatest, 1 where these are equal."""
    return F.when(hi <= lo, 1.0).otherwise(((hi - x) if invert else (x - lo)) / (hi - lo))


def score(kept: DataFrame, o: RankOptions) -> DataFrame:
    """Adds cost_per_m2 and score: min-max scaled cost, area and distance by weight. The bounds are one aggregate row, broadcast."""
    priced = kept.withColumn("cost_per_m2", cost_per_m2())
    columns = {"c": "cost_per_m2", "a": "area_m2", "d": "distance_km"}
    bounds = priced.agg(*(f(n).alias(f"_{k}{p}") for k, n in columns.items() for p, f in (("0", F.min), ("1", F.max))))
    part = lambda k, invert: _scaled(F.col(columns[k]), F.col(f"_{k}0"), F.col(f"_{k}1"), invert)
    total = o.w_cost + o.w_area + o.w_dist or 1.0
    value = (o.w_cost * part("c", True) + o.w_area * part("a", False) + o.w_dist * part("d", True)) / total
    return priced.crossJoin(F.broadcast(bounds)).withColumn("score", value).drop(*(f"_{k}{p}" for k in columns for p in "01"))


TIES = ("source", "source_listing_id")


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n best with their rank; ties by source and id."""
    best = scored.orderBy(F.desc("score"), *TIES).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *TIES)))  # of n rows


def rank_all(scored: DataFrame) -> DataFrame:
    """Every row with its rank, best score first and ties by source and id, without putting all rows, or all of one score, into one
    task: rows are dealt into ranges of (score, source, id), and a rank is a place in its range after the counts of better ranges.
    """
    placed = number_rows(scored, [F.desc("score"), *TIES], name="_place")
    return placed.select(*scored.columns, (F.col("_place") + 1).alias("rank"))


def best_score(scored: DataFrame) -> DataFrame:
    """The scale of a score bar: the best score, 1 at least."""
    return scored.agg(F.greatest(F.lit(1.0), F.max("score")).alias("best_score"))
