"""Distances, coordinates and how exactly they are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PRECISION_SLACK_KM, PRECISIONS, missing
from .text import norm

EARTH_KM = 6371.0


def valid(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def haversine_km(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Great-circle kilometres to a fixed point; null where a coordinate is missing."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(F.lit(lat0) - lat) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * half(F.lit(lng0) - lng)
    return F.when(valid(lat) & valid(lng), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def slack_km(precision: Column) -> Column:
    """Kilometres of tolerance for a precision; unknown and null count as "city"."""
    table = F.create_map(*(F.lit(x) for pair in PRECISION_SLACK_KM.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(precision, F.lit("city"))), F.lit(PRECISION_SLACK_KM["city"]))


def precision_rank(precision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECISIONS)), precision)


def coarser(a: Column, b: Column) -> Column:
    """The less exact of two precisions."""
    return F.when(precision_rank(a) >= precision_rank(b), a).otherwise(b)


def precision_of_location_type(kind: Column) -> Column:
    """A geocoder's location type as a precision."""
    # Location types of the geocoder.
    out = {"ROOFTOP": "rooftop", "RANGE_INTERPOLATED": "street", "GEOMETRIC_CENTER": "barrio_centroid", "APPROXIMATE": "city"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in out.items() for x in pair)), kind), F.lit("city"))


def point(s: Column) -> Column:
    """struct(lat, lng) of a text "lat,lng"; null unless it is two numbers."""
    parts = F.split(s, ",", -1)
    at = lambda k: F.btrim(F.get(parts, F.lit(k))).try_cast("double")
    return F.when((F.size(parts) == 2) & valid(at(0)) & valid(at(1)), F.struct(at(0).alias("lat"), at(1).alias("lng")))


def geocode_query(address: Column, conjunto: Column, barrio: Column, city: Column) -> Column:
    """struct(query, precision): the most exact place a listing names; null if it names none."""
    # The region's name as the geocoder expects it.
    where = F.when(missing(city).isNotNull(), F.concat(city, F.lit(", Valle del Cauca, Colombia"))).otherwise(F.lit("Colombia"))
    answer = lambda q, p: F.struct(q.alias("query"), F.lit(p).alias("precision"))
    near = F.coalesce(F.concat(F.lit(", "), missing(barrio)), F.lit(""))
    return (
        F.when(F.length(norm(address)) > 4, answer(F.concat_ws(", ", address, where), "street"))
        .when(F.length(norm(conjunto)) > 2, answer(F.concat(conjunto, near, F.lit(", "), where), "barrio_centroid"))
        .when(F.length(norm(barrio)) > 2, answer(F.concat_ws(", ", barrio, where), "barrio_centroid"))
        .when(missing(city).isNotNull(), answer(where, "city"))
    )
