"""One record per property: adverts that agree on place, price and size are merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid
from ..functions.text import norm
from ..schemas import LISTING_COLUMNS, missing

#: Width of a price bucket, in pesos; decimals of a coordinate cell.
PRICE_BUCKET, CELL = 50_000, 1000

#: Points of an advert that says everything.
MOST_COMPLETE = 13

_KEYS = ("source", "source_listing_id", "url")


def _bucket(c: Column, k: float) -> Column:
    """Half-up rounding to a whole number of 1/k; a bigint, so that equal cells are equal."""
    return F.floor(c * k + 0.5).cast("bigint")


def signature() -> Column:
    """struct that is equal for adverts of one property.

    With coordinates: their cell of about 100 m, price bucket, area and bedrooms. Without: barrio and conjunto, price bucket
    and area. With neither place nothing is merged: the key of the advert itself. Nulls equal nulls.
    """
    located = valid(F.col("lat")) & valid(F.col("lng"))
    barrio, conjunto = norm(F.col("barrio")), norm(F.col("conjunto"))
    kind = F.when(located, "geo").when((barrio != "") | (conjunto != ""), "txt").otherwise("uniq")
    only = lambda k, c: F.when(kind == k, c)
    return F.struct(
        kind.alias("kind"),
        only("geo", _bucket(F.col("lat"), CELL)).alias("lat_cell"),
        only("geo", _bucket(F.col("lng"), CELL)).alias("lng_cell"),
        F.when(kind != "uniq", _bucket(F.col("price") / PRICE_BUCKET, 1)).alias("price_bucket"),
        F.when(kind != "uniq", _bucket(F.col("area_m2"), 1)).alias("area"),
        only("geo", F.col("bedrooms")).alias("bedrooms"),
        only("txt", barrio).alias("barrio"),
        only("txt", conjunto).alias("conjunto"),
        only("uniq", F.concat_ws(":", "source", "source_listing_id")).alias("own"),
    )


def completeness() -> Column:
    """How much an advert says; a phone number counts most."""
    # Points of each field.
    text = [(missing(F.col(c)).isNotNull(), n) for c, n in (("phone", 5), ("barrio", 1), ("conjunto", 1), ("agency", 1))]
    rest = [(F.col("lat").isNotNull() & F.col("lng").isNotNull(), 2)] + [(F.col(c).isNotNull(), 1) for c in ("area_m2", "price", "estrato")]
    return reduce(lambda a, b: a + b, (F.when(held, n).otherwise(0) for held, n in text + rest))


def _present(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return missing(c).isNotNull() if dict(df.dtypes)[name] == "string" else c.isNotNull()


def dedupe(listings: DataFrame) -> DataFrame:
    """The listing columns of each property, with merged_sources (distinct, in input order) and source_links.

    The base is the most complete advert (ties: source, then id), which is the input order here); every other column takes the
    first value that isn't missing in that order, has_whatsapp is true if any is. source_links has each URL once, in the same
    order. Columns are reduced by min_by, which combines before the shuffle: a signature that a third of all adverts share is
    merged from one row per task. Only its links, which are part of the result, are gathered.
    """
    most = F.lpad((F.lit(MOST_COMPLETE) - completeness()).cast("string"), 2, "0")
    rank = F.concat_ws("\x01", most, F.coalesce("source", F.lit("")), F.coalesce("source_listing_id", F.lit("")))  # one text compares faster than a struct
    tagged = listings.select(signature().alias("_sig"), rank.alias("_rank"), *listings.columns)
    names = [c for c in LISTING_COLUMNS if c in listings.columns]
    merged = [F.min_by(F.struct(*_KEYS), "_rank").alias("_base")]
    for name in names:
        if name in _KEYS:
            continue
        elif name == "has_whatsapp":
            merged.append(F.coalesce(F.bool_or(name), F.lit(False)).alias(name))
        else:
            merged.append(F.min_by(name, F.when(_present(listings, name), F.col("_rank"))).alias(name))
    by_url = tagged.where(missing(F.col("url")).isNotNull()).groupBy("_sig", "url").agg(F.min("_rank").alias("r"))
    link_lists = by_url.groupBy("_sig").agg(F.sort_array(F.collect_list(F.struct("r", "url"))).alias("l"))
    link_lists = link_lists.select("_sig", F.transform("l", lambda x: F.struct(F.get(F.split(x["r"], "\x01"), F.lit(1)).alias("source"), x["url"].alias("url"))).alias("source_links"))
    merged.append(F.array_sort(F.collect_set("source")).alias("merged_sources"))
    base = tagged.groupBy("_sig").agg(*merged).select("_sig", "_base.*", *(c for c in names if c not in _KEYS), "merged_sources")
    return base.join(link_lists, "_sig", "left").select(*names, "merged_sources", F.coalesce("source_links", F.array().cast("array<struct<source:string,url:string>>")).alias("source_links"))
