"""Listings from a user's delimited list."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import area, norm_text, price
from ..functions.urls import is_web_url
from ..schemas import as_listing, missing
from ..staging import staged
from .records import count_fields, is_open, read_lines, records

# Headers by the column they mean.
HEADERS = {
    "barrio": ("barrio", "neighborhood", "sector"),
    "conjunto": ("conjunto", "conjunto residencial", "complejo", "urbanizacion", "edificio"),
    "area": ("area", "area m2", "area (m2)", "area construida", "metros", "m2", "mt2"),
    "precio": ("precio", "price", "valor", "canon", "arriendo"),
    "admin": ("admin", "administracion", "cuota administracion"),
    "link": ("link", "url", "enlace"),
    "city": ("ciudad", "city"),
}
SEPARATORS = ("\t", ";", ",", "|")
CORRUPT = "_corrupt"


def canonical_header(header: str) -> str | None:
    h = norm_text(header)
    return next((column for column, names in HEADERS.items() if h in names), None)


#: Lines that are looked at for the header's separator, at most.
HEADER_LINES = 100


def sniff_separator(lines: list[str]) -> str:
    """The separator that the header, which goes on while a quote is open, holds most of outside quotes."""
    head = next(("\n".join(lines[: k + 1]) for k in range(len(lines)) if sum(x.count('"') for x in lines[: k + 1]) % 2 == 0), lines[0])
    bare = re.sub(r'"[^"]*"?', "", head)
    return max(SEPARATORS, key=lambda s: (bare.count(s), -SEPARATORS.index(s)))


def unique_names(names: list[str]) -> list[str]:
    """Names of columns; the second of one name and so on get a number."""
    seen: dict[str, int] = {}
    out = []
    for h in names:
        seen[h] = seen.get(h, -1) + 1
        out.append(f"{h}#{seen[h]}" if seen[h] else h)
    return out


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a delimited file, or a folder of its parts, with a header: all text, with n (1-based, blank lines not counted)
    and _corrupt (the record, if it has too few or too many cells or a quote that stays open).

    Quoted cells may hold separators, line breaks and doubled quotes, across file splits too (see records.py). The separator is
    that of the header; only its lines are read ahead.
    """
    lines = read_lines(spark, path)
    first = lines.where(F.btrim("value", F.lit(" \t\r")) != "").orderBy("file", "block", "at").limit(HEADER_LINES).collect()
    if not first:
        return spark.createDataFrame([], f"n bigint, {CORRUPT} string")
    sep = sniff_separator([r["value"] for r in first])
    found = staged(records(lines, sep), "list-records")
    head = found.where("n = 0").first()["record"]
    names = [h.strip() for h in next(csv.reader(io.StringIO(head), delimiter=sep))]
    schema = ", ".join(f"`{h.replace('`', '``')}` string" for h in unique_names(names))
    cells = F.from_csv("record", schema, {"sep": sep, "mode": "PERMISSIVE", "escape": '"'})
    bad = F.col("cut") | (count_fields(F.col("record"), sep) != len(names)) | is_open(F.col("record"), sep)
    return found.where("n > 0").select("n", F.when(bad, F.col("record")).alias(CORRUPT), cells.alias("x")).select("n", CORRUPT, "x.*")


def listings_from_list(rows: DataFrame) -> DataFrame:
    """Listings of a list's rows: known headers by their aliases (of two of one column the last counts), rows without area and price left out.

    A row with a web link is known by it; others get an id and URL from their number.
    """
    by_column = {canonical_header(h.split("#")[0]): h for h in rows.columns if h not in ("n", CORRUPT) and canonical_header(h.split("#")[0])}
    get = lambda k: F.btrim(F.col(f"`{by_column[k]}`")) if k in by_column else F.lit(None).cast("string")
    x = rows.select("n", *(get(k).alias(k) for k in HEADERS), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in ("n", CORRUPT)))).alias("raw"))
    x = x.withColumns({"_area": area(F.col("area")), "_price": price(F.col("precio"))}).where("_area is not null or _price is not null")
    own = is_web_url(F.col("link"))
    row = F.concat(F.lit("row-"), F.col("n").cast("string"))
    return as_listing(
        x, source=F.lit("manual"), source_listing_id=F.when(own, F.col("link")).otherwise(row), url=F.when(own, F.col("link")).otherwise(F.concat(F.lit("https://manual.local/"), row)), barrio=missing(F.col("barrio")), conjunto=missing(F.col("conjunto")),
        city=missing(F.col("city")), area_m2=F.col("_area"), price=F.col("_price"), admin=price(F.col("admin")), raw_json=F.col("raw"),
    )


def list_warnings(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """warning: the first three malformed lines, and whether no row was recognised."""
    bad = rows.where(F.col(CORRUPT).isNotNull()).orderBy("n").limit(3).select(F.concat(F.lit("CSV: malformed line (row "), F.col("n").cast("string"), F.lit(")")).alias("warning"))
    none = listings.limit(1).agg(F.count("*").alias("k")).where("k = 0").select(F.lit("No rows recognised; expected headers Barrio, Conjunto, Area, Precio, Link.").alias("warning"))
    return bad.unionByName(none)
