"""The report of a search: formatted rows, the best of them, and the whole as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NONE, decimals, pesos, place, source_label
from ..schemas import missing
from .rank import RankOptions

HEADERS = ("#", "Barrio / Conjunto", "Area m²", "Price", "Admin", "Cost/m²", "Dist", "Beds/Baths", "Estrato", "Agency", "Contact", "Source", "Link")


def _or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def report_rows(top: DataFrame) -> DataFrame:
    """The thirteen text columns of the report's table, c0 to c12, with rank to order them."""
    road = F.concat(decimals(F.col("driving_km"), 1), F.lit(" km / "), decimals(F.col("driving_min")), F.lit(" min"))
    far = F.when(F.col("driving_km").isNotNull(), road).when(F.col("distance_km").isNotNull(), F.concat(decimals(F.col("distance_km"), 1), F.lit(" km"))).otherwise(NONE)
    contact = F.coalesce(F.concat(missing(F.col("phone")), F.when(F.col("has_whatsapp"), " (WA)").otherwise("")), F.lit(NONE))
    cells = (
        _or_dash(F.col("rank")), place(NONE), decimals(F.col("area_m2")), pesos(F.col("price")), pesos(F.col("admin")), pesos(F.col("cost_per_m2")), far,
        F.concat(_or_dash(F.col("bedrooms")), F.lit("/"), _or_dash(F.col("bathrooms"))), _or_dash(F.col("estrato")), F.coalesce(missing(F.col("agency")), F.lit(NONE)), contact,
        source_label(F.col("merged_sources"), F.col("source")), F.concat(F.lit("[ver]("), "url", F.lit(")")),
    )
    return top.select("rank", *(c.alias(f"c{k}") for k, c in enumerate(cells)))


def best_line(top: DataFrame) -> DataFrame:
    """One row with the best listing in a sentence; none for an empty result."""
    km = F.coalesce(F.concat(decimals(F.col("distance_km"), 1), F.lit(" km away")), F.lit("distance unknown"))
    km = F.when(F.col("distance_km").isNotNull(), km).otherwise("distance unknown")
    return top.orderBy("rank").limit(1).select(F.concat(F.lit("Best value: #"), F.col("rank").cast("string"), F.lit(" "), place(NONE), F.lit(" — "), decimals(F.col("area_m2")), F.lit(" m² at "), pesos(F.col("price")), F.lit(" ("), pesos(F.col("cost_per_m2")), F.lit("/m²), "), km, F.lit(".")).alias("line"))


def report_text(top: DataFrame, o: RankOptions) -> DataFrame:
    """One row, text: the options, the table and the best listing. top is limited, so its rows are gathered."""
    head = f"Cities: {', '.join(o.cities) or NONE}. Reference point: {o.lat}, {o.lng}. Max distance: {o.max_km} km. Min area: {o.min_area} m². Weights: cost {o.w_cost}, area {o.w_area}, distance {o.w_dist}."
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(f"c{k}" for k in range(len(HEADERS)))), F.lit(" |"))
    body = report_rows(top).select("rank", row.alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))
    table_head = "| " + " | ".join(HEADERS) + " |\n|" + "---|" * len(HEADERS)
    best = best_line(top).agg(F.max("line").alias("line"))
    said = F.coalesce("line", F.lit("No listing passed the filters."))
    return body.crossJoin(F.broadcast(best)).select(F.concat(F.lit(f"# Rental search report\n\n{head}\n\n{table_head}\n"), "body", F.lit("\n\n"), said, F.lit("\n")).alias("text"))
