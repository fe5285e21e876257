"""Filters and orders that a user types."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import effective_km, place, source_label
from ..schemas import finite, missing

FILTERABLE = {"price": "price", "area": "area_m2"}


def _amount(token: str) -> float | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([km]?)", re.sub(r"\s+", "", token), re.I | re.A)
    return float(m[1]) * {"": 1.0, "k": 1e3, "m": 1e6}[m[2].lower()] if m else None


def numeric_filter(expr: str | None, c: Column) -> tuple[Column | None, bool]:
    """(condition, invalid) of an expression such as <2M, >=800k, 1M-2M, =90 or 90 (at least). No condition: blank or invalid.

    Null and NaN cells fail every condition.
    """
    s = (expr or "").strip()
    if not s:
        return None, False
    v = finite(c)
    if m := re.fullmatch(r"(<=|>=|==|<|>|=)\s*(.+)", s):
        n = _amount(m[2])
        if n is None:
            return None, True
        if m[1] in ("=", "=="):
            return F.abs(v - n) <= 1e-9 * max(1.0, abs(n)), False
        return {"<": v < n, "<=": v <= n, ">": v > n, ">=": v >= n}[m[1]], False
    if m := re.fullmatch(r"([^-]+)-([^-]+)", s):
        a, b = _amount(m[1]), _amount(m[2])
        return (None, True) if a is None or b is None else (v.between(min(a, b), max(a, b)), False)
    n = _amount(s)
    return (None, True) if n is None else (v >= n, False)


def column_filters(df: DataFrame, exprs: Mapping[str, str], visible: Iterable[str] | None = None) -> DataFrame:
    """Rows that pass the valid filters of all visible columns."""
    shown = set(FILTERABLE) if visible is None else set(visible)
    found = [numeric_filter(e, F.col(FILTERABLE[k]))[0] for k, e in exprs.items() if k in shown and k in FILTERABLE]
    return df.where(reduce(lambda a, b: a & b, (c for c in found if c is not None), F.lit(True)))


def by_state(df: DataFrame, states: Iterable[str], column: str = "state") -> DataFrame:
    wanted = list(states)
    return df.where(F.col(column).isin(*wanted) if wanted else F.lit(False))


def sort_column(key: str) -> tuple[Column, bool] | None:
    """(value, is text) of a sortable column."""
    number = {"rank": "rank", "score": "score", "area": "area_m2", "price": "price", "admin": "admin", "cpm2": "cost_per_m2", "beds": "bedrooms", "estrato": "estrato"}
    if key in number:
        return F.col(number[key]), False
    if key == "dist":
        return effective_km(), False
    text = {"loc": lambda: place(), "city": lambda: F.col("city"), "agency": lambda: F.col("agency"), "source": lambda: source_label(F.col("merged_sources"), F.col("source"))}
    return (text[key](), True) if key in text else None


def user_sort(df: DataFrame, keys: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows by several (key, "asc" or "desc"); missing values last either way, texts in Spanish order, ties by rank. Unknown keys are passed over."""
    order = []
    for key, direction in keys:
        found = sort_column(key)
        if found is None:
            continue
        value = F.collate(missing(found[0]), "es") if found[1] else found[0]
        order.append(value.asc_nulls_last() if direction == "asc" else value.desc_nulls_last())
    return df.orderBy(*order, "rank") if order else df


# The columns of the result table, and whether they show by default.
RESULT_COLUMNS = {
    "rank": True, "score": True, "place": True, "city": True, "area_m2": True, "price": True, "admin": True, "cost_per_m2": True, "distance": True, "bedrooms": True,
    "estrato": True, "agency": False, "phone": False, "source": True, "verdict": True, "url": True,
}


def visible_columns(df: DataFrame, visible: Iterable[str] | None = None) -> DataFrame:
    """The result table's columns that show. place, distance and source are made from the listing's; without a verdict its column is null."""
    shown = None if visible is None else set(visible)
    wanted = [c for c, on in RESULT_COLUMNS.items() if (on if shown is None else c in shown)]
    distance = effective_km() if "driving_km" in df.columns else F.col("distance_km")
    source = source_label(F.col("merged_sources"), F.col("source")) if "merged_sources" in df.columns else F.col("source")
    made = {"place": place(), "distance": distance, "source": source, "verdict": F.col("verdict") if "verdict" in df.columns else F.lit(None).cast("string")}
    return df.select(*(made.get(c, F.col(c)).alias(c) for c in wanted))


def map_points(ranked: DataFrame, n: int = 50) -> DataFrame:
    """The first n ranked rows that have coordinates."""
    return ranked.where("lat is not null and lng is not null").orderBy("rank").limit(n)
