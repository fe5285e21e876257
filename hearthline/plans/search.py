"""The search over stored listings: scan, merge duplicates, filter, score, rank."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import dedupe
from ..operators.geocode import fill_coordinates
from ..operators.merge import newest_completed
from ..operators.rank import RankOptions, evaluate, in_cities, reasons, score, stats, top, with_driving


class SearchResult(NamedTuple):
    evaluated: DataFrame  # every merged listing, with distance_km and reason
    ranked: DataFrame  # the scored survivors, unordered
    top: DataFrame  # the best options.top of them, with rank
    stats: DataFrame
    reasons: DataFrame
    last_run: DataFrame | None


def rank(listings: DataFrame, options: RankOptions, cache: DataFrame | None = None, driving: DataFrame | None = None, runs: DataFrame | None = None) -> SearchResult:
    """Filter, score and rank listings as they are. cache fills coordinates, driving refines distances where given."""
    located = fill_coordinates(listings, cache) if cache is not None else listings
    evaluated = evaluate(located, options)
    if driving is not None:
        evaluated = with_driving(evaluated, driving, options)
    scored = score(evaluated.where("reason is null"), options)
    return SearchResult(evaluated, scored, top(scored, options.top), stats(evaluated, driving is not None), reasons(evaluated), newest_completed(runs) if runs is not None else None)


def search(stored: DataFrame, options: RankOptions, cache: DataFrame | None = None, driving: DataFrame | None = None, runs: DataFrame | None = None) -> SearchResult:
    """Over the active rows of a snapshot: city filter, then merging of duplicates, then rank(). The city filter comes first on purpose: it changes the groups."""
    chosen = stored.where("is_active").where(in_cities(F.col("city"), options.cities))
    return rank(dedupe(chosen), options, cache, driving, runs)
