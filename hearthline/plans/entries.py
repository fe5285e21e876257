"""The library's entry points: crawl, list, verify, discover, marked houses."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, marked, merge, verify
from ..operators.filters import by_state
from ..operators.rank import RankOptions
from ..sources.json_portals import enrich
from ..sources.registry import normalize_all, registry_table, select_sources
from ..sources.userlist import list_warnings, listings_from_list, read_list
from ..staging import staged
from .search import SearchResult, rank


class Ingested(NamedTuple):
    snapshot: DataFrame
    diff: DataFrame
    counts: DataFrame


def ingest(payloads: DataFrame, snapshot: DataFrame, only: Iterable[str] = (), hard: bool = False, cap: int | None = None, scope: tuple[str, ...] = ("source",), max_pages: int = 0, agencies: DataFrame | None = None, details: DataFrame | None = None) -> Ingested:
    """Normalise a crawl's payloads and merge them. The last fetch of a page counts as the time its listings were seen.

    cap: listings of a source; max_pages: caps sources of detail pages as cap_details does. Both keep the first by id: a table of
    payloads has no order of arrival. details(url and listing columns; see ciencuadras_details): what pages of single adverts add.
    """
    spark = payloads.sparkSession
    at = payloads.groupBy("source").agg(F.max("fetched_at").alias("seen_at"))
    rows = normalize_all(payloads, select_sources(only, hard), agencies).join(F.broadcast(at), "source")  # a row a source
    rows = merge.cap_details(rows, max_pages, ["source_listing_id"]) if max_pages > 0 else rows
    batch = merge.cap_per_source(rows, cap, ["source_listing_id"])
    batch = enrich(batch, details) if details is not None else batch
    return Ingested(merge.merge_snapshot(snapshot, batch, scope=scope), merge.crawl_diff(snapshot, batch, scope), merge.counts_by_source(batch, registry_table(spark)))


class Listed(NamedTuple):
    result: SearchResult
    warnings: DataFrame
    parsed: DataFrame


def rank_list(spark: SparkSession, path: str, options: RankOptions, cache: DataFrame | None = None) -> Listed:
    """Rank a user's list as it is: no merging, no zone filter."""
    from dataclasses import replace

    rows = read_list(spark, path)
    listings = listings_from_list(rows)
    return Listed(rank(listings, replace(options, zone_filter=False), cache), list_warnings(rows, listings), listings.agg(F.count("*").alias("parsed")))


def verify_urls(responses: DataFrame, snapshot: DataFrame | None, now, most: int = 60) -> tuple[DataFrame, DataFrame | None]:
    """(verdicts, the snapshot with dead URLs inactive) of the first `most` responses: as sent, where a column sent numbers them, else by url."""
    order = ["sent", "url"] if "sent" in responses.columns else ["url"]
    judged = verify.verdicts(responses.orderBy(*order).limit(most))
    return judged, verify.mark_dead(snapshot, judged, now) if snapshot is not None else None


discover = discovery.discover


def marked_houses(history: DataFrame, reviews: DataFrame, states: Iterable[str] = ("eligible", "seen")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts by state, marked houses of the states, their export rows); the houses are worked out once and written to the shared folder."""
    every = staged(marked.marked(history, reviews), "marked-houses")
    chosen = by_state(every, states)
    return marked.state_counts(every), chosen, marked.export_rows(chosen)
