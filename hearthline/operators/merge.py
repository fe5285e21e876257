"""Merging a crawl into the stored snapshot, and the log of runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source", "source_listing_id")


#: Adverts that a page of these sources leads to; a limit of pages is so many times as many details.
DETAILS_A_PAGE = {"arriendo": 50, "rentola": 30, "century21": 20}


def cap_details(df: DataFrame, max_pages: int, order: Iterable[str]) -> DataFrame:
    """The first rows of each source whose details are fetched one by one, as many as max_pages pages lead to (rentola: one page
    at least; others: no cap for 0); other sources whole. Rows over the cap go before the shuffle's sort."""
    caps = {s: (max(1, max_pages) if s == "rentola" else max_pages) * k for s, k in DETAILS_A_PAGE.items()}
    capped = [s for s, n in caps.items() if n > 0]
    parts = [cap_per_source(df.where(F.col("source") == s), caps[s], order) for s in capped]
    out = df.where(~F.col("source").isin(*capped) | F.col("source").isNull())
    for part in parts:
        out = out.unionByName(part)
    return out


def cap_per_source(df: DataFrame, n: int | None, order: Iterable[str], by: Iterable[str] = ("source",)) -> DataFrame:
    """The first n rows of each source in the given order; no cap for null or n <= 0. Rows over the cap go before the shuffle's sort."""
    if n is None or n <= 0:
        return df
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def first_of(df: DataFrame, by: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """One row of each key, the first in the order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def merge_snapshot(old: DataFrame, batch: DataFrame, deactivate: bool = True, scope: tuple[str, ...] = ("source",), in_order: bool = True) -> DataFrame:
    """The new snapshot: old rows updated by the batch's of the same key (all payload columns), and new ones inserted.

    batch: the columns of old but first_seen, last_seen, last_verified_at, is_active; plus seen_at, of which the last row of a
    key counts. first_seen is set on insert, last_seen on every change. With `deactivate`, rows that the batch lacks become
    inactive if the batch has any row of their scope (and last_seen moves with them); sources without rows are left alone.
    One full outer join on the key; scopes are a small aggregate.

    Where batches don't arrive in the order of their sightings (in_order=False), a row seen before the stored one's last_seen
    leaves that one's payload alone, and first_seen is the earliest sighting: the outcome is the same however rows are dealt
    into batches.
    """
    payload = [c for c in old.columns if c not in (*KEY, "first_seen", "last_seen", "last_verified_at", "is_active")]
    now = first_of(batch, KEY, [F.desc("seen_at"), *payload])
    if not in_order:
        now = now.join(batch.groupBy(*KEY).agg(F.min("seen_at").alias("_began")), list(KEY))
    began = F.col("seen_at") if in_order else F.col("_began")
    seen = now.select(*KEY, F.lit(True).alias("_in"), "seen_at", began.alias("_began"), *(F.col(c).alias(f"_{c}") for c in payload))
    was = old.withColumn("_was", F.lit(True))
    both = was.join(seen, list(KEY), "full_outer")
    if deactivate:
        scopes = now.groupBy(*scope).agg(F.max("seen_at").alias("_crawled"))
        both = both.join(scopes, list(scope), "left")
    else:
        both = both.withColumn("_crawled", F.lit(None).cast("timestamp"))
    here, known = F.col("_in").isNotNull(), F.col("_was").isNotNull()
    hit = here if in_order else here & (~known | (F.col("seen_at") >= F.col("last_seen")))
    gone = ~here & F.col("is_active") & F.col("_crawled").isNotNull()
    first = F.when(known, F.col("first_seen")).otherwise(F.col("_began"))
    return both.select(
        *KEY,
        *(F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in payload),
        (first if in_order else F.least(first, "_began")).alias("first_seen"),
        F.when(hit, F.col("seen_at")).when(gone, F.col("_crawled")).otherwise(F.col("last_seen")).alias("last_seen"),
        "last_verified_at",
        F.when(hit, F.lit(True)).when(gone, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
    ).select(*old.columns)


def gone_after(snapshot: DataFrame, since: Column, scope: tuple[str, ...] = ("source",)) -> DataFrame:
    """Keys of the active rows that a crawl since then has not seen, in scopes of which it has rows; with crawled, its last sighting there."""
    scopes = snapshot.where(F.col("is_active") & (F.col("last_seen") >= since)).groupBy(*scope).agg(F.max("last_seen").alias("crawled"))
    return snapshot.where(F.col("is_active") & (F.col("last_seen") < since)).join(scopes, list(scope)).select(*KEY, "crawled")


def crawl_diff(old: DataFrame, batch: DataFrame, scope: tuple[str, ...] = ("source",)) -> DataFrame:
    """source, listed, inserted, updated, deactivated of one crawl."""
    now = batch.select(*KEY).distinct()
    new = now.join(old, list(KEY), "left_anti").groupBy("source").agg(F.count("*").alias("inserted"))
    gone = old.where("is_active").join(now, list(KEY), "left_anti").join(now.select(*scope).distinct(), list(scope), "left_semi").groupBy("source").agg(F.count("*").alias("deactivated"))
    listed = batch.groupBy("source").agg(F.count("*").alias("listed"), F.count_distinct("source_listing_id").alias("distinct_ids"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return listed.join(new, "source", "left").join(gone, "source", "left").select("source", "listed", zero(F.col("inserted")).alias("inserted"), (F.col("distinct_ids") - zero(F.col("inserted"))).alias("updated"), zero(F.col("deactivated")).alias("deactivated"))


def counts_by_source(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """source, n of every registered source, zeros included."""
    counted = rows.groupBy("source").agg(F.count("*").alias("n"))
    return registry.select(F.col("id").alias("source")).join(counted, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def close_run(run: DataFrame, errors: DataFrame, persisted: DataFrame) -> DataFrame:
    """A run's end row: failed if there are errors and nothing was persisted, else completed; stats as JSON."""
    e = errors.agg(F.count("*").alias("errors"))
    p = persisted.agg(F.count("*").alias("persisted"), F.max("seen_at").alias("finished_at"))
    status = F.when((F.col("errors") > 0) & (F.col("persisted") == 0), "failed").otherwise("completed")
    return run.select("id", "started_at", "params").crossJoin(F.broadcast(e)).crossJoin(F.broadcast(p)).select("id", "started_at", "finished_at", status.alias("status"), "params", F.to_json(F.struct("persisted", "errors")).alias("stats"))


def newest_completed(runs: DataFrame) -> DataFrame:
    """The last completed run: one row or none."""
    return runs.where("status = 'completed'").orderBy(F.desc("finished_at"), "id").limit(1)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_null: bool = False) -> DataFrame:
    """Rows of new over those of old with the same key; with keep_null, null fields of new leave old ones as they are."""
    names = [c for c in old.columns if c != key]
    both = old.join(new.select(key, F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in names)), key, "full_outer")
    value = lambda c: F.coalesce(f"_{c}", c) if keep_null else F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(key, *(value(c).alias(c) for c in names)).select(*old.columns)
