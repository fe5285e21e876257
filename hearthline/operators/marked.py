"""Saved searches, review marks, and the houses they concern."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import STATE_NAMES, effective_km, identity_keys, place, review_state, safe_cell, state_name
from ..functions.text import round_half_up
from ..staging import staged
from .merge import upsert


def history_rows(history: DataFrame) -> DataFrame:
    """entry_id, ts, ref_label, entry_pos (newest first: by ts, then id), row_pos and the ranked row's fields of every entry; entries without rows give none."""
    rows = history.select(F.col("id").alias("entry_id"), "ts", "ref_label", F.posexplode("ranked").alias("row_pos", "l"))
    return rows.select("entry_id", "ts", "ref_label", "row_pos", "l.*")


def position(rows: DataFrame) -> DataFrame:
    """Adds pos, which orders rows as they are met: newest entry first, then by rank within."""
    return rows.withColumn("pos", F.struct((-F.unix_micros("ts")).alias("t"), F.col("entry_id").alias("e"), F.col("row_pos").alias("r")))


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds pos and the identity keys of each row. Rows at one place (of entries that share id and time) are told apart by their keys."""
    keyed = position(rows).withColumn("keys", identity_keys(F.col("source"), F.col("source_listing_id"), F.col("url"), F.col("source_links")))
    return keyed.withColumn("pos", F.col("pos").withField("k", F.xxhash64("keys")))


def _pairs(keyed: DataFrame) -> DataFrame:
    return keyed.select("pos", F.size("keys").alias("n"), F.explode("keys").alias("key"))


def _first(pairs: DataFrame) -> DataFrame:
    """key, first: the position that holds it first, n: how many keys that row has."""
    return pairs.groupBy("key").agg(F.min(F.struct("pos", "n")).alias("f")).select("key", F.col("f.pos").alias("first"), F.col("f.n").alias("n"))


def _holders(first: DataFrame, **marks: Column) -> DataFrame:
    """pos of the rows that hold all their keys first, with aggregates over these keys; only one row a key is dealt by position."""
    whole = first.groupBy(F.col("first").alias("pos")).agg(F.count("*").alias("_held"), F.min("n").alias("_n"), *(c.alias(name) for name, c in marks.items()))
    return whole.where("_held = _n").drop("_held", "_n")


def _kept(pairs: DataFrame, first: DataFrame) -> DataFrame:
    return pairs.join(first.select("key", "first"), "key").groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("first")).alias("new")).where("new").select("pos")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """Rows none of whose identity keys was met before, in the order of pos; rows that are passed over register their keys too.

    A row is the first of its kind if it is the first holder of each of its keys, so one minimum by key decides, without a
    loop over rows: keys are exploded, reduced to their first position, and a row stays if as many keys name it as it has.
    """
    keyed = with_keys(rows)
    return keyed.join(_holders(_first(_pairs(keyed))), "pos")


def first_marked(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """with_reviews(first_occurrences(rows), reviews), with reviews looked up once for each key: all keys of a first row name it."""
    return _first_marked(with_keys(rows), reviews)


def _first_marked(keyed: DataFrame, reviews: DataFrame) -> DataFrame:
    by_key = reviews.groupBy("key").agg(F.bool_or("seen").alias("seen"), F.bool_or("eligible").alias("eligible"))
    first = _first(_pairs(keyed)).join(by_key, "key", "left")
    return _with_state(keyed.join(_holders(first, seen=F.bool_or("seen"), eligible=F.bool_or("eligible")), "pos"))


class Occurrences(NamedTuple):
    """What is kept of histories, to be written between runs: first(key, first: the position that holds a key first) and kept(pos: of
    the first occurrences)."""

    first: DataFrame
    kept: DataFrame


#: Keys of an update's rows that are broadcast at most; with more, everything is worked out anew.
MAX_TOUCHED = 200_000


def occurrences(rows: DataFrame) -> Occurrences:
    """Of all histories, worked out anew. First positions are written once, and what is kept is read off them."""
    return _occurrences(with_keys(rows))


def _occurrences(keyed: DataFrame) -> Occurrences:
    first = staged(_first(_pairs(keyed)), "first-positions")
    return Occurrences(first.select("key", "first"), _holders(first))


def update_occurrences(old: Occurrences, rows: DataFrame, added: DataFrame, removed: Iterable[str]) -> Occurrences:
    """The occurrences after entries are added and others (by entry_id) removed; rows: those of the histories before that.

    Only keys of added and removed rows get another first position, and only rows that hold one of these are judged anew: what
    else is kept stays as it is. Rows are scanned for such keys, not shuffled. An update with more keys than can be broadcast would
    deal all rows by key and by position more than once, so everything is worked out anew then, which does so once.
    """
    removed = list(removed)
    out = F.col("entry_id").isin(*removed) if removed else F.lit(False)
    before, new = with_keys(rows), with_keys(added)
    gone, stay = before.where(out), before.where(~out)
    sizes = gone.select("keys").unionByName(new.select("keys")).agg(F.sum(F.size("keys").cast("bigint"))).first()[0]
    if (sizes or 0) > MAX_TOUCHED:
        return _occurrences(stay.select("pos", "keys").unionByName(new.select("pos", "keys")))
    touched = F.broadcast(staged(_pairs(gone).select("key").union(_pairs(new).select("key")).distinct(), "touched-keys"))
    pairs = _pairs(stay).unionByName(_pairs(new))
    first = old.first.join(touched, "key", "left_anti").unionByName(_first(pairs.join(touched, "key", "left_semi")).drop("n"))
    again = staged(pairs.join(touched, "key", "left_semi").select("pos").distinct(), "touched-rows")
    judged = _kept(pairs.join(again, "pos", "left_semi"), first)
    kept = old.kept.join(gone.select("pos"), "pos", "left_anti").join(again, "pos", "left_anti").unionByName(judged)
    return Occurrences(first, kept)


def _with_state(found: DataFrame) -> DataFrame:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return found.withColumns({"seen": yes("seen"), "eligible": yes("eligible"), "state": review_state(F.col("seen"), F.col("eligible"))})


def with_reviews(marked: DataFrame, reviews: DataFrame, by: str = "pos") -> DataFrame:
    """Adds seen, eligible and state: marked if any key is."""
    hit = marked.select(by, F.explode("keys").alias("key")).join(reviews, "key").groupBy(by).agg(F.bool_or("seen").alias("seen"), F.bool_or("eligible").alias("eligible"))
    return _with_state(marked.join(hit, by, "left"))


def state_counts(marked: DataFrame) -> DataFrame:
    """state, n of the three states, zeros included."""
    states = marked.sparkSession.createDataFrame([(s,) for s in STATE_NAMES], "state string")
    return states.join(marked.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def set_reviews(reviews: DataFrame, patches: DataFrame) -> DataFrame:
    """Reviews with patches (keys, seen, eligible; null fields leave what is there) written to every key of each listing."""
    new = patches.select(F.explode("keys").alias("key"), "seen", "eligible").groupBy("key").agg(F.bool_or("seen").alias("seen"), F.bool_or("eligible").alias("eligible"))
    return upsert(reviews, new, "key", keep_null=True)


def export_rows(marked: DataFrame) -> DataFrame:
    """The nine columns of the export, numbers as numbers; texts that a spreadsheet would run are defused."""
    link = F.when(F.startswith("url", F.lit("https://manual.local")), F.lit("")).otherwise(F.coalesce("url", F.lit("")))
    # The headers of the export.
    return marked.select(
        safe_cell(place()).alias("Barrio/Conjunto"), safe_cell(F.coalesce("city", F.lit(""))).alias("Ciudad"), F.col("area_m2").alias("m²"), F.col("price").alias("Precio"),
        round_half_up(F.col("cost_per_m2")).alias("$/m²"), round_half_up(effective_km(), 1).alias("Distancia (km)"), F.col("bedrooms").alias("Habitaciones"),
        state_name(F.col("state")).alias("Estado"), safe_cell(link).alias("Enlace"),
    )


def add_entries(history: DataFrame, entries: DataFrame, keep: int = 15) -> DataFrame:
    """The newest entry of each signature, the `keep` newest of them."""
    newest = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("ts"), F.desc("id")))
    return history.unionByName(entries).withColumn("_n", newest).where("_n = 1").drop("_n").orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def trim_entries(history: DataFrame, k: int) -> DataFrame:
    return history.withColumn("ranked", F.slice("ranked", 1, k))


def remove_entry(history: DataFrame, entry_id: str) -> DataFrame:
    return history.where(F.col("id") != entry_id)


def of_mode(history: DataFrame, mode: str, keep: bool = True) -> DataFrame:
    return history.where((F.col("mode") == mode) == F.lit(keep))


def latest_of_mode(history: DataFrame, mode: str) -> DataFrame:
    """The newest entry of a mode: one row or none."""
    return of_mode(history, mode).orderBy(F.desc("ts"), F.desc("id")).limit(1)


def marked(history: DataFrame, reviews: DataFrame, states: Iterable[str] | None = None) -> DataFrame:
    """Every house of all searches once, as its newest search shows it, with its review state; optionally only some states.

    Entries are read once, into rows that are written to the shared folder: an entry is long and is parsed as a whole.
    """
    found = _first_marked(staged(with_keys(history_rows(history)), "history-rows"), reviews)
    if states is None:
        return found
    wanted = list(states)
    return found.where(F.col("state").isin(*wanted) if wanted else F.lit(False))
