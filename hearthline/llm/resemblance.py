"""Near-duplicates by exact resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are, first, texts that operator 6 links: SimHash fingerprints within two bits of each other. At a similarity of 0.8 most
fingerprints differ in more bits than block keys reach, so texts with an equal band of minimum hashes come besides (BANDS bands of ROWS
minima: a pair at exactly 0.8 is passed over by them with a probability of 7e-5, a closer one more rarely). Every link is checked on the
two whole texts. A band's texts are first compared
with its least one only, and what that links counts as one. Where a band still holds several components, the texts outside its
largest one are compared with all others: in pieces, by counting common shingles over inverted lists, so that a task holds two
pieces and passes on a forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, release, ship, staged
from .graph import components
from .simhash import fingerprints, keep_first, near_links

#: Words of a shingle; similarity of a link; bands, and minima of a band.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 24, 5
#: Shingles hashed at a time.
SLICE = 1 << 13
#: Texts of a band that are compared in one piece.
PIECE = 512
#: Texts whose hashes are broadcast at most, to look up their words.
MAX_KEYS = 200_000

_random = np.random.default_rng(5)
_FACTORS = _random.integers(0, 2**63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 2**63, (BANDS * ROWS, 1)).astype(np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words has none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(each) - size + 1)
    out = np.full(n, len(found) if len(found) < size else size, np.uint64)
    for k in range(min(size, len(each))):
        out = (out ^ each[k : k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two results of shingles; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of the minima of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        least = np.minimum(least, (found[at : at + SLICE] * _FACTORS + _TERMS).min(1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), seed=k) for k in range(BANDS)]


def _keyed(docs: DataFrame) -> DataFrame:
    """node (hash of the exact text) and key of every band of every distinct text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.array([bands(shingles(x.as_py())) for x in batch.column(0)], np.uint64).reshape(batch.num_rows * BANDS)
        nodes = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.view(np.int64))], ["node", "key"])

    return map_arrow(docs.select("text", F.col("text_hash").alias("node")), run, "node bigint, key bigint").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) of text hashes whose texts resemble each other."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("text_hash")).distinct()
    needed = F.broadcast(needed) if needed.count() <= MAX_KEYS else needed
    texts = staged(docs.select("text", "text_hash").join(needed, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text")), "texts")
    left, right = texts.select(F.col("text_hash").alias("u"), F.col("text").alias("a")), texts.select(F.col("text_hash").alias("v"), F.col("text").alias("b"))
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resemblance(shingles(x), shingles(y)) >= least for x, y in zip(a, b, strict=True)], dtype="bool")

    return pairs.join(left, "u").join(right, "v").where(near("a", "b")).select("u", "v")


def common_links(sets: list[np.ndarray], comp: np.ndarray, asks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A forest over components (component, component) of the sets that are similar across them; one of a pair at least asks."""
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, lists = flat[order], owner[order]
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for k in np.flatnonzero(asks).tolist():
        begin, end = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        each = end - begin
        at = np.repeat(begin - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum()) if len(each) else np.zeros(0, np.int64)
        both = np.bincount(lists[at], minlength=len(sets))
        near = both >= least * (sizes + sizes[k] - both)  # two empty sets are near, too
        for c in np.unique(comp[near & (comp != comp[k])]).tolist():
            x, y = find(comp[k].item()), find(c)
            root[max(x, y)] = min(x, y)
    return [(c, find(c)) for c in root if find(c) != c]


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, second, comp, asks, shingles) sorted by the first three: links of components in each such group."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        sets = [np.asarray(x.values, np.int64).view(np.uint64) for x in rows.column(5)]
        found = common_links(sets, rows.column(3).to_numpy(), rows.column(4).to_numpy(), least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        group = np.stack([c.to_numpy() for c in held.columns[:3]])
        ends = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
        for i, j in zip([0, *ends[:-1]], ends, strict=False):
            yield done(held.slice(i, j - i))
        held = held.slice(ends[-1]) if len(ends) else held
    if held is not None and len(held):
        yield done(held)


def _across(docs: DataFrame, open_: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of components between similar texts of one band. docs: text, text_hash; open_: key, node, comp of every band with several components."""
    sizes = open_.groupBy("key", "comp").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("most"), F.sum("count").alias("all")).select("key", F.col("most.comp").alias("main"), F.ceil(F.col("most.count") / PIECE).alias("mains"), F.ceil((F.col("all") - F.col("most.count")) / PIECE).alias("others"))
    main = staged(main, "open-sizes")  # a row a band
    main = F.broadcast(main) if main.count() <= MAX_KEYS else main
    rows = open_.join(main, "key").withColumn("asks", F.col("comp") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("others")).otherwise(F.col("mains")))
    rows = rows.withColumn("own", own)
    # Pieces of the largest component are numbered from -1 down, and meet only the other pieces.
    others = F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)
    mains = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("mains")), lambda x: -x)
    rows = rows.withColumn("own", F.when(F.col("asks"), F.col("own")).otherwise(-1 - F.col("own"))).withColumn("other", F.explode(F.when(F.col("asks"), F.concat(others, mains)).otherwise(others)))
    rows = rows.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "comp", "asks", "node")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([shingles(x.as_py()).view(np.int64) for x in batch.column(0)], pa.list_(pa.int64()))], ["text_hash", "shingles"])

    needed = open_.select(F.col("node").alias("text_hash")).distinct()
    needed = F.broadcast(needed) if needed.count() <= MAX_KEYS else needed
    texts = docs.select("text", "text_hash").join(needed, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    held = staged(map_arrow(texts.select("text", "text_hash"), sets, "text_hash bigint, shingles array<bigint>"), "shingles")
    grouped = rows.join(held, F.col("node") == F.col("text_hash")).select("key", "first", "second", "comp", "asks", "shingles")
    return grouped.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second").mapInArrow(partial(_compare, least=least), "u bigint, v bigint")


def fingerprint_pairs(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """Pairs (u, v) of text hashes, as many as texts at most for each block key, that connect all texts whose SimHash fingerprints are linked
    by operator 6. docs: doc_id, text."""
    prints = staged(fingerprints(docs, size).select("text_hash", "fp").distinct(), "fingerprints")
    hubs = staged(prints.groupBy("fp").agg(F.min("text_hash").alias("hub")), "fingerprint-hubs")
    # On another form of the key, so that both sides are dealt anew and Spark can split a fingerprint that many texts have.
    equal = prints.join(hubs.select(F.bitwise_not("fp").alias("k"), "hub"), F.bitwise_not("fp") == F.col("k")).where("text_hash <> hub").select(F.col("hub").alias("u"), F.col("text_hash").alias("v"))
    first, second = hubs.select(F.col("fp").alias("u"), F.col("hub").alias("a")), hubs.select(F.col("fp").alias("v"), F.col("hub").alias("b"))
    near = near_links(hubs.select("fp"), radius).join(first, "u").join(second, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return equal.unionByName(near)


def resemblance_links(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v): for each text hash that is linked, the least one of its component. docs: doc_id, text, text_hash."""
    keyed = _keyed(docs)
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub")).where("m > 1").select(F.bitwise_not("key").alias("k"), "hub")
    keyed = staged(keyed.select("node", "key", F.bitwise_not("key").alias("k")).join(shared, "k").select("node", "key", "hub"), "shared-bands")
    release(docs.sparkSession)
    pairs = keyed.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    pairs = pairs.unionByName(fingerprint_pairs(docs)).distinct()
    stars = components(_verified(docs, staged(pairs, "pairs"), least))
    label = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labelled = keyed.drop("hub").join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    several = staged(labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select(F.bitwise_not("key").alias("k")), "open-keys")
    several = F.broadcast(several) if several.count() <= MAX_KEYS else several
    open_ = staged(labelled.join(several, F.bitwise_not("key") == F.col("k")).drop("k"), "open-bands")
    release(docs.sparkSession)
    more = components(_across(docs, open_, least)).select(F.col("u").alias("root"), F.col("v").alias("least"))
    release(docs.sparkSession)
    nodes = label.unionByName(more.select(F.col("root").alias("node"), "root")).distinct()  # a root stands for itself
    return nodes.join(more, "root", "left").select(F.col("node").alias("u"), F.coalesce("least", "root").alias("v"))


def keep_one_of_resembling(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, with one row of each component of resembling texts, chosen as in keep_one_of_each.

    Texts are split at white space and compared without case of ASCII letters. Null and blank texts resemble each other and
    nothing else; null doc_ids and repeated rows are rows like any other.
    """
    rows = id_and_text(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    stars = resemblance_links(rows, least).select(F.col("u").alias("text_hash"), F.col("v").alias("root"))
    return keep_first(docs, rows.drop("text").join(stars, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash")))
