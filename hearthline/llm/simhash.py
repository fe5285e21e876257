"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in few bits agree on some pair of their blocks, so only those with an equal pair are compared. A
bucket's fingerprints stand as vertical bit planes, one bit of every fingerprint to a word row; comparing each with the one s
places further is then an exclusive-or of whole planes, and carry-save counters add up the differing bits of many pairs at
once. Words of pairs that have all gone over the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_and_text, map_arrow, ship, staged
from .graph import components

#: Fingerprints of one bucket that are compared in one piece; larger buckets are cut into pieces, and all pairs of pieces compared.
PIECE = 1024
#: Shingles whose bits are counted at a time.
SLICE = 1 << 14
#: Edges kept before they are reduced to a forest.
MOST_EDGES = 1 << 20
#: Lanes compared at a time, at least one whole bucket.
LANES = 1 << 16

_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of `size` words (repeats included); 0 for a null text or one without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < size:
        return _digest(b" ".join(found))
    shingles = zip(*(found[k:] for k in range(size)), strict=False)
    hashes = np.fromiter(map(_digest, map(b" ".join, shingles)), np.uint64, len(found) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash (of the exact text) and fp (the fingerprint's 64 bits as a bigint) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return map_arrow(id_and_text(docs, F.xxhash64("text").alias("text_hash")), run, "doc_id bigint, text_hash bigint, fp bigint")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of bits, one bit for each fingerprint, packed into 64-bit words, with a word of zeros behind."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = -(-len(fps) // 64) + 1
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _over(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def shifted_pairs(rows: np.ndarray, run: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Lanes i whose fingerprint is within the radius of lane i + shift's, both in one run."""
    n = len(run) - shift
    words = -(-n // 64)
    skip, rest = divmod(shift, 64)
    alive = _packed(run[:n] == run[shift:], words)
    keep = np.arange(words)
    counters = [np.zeros(words, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(words, np.uint64)
    for b in range(64):
        row = rows[b]
        here, there = row[keep], row[keep + skip]
        if rest:
            there = (there >> np.uint64(rest)) | (row[np.minimum(keep + skip + 1, len(row) - 1)] << np.uint64(64 - rest))
        carry = here ^ there
        for c in counters:
            c_and = c & carry
            c ^= carry
            carry = c_and
        over |= carry
        if b % 8 == 7:
            alive &= ~_over(counters, over, radius)
            some = np.flatnonzero(alive)
            if len(some) == 0:
                return some
            if len(some) <= len(keep) // 2:  # abandon the words whose pairs are all over
                keep, alive, over, counters = keep[some], alive[some], over[some], [c[some] for c in counters]
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(keep), 64)
    word, bit = np.nonzero(bits)
    return keep[word] * 64 + bit


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least lane each lane is connected to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(before, label):
            return label


def links(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs of one run within the radius: (fingerprint, root). Runs must stand in falling order of size."""
    rows = planes(fps)
    sizes = np.bincount(run)
    ends = np.cumsum(sizes)
    a, b, kept = [], [], 0
    for shift in range(1, int(sizes.max(initial=0))):
        active = ends[np.searchsorted(-sizes, -shift, "left") - 1]  # lanes of the runs larger than the shift
        i = shifted_pairs(rows, run[:active], shift, radius)
        if len(i):
            a.append(i)
            b.append(i + shift)
            kept += len(i)
        if kept > MOST_EDGES:
            label = _forest(len(fps), np.concatenate(a), np.concatenate(b))
            i = np.flatnonzero(label != np.arange(len(fps)))
            a, b, kept = [i], [label[i]], len(i)
    if not a:
        return fps[:0], fps[:0]
    label = _forest(len(fps), np.concatenate(a), np.concatenate(b))
    i = np.flatnonzero(label != np.arange(len(fps)))
    return fps[i], fps[label[i]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, second, fp) sorted by the first three: compares the fingerprints of each such group."""
    group, fps = np.zeros((3, 0), np.int64), np.zeros(0, np.uint64)

    def done(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        run = np.cumsum(np.r_[0, (group[:, 1:] != group[:, :-1]).any(0)]) if len(fps) else np.zeros(0, np.int64)
        sizes = np.bincount(run)
        order = np.argsort(-sizes[run], kind="stable")
        order = order[sizes[run][order] > 1]
        _, again = np.unique(run[order], return_index=True)
        rank = np.zeros(len(sizes), np.int64)
        rank[run[order][np.sort(again)]] = np.arange(len(again))
        u, v = links(fps[order], rank[run[order]], radius) if len(order) else (fps[:0], fps[:0])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        group = np.concatenate([group, np.stack(columns[:3])], axis=1)
        fps = np.concatenate([fps, columns[3].view(np.uint64)])
        if len(fps) >= LANES:
            changes = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0))
            if len(changes):
                cut = changes[-1] + 1
                yield done(group[:, :cut], fps[:cut])
                group, fps = group[:, cut:], fps[cut:]
    yield done(group, fps)


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (distinct, column fp) within `radius` differing bits of each other.

    With radius + 2 blocks, two such fingerprints agree on at least two blocks; each pair of blocks is a key. A key held by many
    fingerprints is cut into pieces of about PIECE by hash, and every pair of pieces is a group of its own: nothing is capped,
    and no group outgrows a task. A group yields a forest of its links, so the edges grow with its members, not their pairs.
    """
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    keys = [F.xxhash64(F.lit(n), part(i), part(j)) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    pieces = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / F.lit(PIECE)).alias("pieces"))
    own = keyed.join(pieces, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    grouped = own.select("key", "own", "fp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("other"))
    grouped = grouped.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "fp")
    ship(fps.sparkSession)
    return grouped.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second").mapInArrow(partial(_compare, radius=radius), "u bigint, v bigint")


def near_components(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, root (one fp that stands for the component) of every row.

    Null and blank texts have fingerprint 0 and are linked like any other; null doc_ids and repeated rows are rows like any
    other. Rows with equal fingerprints meet only in joins, where Spark splits a common one, so copies cost nothing but rows.
    """
    rows = staged(fingerprints(docs, size), "fingerprints")
    stars = components(near_links(rows.select("fp").distinct(), radius))
    return rows.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def label_near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of documents.

    component_id is the smallest doc_id of the rows reachable over links of at most `radius` differing bits, itself included
    (null where all of them are null). Other columns of the input are left out; an empty table gives an empty one.
    """
    rows = staged(fingerprints(docs, size).select("doc_id", "fp"), "fingerprints")
    stars = components(near_links(rows.select("fp").distinct(), radius)).select(F.col("u").alias("f"), F.col("v").alias("root"))
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("own"))  # equal fingerprints first: a component has far fewer of them
    own = staged(own.join(stars, F.col("fp") == F.col("f"), "left").select("fp", "own", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    component = own.groupBy("root").agg(F.min("own").alias("component_id"))
    # Joined on another form of the key, so that both sides are dealt anew: Spark splits a common key only between two fresh exchanges.
    component = component.select(F.bitwise_not("root").alias("k"), "component_id")
    by_fp = own.join(component, F.bitwise_not("root") == F.col("k")).select(F.bitwise_not("fp").alias("k"), "component_id")
    joined = rows.join(by_fp, F.bitwise_not("fp") == F.col("k"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """The rows of docs, all columns, with one row of each near-duplicate component: that of the smallest doc_id (a null one
    last; ties by the text's hash, and one of equal rows)."""
    return keep_first(docs, near_components(docs, radius, size))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that keep_one_of_each chooses; rows: doc_id, text_hash and root (of the component) of every row."""
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("c"))
    key, none, text_hash, row = fresh(docs, "kept_id", "kept_none", "kept_hash", "kept_row")
    chosen = chosen.select(F.coalesce("c.doc_id", F.lit(-1)).alias(key), F.col("c.none").alias(none), F.col("c.text_hash").alias(text_hash)).distinct()
    tagged = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), none: F.col("doc_id").isNull(), text_hash: F.xxhash64(F.col("text").cast("string"))})
    first = Window.partitionBy(key, none, text_hash).orderBy(key)
    return tagged.join(chosen, [key, none, text_hash]).withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).select(*docs.columns)
