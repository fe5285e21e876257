"""Substring dedup over a compacted De Bruijn graph of token k-mers.

Nodes of the graph are sampled k-mers: of each window of `window` words the least k-mer under a hash, so equal windows have equal
nodes in equal places and about one k-mer in eight is kept. Edges are the k-mers between two nodes that follow each other in a
text (its words from the one node to the end of the other; a text's head and tail are edges too), told apart by their words.
One aggregate counts each node and compares its pairs of in-edge and out-edge: a node seen more than once is repeated, and a
repeated one that has one in-edge and one out-edge wherever it stands doesn't branch.

Joining that back to the texts compacts the repeated nonbranching paths: every text that holds part of such a path holds all of
it, so its head is read off each text's own run of nodes, and the head names the path in all of them. A path is one row at each
of its coordinates, however long. Only windows at branching nodes, or that stick out of a path, are rows of their own. Whatever
has an earlier coordinate is a repeat; before anything is removed, the words of each maximal repeat are compared (by a
cryptographic digest) with the words at its source coordinate.

All this runs once for each distinct text; copies of a whole text take its result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, release, shared_dir, staged, unstage

#: Words of a k-mer; bytes of texts handled at a time (a longer text is handled alone, whole); bytes of a word hashed in steps of eight.
KMER, SLICE, LONG_WORD = 5, 1 << 19, 512
#: Bits of a coordinate that hold the place in a text; the others hold the text's rank.
PLACE = 28
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes
_LAST = (1 << 63) - 1
_HEAD, _TAIL, _PATH = (np.uint64(x) for x in (0x51, 0x7F, 0xA3))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of words, eight bytes a step, each step mixed before the next: no polynomial in the bytes."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = _mix(left.astype(np.uint64) + np.uint64(seed << 32))
    long = np.flatnonzero(left > LONG_WORD)
    live = np.flatnonzero(left <= LONG_WORD) if len(long) else np.arange(len(left))
    at, left = starts[live], left[live]
    while len(live):
        out[live] = _mix((out[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * _B + _A)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed=seed)
    return out


class Words:
    """The words of some texts, one text after another; offsets: where each text's begin (one more entry ends them)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        black = ~SPACE[data]
        before, after = np.r_[True, ~black[:-1]], np.r_[~black[1:], True]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.data, self.starts, self.ends = data, np.flatnonzero(black & before), np.flatnonzero(black & after) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.levels: dict[int, list[np.ndarray]] = {}

    @property
    def text_ends(self) -> np.ndarray:
        """For each word the end of its text."""
        return np.repeat(self.offsets[1:], np.diff(self.offsets))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def _level(self, k: int, seed: int) -> np.ndarray:
        """Hashes of the 2^k words from each word on, made of two of half as many."""
        found = self.levels.setdefault(seed, [])
        if not found:
            found.append(_word_hashes(self.data, self.starts, self.ends, seed))
        while len(found) <= k:
            low, step = found[-1], 1 << (len(found) - 1)
            found.append(_mix(low * _A + np.r_[low[step:], low[: min(step, len(low))]] * _B + np.uint64(len(found))))
        return found[k]

    def hashes(self, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
        """Hashes of spans of words: of two runs of 2^k words, which together cover each span."""
        out = np.zeros(len(starts), np.uint64)
        level = np.frexp(lengths.astype(float))[1] - 1
        for k in np.unique(level).tolist():
            one = level == k
            s, n, low = starts[one], lengths[one], self._level(k, seed)
            out[one] = _mix(low[s] * _A + low[s + n - (1 << k)] * _B + n.astype(np.uint64))
        return out


def slices(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for some rows at a time; a null text has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


class Graph(NamedTuple):
    """What some texts have of the graph. windows: starts of all windows; node_of: each window's, as an index into places;
    places: of the node occurrences, rising; nodes: their hashes; text: their texts; left, right: where the in-edge of each begins
    and its out-edge ends."""

    windows: np.ndarray
    node_of: np.ndarray
    places: np.ndarray
    nodes: np.ndarray
    text: np.ndarray
    left: np.ndarray
    right: np.ndarray


def graph_of(found: Words, window: int, seed: int) -> Graph:
    n = int(found.offsets[-1])
    windows = np.flatnonzero(np.arange(n) + window <= found.text_ends)
    if len(windows) == 0:
        return Graph(windows, windows, windows, np.zeros(0, np.uint64), windows, windows, windows)
    at = np.arange(n - KMER + 1)
    kmers = found.hashes(at, np.full(len(at), KMER), seed)
    least, place, width, want = kmers, at, 1, window - KMER + 1
    while width < want:  # the first least k-mer of `width` neighbours, by doubling
        step = min(width, want - width)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    places, node_of = np.unique(place[windows], return_inverse=True)
    text = found.text_of(places)
    same = text[1:] == text[:-1]
    left, right = found.offsets[text].copy(), found.offsets[text + 1].copy()
    left[1:][same] = places[:-1][same]
    right[:-1][same] = places[1:][same] + KMER
    return Graph(windows, node_of, places, kmers[places], text, left, right)


def contexts(found: Words, g: Graph, seed: int) -> np.ndarray:
    """For each node occurrence a hash of its in-edge and its out-edge."""
    if len(g.places) == 0:
        return g.nodes
    edge_in = found.hashes(g.left, g.places + KMER - g.left, seed) ^ np.where(g.left == found.offsets[g.text], _HEAD, np.uint64(0))
    edge_out = found.hashes(g.places, g.right - g.places, seed) ^ np.where(g.right == found.offsets[g.text + 1], _TAIL, np.uint64(0))
    return _mix(edge_in * _A + edge_out * _B)


def _columns(parts: list[tuple[np.ndarray, ...]], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)) for k, t in enumerate(types)], names)


def node_rows(batch: pa.RecordBatch, window: int, seed: int) -> pa.RecordBatch:
    """(tid, text) -> (node, context): each pair once, or twice if the batch has it more often, so no common node outgrows the rest."""
    nodes, around = [], []
    for _, _, found in slices(batch.column(1)):
        g = graph_of(found, window, seed)
        nodes.append(g.nodes)
        around.append(contexts(found, g, seed))
    node, context = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (nodes, around))
    order = np.lexsort((context, node))
    node, context = node[order], context[order]
    third = (node[2:] == node[:-2]) & (context[2:] == context[:-2])
    keep = np.r_[np.ones(min(2, len(node)), bool), ~third]
    return _columns([(node[keep], context[keep])], ["node", "context"], [np.int64] * 2)


def text_nodes(batch: pa.RecordBatch, window: int, seed: int) -> pa.RecordBatch:
    """(tid, text) -> (node, tid): the distinct nodes of each text."""
    tids = batch.column(0).to_numpy(zero_copy_only=False)
    parts = []
    for i, _, found in slices(batch.column(1)):
        g = graph_of(found, window, seed)
        node, tid = g.nodes.view(np.int64), tids[i + g.text]
        order = np.lexsort((node, g.text))
        node, tid, text = node[order], tid[order], g.text[order]
        first = np.r_[True, (node[1:] != node[:-1]) | (text[1:] != text[:-1])] if len(node) else np.zeros(0, bool)
        parts.append((node[first], tid[first]))
    return _columns(parts, ["node", "tid"], [np.int64] * 2)


def _members(column: pa.Array, i: int, j: int) -> np.ndarray:
    """Values in the list column's rows i to j."""
    return column.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def span_rows(batch: pa.RecordBatch, window: int, seed: int) -> pa.RecordBatch:
    """(tid, text, rank, straight and branching nodes) -> (h1, h2, place, n): the paths, and the windows that are in none."""
    ranks = batch.column(2).to_numpy(zero_copy_only=False)
    parts = []
    for i, j, found in slices(batch.column(1)):
        g = graph_of(found, window, seed)
        if len(g.places) == 0:
            continue
        straight, fork = (np.isin(g.nodes, _members(batch.column(k), i, j)) for k in (3, 4))
        follows = np.r_[False, straight[:-1] & straight[1:] & (g.text[1:] == g.text[:-1])]
        heads = np.flatnonzero(straight & ~follows)
        path_of = np.cumsum(straight & ~follows) - 1  # of straight nodes
        lasts = np.flatnonzero(straight & ~np.r_[follows[1:], False])
        begin, end = g.left[heads], g.right[lasts]
        of = g.node_of
        inside = straight[of].copy()
        on = np.flatnonzero(inside)
        path = path_of[of[on]]
        inside[on] = (g.windows[on] >= begin[path]) & (g.windows[on] + window <= end[path])
        alone = g.windows[(straight[of] | fork[of]) & ~inside]
        long = end - begin >= window
        heads, begin, end = heads[long], begin[long], end[long]
        width = np.full(len(alone), window)
        h1 = np.r_[_mix(g.nodes[heads] ^ _PATH), found.hashes(alone, width, seed + 1)]
        h2 = np.r_[contexts(found, g, seed)[heads], found.hashes(alone, width, seed + 2)]
        at = np.r_[begin, alone]
        text = found.text_of(at)
        if len(at) and int((at - found.offsets[text]).max()) >= 1 << PLACE:
            raise ValueError(f"a text of more than 2^{PLACE} words")
        place = (ranks[i + text] << PLACE) | (at - found.offsets[text])
        parts.append((h1.view(np.int64), h2.view(np.int64), place, np.r_[end - begin, width].astype(np.int32)))
    return _columns(parts, ["h1", "h2", "place", "n"], [np.int64, np.int64, np.int64, np.int32])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def merged(claims: list[dict]) -> list[tuple[int, int, int]]:
    """(start, end, source of the start) of maximal repeats: claims that overlap and have one source."""
    out: list[list[int]] = []
    for at, n, source in sorted((c["at"], c["n"], c["source"]) for c in claims):
        if out and at <= out[-1][1] and source - at == out[-1][2] - out[-1][0]:
            out[-1][1] = max(out[-1][1], at + n)
        else:
            out.append([at, at + n, source])
    return [tuple(x) for x in out]


RESULT = "tid bigint, first bigint, n_words bigint, n_removed bigint, kept_sha256 string, claims array<struct<n:int,source:bigint,digest:binary>>"


def result_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(tid, text, first, claims) -> rows of RESULT: what stays of each text, and which source each repeat must equal."""
    n_words, n_removed, kept_hash, held = [], [], [], []
    for text, claims in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
        found = (text or "").encode().split()
        repeats = merged(claims or [])
        kept, at = [], 0
        for start, end, _ in repeats:  # by rising start
            kept += found[at:start] if start > at else []
            at = max(at, end)
        kept += found[at:]
        n_words.append(len(found))
        n_removed.append(len(found) - len(kept))
        kept_hash.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        held.append([{"n": end - start, "source": source, "digest": _digest(found[start:end])} for start, end, source in repeats])
    kinds = pa.list_(pa.struct([("n", pa.int32()), ("source", pa.int64()), ("digest", pa.binary())]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_hash, pa.string()), pa.array(held, kinds)], ["tid", "first", "n_words", "n_removed", "kept_sha256", "claims"])


def source_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(tid, text, rank, spans) -> (source, n, digest): the words that stand at source coordinates."""
    out: list[tuple[int, int, bytes]] = []
    for text, rank, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
        found = (text or "").encode().split()
        out += [(rank << PLACE | s["at"], s["n"], _digest(found[s["at"] : s["at"] + s["n"]])) for s in spans]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["source", "n", "digest"])


class Texts:
    """The distinct texts, bucketed by their id in the shared folder, so that later joins bring only small rows to them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # as many as the aggregate's, so a task writes whole buckets
        self.name = f"hearthline_texts_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/hearthline/{self.name}"
        each = rows.groupBy("tid").agg(F.min("doc").alias("first"), F.min("check").alias("check"), F.max("check").alias("other"), F.first("text").alias("text"))
        each.write.bucketBy(buckets, "tid").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        ordered = self.table.select("tid", "first").repartitionByRange("first", "tid").sortWithinPartitions("first", "tid")
        places = staged(ordered.select("tid", "first", F.monotonically_increasing_id().alias("id")), "text-order")
        part, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        most = places.agg(F.max(part).alias("part"), F.max(row).alias("row")).first()
        bits = (most["row"] or 0).bit_length()
        if bits + (most["part"] or 0).bit_length() > 63 - PLACE:
            raise ValueError(f"more distinct texts than {63 - PLACE} bits can number")
        #: tid, first (smallest doc_id) and rank (in the order of first, then tid) of each.
        self.places = places
        self.ranked = places.select("tid", "first", F.shiftleft(part, bits).bitwiseOR(row).alias("rank"))

    def collided(self) -> bool:
        """Whether two different texts have one id."""
        return not self.table.where("check <> other").isEmpty()

    def joined(self, more: DataFrame, how: str = "inner") -> DataFrame:
        return self.table.select("tid", "text").join(more.hint("shuffle_hash"), "tid", how)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)
        unstage(self.places)


def _results(texts: Texts, window: int, seed: int) -> DataFrame:
    each = texts.table.select("tid", "text")
    nodes = map_arrow(each, lambda b: node_rows(b, window, seed), "node bigint, context bigint").repartition("node")
    nodes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1").select("node", F.expr("a = b").alias("straight"))
    # Joined on another form of the key, so that both sides are dealt anew: Spark splits a common key only between two fresh exchanges.
    own = map_arrow(each, lambda b: text_nodes(b, window, seed), "node bigint, tid bigint")
    flagged = own.select("node", "tid", F.bitwise_not("node").alias("k")).join(nodes.select(F.bitwise_not("node").alias("k"), "straight"), "k")
    flagged = flagged.groupBy("tid").agg(F.collect_set(F.when(F.col("straight"), F.col("node"))).alias("straight"), F.collect_set(F.when(~F.col("straight"), F.col("node"))).alias("branching"))
    flagged = staged(flagged.join(texts.ranked, "tid").select("tid", "rank", "straight", "branching"), "repeated-nodes")
    release(texts.spark)
    spans = map_arrow(texts.joined(flagged).select("tid", "text", "rank", "straight", "branching"), lambda b: span_rows(b, window, seed), "h1 bigint, h2 bigint, place bigint, n int")
    least = spans.groupBy("h1", "h2").agg(F.min("place").alias("source"), F.max("place").alias("last")).where("source < last").select(F.bitwise_not("h1").alias("k"), "h2", "source")
    later = spans.select(F.bitwise_not("h1").alias("k"), "h2", "place", "n").join(least, ["k", "h2"]).where("source < place")
    claim = F.struct(F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("at"), "n", "source")
    claims = later.groupBy(F.shiftright("place", PLACE).alias("rank")).agg(F.collect_set(claim).alias("claims"))
    claims = staged(texts.ranked.join(claims, "rank", "left").select("tid", "first", "claims"), "repeats")
    release(texts.spark)
    results = staged(map_arrow(texts.joined(claims).select("tid", "text", "first", "claims"), result_rows, RESULT), "kept-words")
    unstage(flagged, claims)
    return results


def _all_verified(texts: Texts, results: DataFrame) -> bool:
    """Whether the words of every repeat are those at its source coordinate."""
    claims = results.select(F.inline("claims"))
    spans = claims.select("source", "n").distinct().groupBy(F.shiftright("source", PLACE).alias("rank"))
    spans = spans.agg(F.collect_list(F.struct(F.col("source").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("at"), "n")).alias("spans"))
    there = texts.joined(spans.join(texts.ranked, "rank").select("tid", "rank", "spans")).select("tid", "text", "rank", "spans")
    there = map_arrow(there, source_rows, "source bigint, n int, digest binary")
    return claims.join(there, ["source", "n", "digest"], "left_anti").isEmpty()


def remove_repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, with each word gone that an earlier repeated window covers.

    A window of `window` words is removed where the same words also start earlier: in a row of smaller doc_id, or earlier in
    the same row; windows are judged on the input. Null doc_ids come last; rows of one doc_id (or of none) with different texts
    are different documents, in the order of their texts' hashes, and equal rows are one document, each with its result. Null
    and blank texts, and those of fewer than `window` words, lose nothing. Other columns are left out.

    Shuffled are: each distinct text once, two hashes for each of its nodes, twice, and coordinates of repeated paths and of
    windows at branches. A common text is reduced to one before the shuffle, a common node to two rows a batch of texts; common
    contents are reduced to their least coordinate and met again in joins that Spark splits where a key is common. Hashes only
    propose: were a repeat's words not those at its source, all would be done again with other hashes.
    """
    if window <= KMER:
        raise ValueError(f"a window has more than {KMER} words")
    for seed in (11, 23, 47):
        whole = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), whole).alias("tid"), F.xxhash64(F.lit(seed + 1), whole).alias("check"))
        texts = Texts(rows.select("doc", "text", "tid", "check"))
        try:
            if texts.collided():
                continue
            results = _results(texts, window, seed)
            if not _all_verified(texts, results):
                continue
        finally:
            texts.drop()
        results = results.withColumnRenamed("tid", "text_id").drop("claims")
        joined = rows.select("doc_id", "doc", "tid").join(results, F.col("tid") == F.col("text_id"))
        copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
        return joined.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    raise RuntimeError("three families of hashes collided")


#: The same in DuckDB's SQL over documents with distinct doc_ids, with windows of 20 words.
REPEATS_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
flat AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM split),
windows AS (SELECT doc_id, pos, string_agg(word, ' ') OVER w AS content, count(*) OVER w AS n FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
repeated AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) > 1 AS again FROM windows WHERE n = 20),
covered AS (SELECT f.doc_id, f.pos, f.word, coalesce(bool_or(r.again) OVER (PARTITION BY f.doc_id ORDER BY f.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM flat f LEFT JOIN repeated r ON r.doc_id = f.doc_id AND r.pos = f.pos),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS words FROM covered GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256 FROM split s LEFT JOIN kept USING (doc_id)
"""
