"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order of its nearest pivots and posted in the inverted files of the first `post` of them. A
query goes to the files of its own first `probe` pivots; there the footrule distance of the orders ranks what is posted, and what
ranks as well as the best `share` of a sample of all vectors (and the best k + 1 of a file in any case) is ranked by true distance.

Pivots come from a bounded sample; every vector is indexed. The number of pivots grows with the square root of the table, and
beyond as fast as keeps a file at about FILE vectors (MOST_SAMPLE at most), so the share of the table that a query visits falls as the table grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, staged

#: Pivots for each square root of the number of vectors.
DENSITY = 8
#: Vectors that pivots are drawn from at least and at most; of these, the ones whose orders tell what share a footrule distance is.
LEAST_SAMPLE, MOST_SAMPLE, GAUGE = 4096, 16_384, 2048
#: Lengths of vectors that have pivots, the commonest first; the vectors of any other length are one file, compared in pieces.
LENGTHS = 16


class Index(NamedTuple):
    """pivots: how many at least; prefix: how many of a vector's nearest pivots its order holds; post, probe: in how many files a
    vector is posted, and how many a query visits; share: how much of all vectors is to be ranked by true distance, about; file:
    vectors of a file, about (a larger one is cut into pieces, each of which its queries visit)."""

    pivots: int = 256
    prefix: int = 64
    post: int = 4
    probe: int = 160
    share: float = 0.2
    file: int = 16_384


class Pivots(NamedTuple):
    """Of one length of vectors: the pivots, and the orders of some sampled vectors."""

    at: np.ndarray
    gauge: np.ndarray


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero (an empty one is zero)."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def orders(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, nearest first, ties to the first pivot."""
    near = (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :n].astype(np.int32)


def shared(order: np.ndarray, posted: np.ndarray, pivots: int) -> np.ndarray:
    """How near the posted orders are to one: a pivot that both have counts prefix - the later of its two places.

    With a pivot that an order lacks put in the place after its last, the footrule distance is a constant less twice this.
    """
    prefix = len(order)
    place = np.full(pivots, prefix, np.int32)
    place[order] = np.arange(prefix)
    return (prefix - np.maximum(place[posted], np.arange(prefix)[None])).sum(1)


def how_many(count: int, index: Index) -> int:
    """Pivots for so many vectors: more for more of them, so that a query's files hold ever less of the table, and at least as many as keep
    a file at its size."""
    return max(index.pivots, math.ceil(DENSITY * math.sqrt(count)), math.ceil(count * index.post / index.file))


def draw(vectors: DataFrame, n: int, count: int, index: Index) -> Pivots:
    """Pivots of the vectors of length n: the first, by a hash of the value, of a bounded sample."""
    most = min(MOST_SAMPLE, how_many(count, index))
    size = max(LEAST_SAMPLE, most)
    low = F.col("v1") < -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * size // max(1, count))  # some four times as many, not each task's first
    rows = vectors.where((F.col("n") == n) & low).orderBy("v1", "v2").limit(size).select("vector").collect()
    found = np.array([r["vector"] for r in rows], np.float64)  # distinct, and v1 is a hash
    at = found[:most]
    return Pivots(at, orders(found[:GAUGE], at, min(index.prefix, len(at))))


def search(embeddings: DataFrame, k: int = 10, every: int = 100, index: Index | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of every query, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all other rows with vectors of the same length.
    score is the Euclidean distance in double precision between the vectors as given. Rows with a null vec_id, and vectors that
    are null, zero, or hold null or non-finite components take no part. Rows equal in vec_id and vector are one row; a vec_id with
    several vectors is that many rows, and as many queries under one query_id. Other columns are left out.

    Equal vectors are indexed once, with the k + 1 smallest of their vec_ids (no query can need more), and asked once. Vectors are
    shuffled once for each file they are posted in, queries once for each file they visit.
    """
    index = index or Index()
    spark = embeddings.sparkSession
    ship(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    kind = embeddings.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(kind, T.FloatType) else F.col("embedding").cast("array<double>")
    own = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    own = own.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind if isinstance(kind, T.FloatType) else "double")))  # -0.0 is 0.0
    keyed = own.select("vec_id", F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2"), "vector")
    ids = staged(keyed.select("v1", "v2", "vec_id").distinct(), "vector-ids")
    order = F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))
    first = ids.withColumn("r", order).where(F.col("r") <= k + 1).groupBy("v1", "v2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = keyed.groupBy("v1", "v2").agg(F.first("vector").alias("vector"))
    vectors = staged(vectors.join(first, ["v1", "v2"]).select("v1", "v2", F.size("vector").alias("n"), "vector", "ids"), "vectors")
    counts = {r["n"]: r["count"] for r in vectors.groupBy("n").count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()}
    if not counts:
        return spark.createDataFrame([], schema)
    pivots = spark.sparkContext.broadcast({n: draw(vectors, n, c, index) for n, c in counts.items()})
    asks = ids.where(F.col("vec_id") % every == 0)

    def post(batches: Iterator[pa.RecordBatch], queries: bool) -> Iterator[pa.RecordBatch]:
        """A row for each file: (n, pivot, v1, v2, vector, and ids or cut)."""
        for batch in batches:
            length = batch.column(2).to_numpy()
            for n in np.unique(length).tolist():
                rows = batch.filter(pa.array(length == n))
                p = pivots.value.get(n)
                flat = rows.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                far = max(index.prefix, index.probe) if queries else index.prefix
                found = orders(flat.reshape(rows.num_rows, n), p.at, min(far, len(p.at))) if p else np.zeros((rows.num_rows, 1), np.int32)
                files = found[:, : index.probe if queries else index.post]
                again = pa.array(np.repeat(np.arange(rows.num_rows), files.shape[1]))
                out = rows.take(again)
                last = out.column(4)
                if queries:
                    best = [np.sort(shared(o, p.gauge, len(p.at)))[-max(1, math.ceil(index.share * len(p.gauge)))] for o in found[:, : index.prefix]] if p else [0] * rows.num_rows
                    last = pa.array(best, pa.int64()).take(again)
                yield pa.RecordBatch.from_arrays([out.column(2), pa.array(files.ravel()), out.column(0), out.column(1), out.column(3), last], ["n", "pivot", "v1", "v2", "vector", "cut" if queries else "ids"])

    shape = f"n int, pivot int, v1 bigint, v2 bigint, vector {vectors.schema['vector'].dataType.simpleString()}"
    columns = ["v1", "v2", "n", "vector"]
    posted = staged(vectors.select(*columns, "ids").mapInArrow(lambda b: post(b, False), shape + ", ids array<bigint>"), "postings")
    asked = vectors.join(asks.select("v1", "v2").distinct(), ["v1", "v2"]).select(*columns, F.lit(0).alias("cut"))
    asked = asked.mapInArrow(lambda b: post(b, True), shape + ", cut bigint")
    pieces = posted.groupBy("n", "pivot").agg(F.ceil(F.count("*") / index.file).cast("int").alias("pieces"))  # a row a file
    posted = posted.join(pieces, ["n", "pivot"]).withColumn("piece", F.pmod(F.xxhash64("v1"), F.col("pieces")).cast("int")).drop("pieces")
    asked = asked.join(pieces, ["n", "pivot"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    def answer(queries: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int, float]] = []
        if len(queries) and len(file):
            p = pivots.value.get(int(file["n"].iloc[0]))
            x = np.stack(file["vector"].to_numpy()).astype(np.float64)
            v1, v2, owners = file["v1"].to_numpy(), file["v2"].to_numpy(), file["ids"].to_numpy()
            prefix = min(index.prefix, len(p.at)) if p else 0
            held = orders(x, p.at, prefix) if p else None
            y = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            theirs = orders(y, p.at, prefix) if p else [None] * len(y)
            for q1, q2, cut, vector, order in zip(queries["v1"], queries["v2"], queries["cut"], y, theirs, strict=True):
                near = np.arange(len(x))
                if p and len(x) > k + 1:
                    found = shared(order, held, len(p.at))
                    least = min(int(cut), int(np.partition(found, -k - 1)[-k - 1]))
                    near = np.flatnonzero(found >= least)
                score = np.sqrt(((x[near] - vector) ** 2).sum(1))
                close = np.flatnonzero(score <= np.partition(score, k)[k]) if len(score) > k + 1 else np.arange(len(score))
                best = sorted((float(score[c]), int(i), int(near[c])) for c in close for i in owners[near[c]])[: k + 1]
                out += [(q1, q2, i, int(v1[c]), int(v2[c]), s) for s, i, c in best]
        return pd.DataFrame(out, columns=["q1", "q2", "vec_id", "v1", "v2", "score"])

    keys = ("n", "pivot", "piece")
    found = asked.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(answer, "q1 bigint, q2 bigint, vec_id bigint, v1 bigint, v2 bigint, score double").distinct()
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))
    found = found.withColumn("r", best).where(F.col("r") <= k + 1)  # one more than asked for: the query itself
    queries = asks.select(F.col("v1").alias("q1"), F.col("v2").alias("q2"), F.col("vec_id").alias("query_id"))
    found = found.join(queries, ["q1", "q2"]).where(~((F.col("vec_id") == F.col("query_id")) & (F.col("v1") == F.col("q1")) & (F.col("v2") == F.col("q2"))))
    place = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
