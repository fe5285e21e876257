"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in chunks with each dictionary. The difference of the two sizes over the text's length says which class it
resembles; a logistic calibration of that difference alone turns it into a probability of the good label.

Learning takes a bounded sample: at most `sample` labelled rows of each label, the first by a hash of doc_id, of which one half
gives the dictionaries and the other the calibration. Scoring covers every whole text.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, map_arrow, ship, staged

#: Labelled rows of each label to learn from, at most; bytes of a chunk; of a dictionary; of a dictionary's samples, and how many a row gives.
SAMPLE, CHUNK, DICTIONARY, PIECE, PIECES = 4000, 2048, 112_640, 512, 8
SEED = 7


class Model(NamedTuple):
    """A fitted classifier: two dictionaries, whatever the corpus. The log-odds of label 1 are intercept + slope x difference."""

    good: bytes
    bad: bytes
    intercept: float
    slope: float
    prior: float


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 modulo 4 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    trained = content[:4] == b"\x37\xa4\x30\xec"  # the format's mark of a trained dictionary
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class Difference:
    """(size with the bad dictionary - size with the good one) / bytes, over all chunks of a text."""

    def __init__(self, good: bytes, bad: bytes):
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=_dictionary(x), **options) if x else zstandard.ZstdCompressor(**options) for x in (good, bad))

    def of(self, text: bytes) -> float:
        chunks = [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]
        return sum(len(self.bad.compress(c)) - len(self.good.compress(c)) for c in chunks) / len(text)


def fit_dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the bare pieces where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of a logistic regression, by Newton's method on the standardised feature."""
    mean, scale = x.mean(), x.std() + 1e-9
    a, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels.quality of rows that aren't held out; ids with null or contradictory labels are passed over.

    With no row of one label the model knows only the share of label 1 (no row at all: 0.5).
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").where(~held_out(F.col("doc_id")))
    shares = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(order, "doc_id").limit(sample).select("doc_id", "quality", (order.bitwiseAND(F.lit(1)) == 0).alias("teaches"))
        picked = part if picked is None else picked.unionByName(part)
    found = id_and_text(docs).where("text is not null and text <> ''").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "quality", "teaches").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of each id, whatever repeats
    rows = staged(found.select("doc_id", "text", "quality", "teaches"), "quality-sample")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, bytes]] = []
        for i, text, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = text.encode()
            step = max(PIECE, math.ceil(len(data) / PIECES))
            out += [(i, label, data[at : at + PIECE]) for at in range(0, len(data), step)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "quality", "piece"])

    found = map_arrow(rows.where("teaches"), pieces, "doc_id bigint, quality int, piece binary").collect()  # bounded: 2 x SAMPLE x PIECES x PIECE bytes
    found.sort(key=lambda r: (r["doc_id"], r["piece"]))
    good, bad = (fit_dictionary([bytes(r["piece"]) for r in found if r["quality"] == label]) for label in (1, 0))

    def differences(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = Difference(good, bad)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([d.of(x.as_py().encode()) for x in batch.column(1)], pa.float64())], ["doc_id", "quality", "difference"])

    seen = sorted(tuple(r) for r in map_arrow(rows.where("not teaches"), differences, "doc_id bigint, quality int, difference double").collect()) if good and bad else []  # bounded: 2 x SAMPLE
    y = np.array([r[1] for r in seen], float)
    if 0 < y.sum() < len(y):
        return Model(good, bad, *calibrate(np.array([r[2] for r in seen]), y), prior)
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(good, bad, math.log(p / (1 - p)), 0.0, prior)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.difference = model, Difference(model.good, model.bad)

    def score(self, text: str | None) -> float:
        if not text:
            return self.model.prior
        z = self.model.intercept + self.model.slope * self.difference.of(text.encode())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


_worker: dict = {}


def scorer(model: Model) -> Scorer:
    """The worker's scorer, made once for a model."""
    if model not in _worker:
        _worker.clear()
        _worker[model] = Scorer(model)
    return _worker[model]


def score_column(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """docs, all columns, with the score of each whole text as a last column."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = scorer(shared.value)
        return pd.Series([own.score(x) for x in texts], dtype="float64")

    return docs.withColumn(name, score(F.col(text).cast("string")))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on) of every row.

    Null and empty texts get the share of label 1. Rows are scored one by one by their text alone: nulls in doc_id, repeated
    rows and other columns change nothing. The broadcast model has a fixed size.
    """
    model = fit(docs, labels, sample)
    return score_column(id_and_text(docs), model, "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    (name,) = fresh(docs, "quality_score")
    return score_column(docs, fit(docs, labels, sample), name).where(F.col(name) >= threshold).drop(name)
