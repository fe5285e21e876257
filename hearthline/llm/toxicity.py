"""Toxic passages: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

A word's score is the log-odds of label 1 given the word, against that of any text. Its Dirichlet prior is what its beginning of six
letters says, whose own prior is its beginning of five letters, and so on down to the share of label 1: a rare word is judged by
its stem, and a common one by itself. Less a drift, the scores of clean text sum to less and less, so a run of words whose sum rises is a
passage. All maximal ones are found in one pass over the words.

The best passage of clean texts follows an extreme-value law in the text's length, which is fitted to labelled clean texts. It
gives each passage its E-value (how many as good ones clean text of that length has), and a text's evidence is the sum over its
significant passages of what they have beyond chance, turned into a probability by a logistic calibration.

Learning takes a bounded sample: at most `sample` labelled rows of each label, the first by a hash of doc_id, of which one half
gives the scores and the other the calibrations. Scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, ship, staged
from .quality import calibrate, held_out

#: Labelled rows of each label to learn from, and words and beginnings with a score of their own, at most.
SAMPLE, FORMS = 4000, 262_144
#: Lengths of the beginnings of words; weight of a prior, in texts; what a word takes from a sum (a word whose odds are exp(DRIFT) times the usual adds nothing).
STEMS, WEIGHT, DRIFT = (4, 5, 6), 5.0, 2.0
#: Passages that clean text has less often than this count.
SIGNIFICANT = 0.05
#: Words that a worker remembers the scores of; characters from which a text's words aren't listed at once.
REMEMBERED, LONG = 1 << 20, 1 << 20
SEED = 7
WORD = re.compile(r"\w+")


class Model(NamedTuple):
    """scores: of words, and of beginnings (with a * at the end); lam, k: of the extreme-value law; the log-odds of label 1 are
    intercept + slope x log(1 + evidence)."""

    scores: dict[str, float]
    lam: float
    k: float
    intercept: float
    slope: float


class Passage(NamedTuple):
    start: int
    end: int
    score: float


def forms(word: str) -> list[str]:
    """A word's beginnings, shortest first, and itself."""
    return [f"{word[:n]}*" for n in STEMS if len(word) >= n] + [word]


class Scores(dict):
    """Scores by word, less the drift, found by the longest known form and then remembered."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = next((self.known[f] for f in reversed(forms(word)) if f in self.known), 0.0) - DRIFT
        return found


def maximal_segments(scores: np.ndarray) -> list[Passage]:
    """All maximal scoring segments, in order and disjoint: (first, last + 1, sum), in time linear in the scores.

    A candidate keeps the sums before and after it, and the nearest candidate to its left whose sum before is lower. A new one is
    joined to that candidate as long as its sum after is the higher of the two.
    """
    total = np.cumsum(scores)
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, after = i, float(total[i - 1]) if i else 0.0, float(total[i])
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= before:
                at = found[at][4]
            if at < 0 or found[at][3] >= after:
                found.append((start, i + 1, before, after, at))
                break
            start, before = found[at][0], found[at][2]
            del found[at:]
    return [Passage(a, b, after - before) for a, b, before, after, _ in found]


def word_scores(text: str, scores: Scores) -> np.ndarray:
    """A text's words' scores; a word said again at once tells nothing new."""
    low = text.lower()
    words = WORD.findall(low) if len(low) < LONG else (m[0] for m in WORD.finditer(low))
    found = np.fromiter(map(scores.__getitem__, words), np.float64)
    found[1:][(found[1:] == found[:-1]) & (found[1:] > 0)] = -DRIFT
    return found


def fit_law(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lam and k of P(best <= x) = exp(-k n exp(-lam x)), of most likelihood; a text without a passage says that its best is 0 at most.

    With fewer than two different best passages lam is 1, which it is for log-odds by theory.
    """
    some = best > 0
    if len(np.unique(best[some])) < 2:
        return 1.0, float((some.sum() + 1) / max(1.0, lengths.sum()))

    def slope(lam: float) -> float:
        w = lengths * np.exp(-lam * best)
        return 1 / lam - best[some].mean() + (w @ best) / w.sum()

    low, high = 1e-3, 64.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    lam = math.sqrt(low * high)
    return lam, float(some.sum() / (lengths @ np.exp(-lam * best)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.scores = model, Scores(model.scores)

    def passages(self, text: str | None) -> list[tuple[Passage, float]]:
        """Significant passages, in words, and the logarithm of each one's E-value."""
        s = word_scores(text or "", self.scores)
        chance = math.log(self.model.k * max(1, len(s)))
        return [(p, e) for p in maximal_segments(s) if (e := chance - self.model.lam * p.score) < math.log(SIGNIFICANT)]

    def score(self, found: list[tuple[Passage, float]]) -> float:
        z = self.model.intercept + self.model.slope * evidence(found)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def evidence(found: list[tuple[Passage, float]]) -> float:
    """log(1 + what the passages have beyond chance); one that is repeated in the same words, and so with the same sum, counts once."""
    return math.log1p(sum(-e for e in {round(p.score, 6): e for p, e in found}.values()))


def log_odds(counts: dict[str, tuple[int, int]], share: float) -> dict[str, float]:
    """Scores of forms from (texts of label 1, texts) that hold them; share: of label 1."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    base, shares, priors = math.log(share / (1 - share)), {}, {}
    for form in sorted(counts, key=lambda f: (not f.endswith("*"), len(f))):  # what a prior needs comes first
        chain = forms(form.rstrip("*"))
        above = next((f for f in reversed(chain[: chain.index(form)]) if f in shares), None)
        ones, of = counts[form]
        prior = share
        if above:  # without the form's own texts, which would count twice
            a, b = max(0, counts[above][0] - ones), max(0, counts[above][1] - of)
            prior = (min(a, b) + WEIGHT * priors[above]) / (b + WEIGHT)
        priors[form], shares[form] = prior, (ones + WEIGHT * prior) / (of + WEIGHT)
    return {f: math.log(p / (1 - p)) - base for f, p in shares.items()}


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic, teaches of the labelled rows to learn from; the share of label 1 among all that could be)."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").where(~held_out(F.col("doc_id")))
    shares = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample).select("doc_id", "toxic", (order.bitwiseAND(F.lit(1)) == 0).alias("teaches"))
        picked = part if picked is None else picked.unionByName(part)
    found = id_and_text(docs).where("text is not null and text <> ''").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "toxic", "teaches").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of each id, whatever repeats
    return staged(found.select("doc_id", "text", "toxic", "teaches"), "toxicity-sample"), shares.get(1, 0) / sum(shares.values()) if shares else 0.0


def _count_forms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """form, ones, texts: how many of a batch's texts hold a form, once each; the form "" counts the texts."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        words = set(WORD.findall(text.lower()))
        seen[label].update({"", *(f for w in words for f in forms(w))})
    names = list(seen[0] | seen[1])
    ones = [seen[1][f] for f in names]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ones, pa.int64()), pa.array([seen[0][f] + n for f, n in zip(names, ones, strict=True)], pa.int64())], ["form", "ones", "texts"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels.toxic of rows that aren't held out; ids with null or contradictory labels are passed over.

    With no row of one label every text gets the share of label 1 (no row at all: 0).
    """
    rows, prior = _sample(docs, labels, sample)
    counted = map_arrow(rows.where("teaches"), _count_forms, "form string, ones bigint, texts bigint").groupBy("form").agg(F.sum("ones").alias("ones"), F.sum("texts").alias("texts"))
    counted = staged(counted.where("texts > 1 or form = ''"), "toxicity-forms")
    least, room = 1, FORMS
    for r in counted.groupBy("texts").count().orderBy(F.desc("texts")).collect():  # as many rows as texts of the sample at most
        room -= r["count"]
        if room < 0:
            least = r["texts"]
            break
    counts = {r["form"]: (r["ones"], r["texts"]) for r in counted.where((F.col("texts") > least) | (F.col("form") == "")).collect()}  # FORMS at most
    ones, of = counts.pop("", (0, 0))
    p = min(max(prior, 1e-6), 1 - 1e-6)
    unknown = Model({}, 1.0, 1.0, math.log(p / (1 - p)), 0.0)
    if not 0 < ones < of:
        return unknown
    scores = log_odds(counts, ones / of)
    bare = Model(scores, 1.0, 1.0, 0.0, 1.0)
    shared = rows.sparkSession.sparkContext.broadcast(bare)

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scorer(shared.value).scores
        found = [word_scores(x.as_py(), own) for x in batch.column(1)]
        most = [max((p.score for p in maximal_segments(s)), default=0.0) for s in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(most, pa.float64())], ["doc_id", "words", "best"])

    clean = sorted(tuple(r) for r in map_arrow(rows.where("not teaches and toxic = 0"), best, "doc_id bigint, words bigint, best double").where("words > 0").collect())  # SAMPLE at most
    lam, k = fit_law(np.array([r[1] for r in clean], float), np.array([r[2] for r in clean], float))
    model = bare._replace(lam=lam, k=k)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scorer(shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([evidence(own.passages(x.as_py())) for x in batch.column(1)], pa.float64())], ["doc_id", "toxic", "evidence"])

    seen = sorted(tuple(r) for r in map_arrow(rows.where("not teaches"), judge, "doc_id bigint, toxic int, evidence double").collect())  # 2 x SAMPLE at most
    y = np.array([r[1] for r in seen], float)
    if not 0 < y.sum() < len(y):
        return unknown
    intercept, slope = calibrate(np.array([r[2] for r in seen]), y)
    drawn = y.mean()  # the sample may hold more of the rarer label than the corpus
    return model._replace(intercept=intercept + math.log(p / (1 - p)) - math.log(drawn / (1 - drawn)), slope=slope)


_worker: dict = {}


def scorer(model: Model) -> Scorer:
    """The worker's scorer, made once for a model."""
    if _worker.get("of") is not model:
        _worker.update(of=model, scorer=Scorer(model))
    return _worker["scorer"]


PASSAGE = "array<struct<start:bigint,end:bigint,score:double,log_e:double>>"


def find_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from `threshold` on) and passages of every row.

    passages: the significant ones in order, with their code points (end exclusive), sum of scores and logarithm of the E-value.
    Null and empty texts have none, and get the score of a text without any. Rows are scored one by one by their text alone: nulls in doc_id, repeated
    rows and other columns change nothing. The broadcast model has at most FORMS scores.
    """
    model = fit(docs, labels, sample)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scorer(shared.value)
        scores, passages = [], []
        for text in batch.column(1):
            found = own.passages(text := text.as_py())
            scores.append(own.score(found))
            passages.append(in_code_points(text, found))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    out = map_arrow(id_and_text(docs), judge, f"doc_id bigint, score double, passages {PASSAGE}")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def in_code_points(text: str | None, found: list[tuple[Passage, float]]) -> list[dict]:
    """Passages by the places of their words in the text."""
    if not found:
        return []
    wanted = {i for p, _ in found for i in (p.start, p.end - 1)}
    low = text.lower()
    own = WORD.finditer(text if len(low) == len(text) else low)  # a few letters are longer in lower case; places are then those there
    at = {i: m.span() for i, m in enumerate(own) if i in wanted}
    return [{"start": at[p.start][0], "end": at[p.end - 1][1], "score": p.score, "log_e": e} for p, e in found]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """find_toxic without the passages."""
    return find_toxic(docs, labels, threshold, sample).drop("passages")
