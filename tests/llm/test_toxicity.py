"""Toxic passages: segments by brute force, the law on drawn maxima, scores recomputed, held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import toxicity
from hearthline.llm.quality import held_out
from tests.llm.test_operators import docs, prose

BAD = ("idiot", "scumbag", "scummy", "scumlike")


def plain_segments(scores):
    """All maximal scoring segments: the best one (first, shortest), then those left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and b - a < best[2] - best[1] - 1)):
                best = (total, a, b + 1)
    if best is None:
        return []
    _, a, b = best
    return plain_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in plain_segments(scores[b:])]


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3.5, -1.25, -0.5, 0.75, 1.1, 2.3]) + rng.random() / 1000 for _ in range(rng.randrange(30))]
        got = toxicity.maximal_segments(np.array(scores))
        assert [(p.start, p.end) for p in got] == plain_segments(scores)
        assert all(math.isclose(p.score, sum(scores[p.start : p.end]), abs_tol=1e-9) for p in got)


def test_segments_are_linear():
    n = 200_000
    for scores in (np.tile([1.0, -0.5], n), np.linspace(-1, 1, n), np.tile([3.0, -2.9, 1.0, -4.0], n // 2)):
        assert toxicity.maximal_segments(scores)


def test_law():
    rng = np.random.default_rng(3)
    lengths = rng.integers(50, 2000, 4000).astype(float)
    best = np.maximum(0, (np.log(0.02 * lengths) - np.log(-np.log(rng.random(4000)))) / 1.7)
    lam, k = toxicity.fit_law(lengths, best)
    assert abs(lam - 1.7) < 0.1 and abs(k - 0.02) < 0.004
    assert toxicity.fit_law(np.array([5.0]), np.array([0.0]))[0] == 1.0


def test_priors():
    """A stem speaks for words that are rare, and not for itself alone."""
    counts = {"scum*": (40, 40), "scumla": (2, 2), "idiot": (30, 30), "idio*": (30, 30), "idiot*": (30, 30), "river": (10, 100), "rive*": (10, 100)}
    found = toxicity.log_odds(counts, 0.1)
    plain = lambda p: math.log(p / (1 - p)) - math.log(0.1 / 0.9)
    w = toxicity.WEIGHT
    assert math.isclose(found["idiot"], plain((30 + w * 0.1) / (30 + w))) and found["scumla"] > plain((2 + w * 0.1) / (2 + w)) and abs(found["river"]) < 1e-9
    scores = toxicity.Scores(found)
    assert scores["scumette"] == found["scum*"] - toxicity.DRIFT and scores["unknown"] == -toxicity.DRIFT


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 200)).split()
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 6) * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs(spark, *rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels(corpus):
    rows, labels = corpus
    out = toxicity.score_toxicity(rows, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r.predicted != r.toxic for r in out) == 0 and all(0 <= r.score <= 1 for r in out)


def test_scores_are_of_the_whole_text(spark, corpus):
    rows, labels = corpus
    long = "river " * 50_000 + "scummy idiot and a scumbag"
    odd = docs(spark, (None, None), (9001, ""), (9001, " \n"), (9002, "river of the idiot"), (9002, "river of the idiot"), (9003, long), (9004, "İdiot İ scumbag"))
    every = odd.unionByName(rows.select(*odd.columns))
    own = toxicity.Scorer(toxicity.fit(every, labels))
    got, texts = toxicity.find_toxic(every, labels).collect(), {}
    for r in every.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(got) == 907
    for r in got:
        assert any(math.isclose(r.score, own.score(own.passages(t)), rel_tol=1e-9) for t in texts[r.doc_id])
        assert r.predicted == int(r.score >= 0.3)
    found = next(r for r in got if r.doc_id == 9003)
    assert found.predicted == 1 and [long[p.start : p.end] for p in found.passages] == ["scummy idiot"]
    assert all(r.score < 0.3 and not r.passages for r in got if r.doc_id in (None, 9001))


def test_learns_from_no_held_out_row(spark, corpus):
    rows, labels = corpus
    a = toxicity.fit(rows, labels)
    b = toxicity.fit(rows.withColumn("text", F.when(held_out(F.col("doc_id")), "idiot").otherwise(F.col("text"))).withColumn("lang", F.lit("x")), labels)
    assert a == b


def test_nothing_to_learn(spark, corpus):
    rows, labels = corpus
    assert {round(r.score, 4) for r in toxicity.score_toxicity(rows, labels.limit(0)).collect()} == {0.0}
    assert {round(r.score, 3) for r in toxicity.score_toxicity(rows, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_toxicity(rows.limit(0), labels).count() == 0
