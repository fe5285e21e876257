"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from hearthline.llm import resemblance
from tests.llm.test_operators import docs

VOCABULARY = [f"w{k}" for k in range(400)]


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({rows[find(k)][0] for k in range(len(rows))})


@pytest.mark.parametrize("piece", [512, 3])
def test_near_copies_go(spark, monkeypatch, piece):
    monkeypatch.setattr(resemblance, "PIECE", piece)
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One", "one two", "é É"]
    for _ in range(25):
        base = rng.choices(VOCABULARY, k=rng.choice([12, 60, 300]))
        texts.append(" ".join(base))
        for _ in range(6):  # some copies are within 0.8 of the base, some only of each other, some of neither
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            base = w if rng.random() < 0.5 else base
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    frame = docs(spark, *rows, extra=True)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0
