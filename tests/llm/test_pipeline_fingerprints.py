"""The pipeline's near-duplicate stage goes through operator 6's fingerprints; bands only add to them."""

import random

import corpus_pipeline
from hearthline.llm import resemblance, simhash
from tests.llm.test_operators import docs
from tests.llm.test_resemblance import plain_kept

VOCABULARY = [f"w{k}" for k in range(400)]


def corpus():
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "One"]
    for _ in range(12):
        base = rng.choices(VOCABULARY, k=300)
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    return texts


def components(n, linked):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in linked:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(n)]


def test_pairs_connect_what_operator_6_links(spark):
    texts = corpus()
    frame = docs(spark, *enumerate(texts))
    place = {r.text_hash: r.doc_id for r in simhash.fingerprints(frame).collect()}
    prints = [simhash.fingerprint(t) for t in texts]
    wanted = [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 2]
    got = [(place[r.u], place[r.v]) for r in resemblance.fingerprint_pairs(frame).collect()]
    assert len(wanted) > 5 and components(len(texts), got) == components(len(texts), wanted)


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without any band, what the fingerprints link still goes, and nothing else."""
    texts = corpus()
    prints = [simhash.fingerprint(t) for t in texts]
    wanted = components(len(texts), [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 2])
    monkeypatch.setattr(resemblance, "_keyed", lambda d: d.sparkSession.createDataFrame([], "node bigint, key bigint"))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, *enumerate(texts)), "").collect())
    assert kept == sorted(set(wanted)) and len(kept) > len(plain_kept(list(enumerate(texts))))
