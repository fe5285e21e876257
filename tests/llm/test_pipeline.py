"""The pipeline's stages against plain versions of what they decide, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthline.llm import simhash
from tests.llm.test_operators import plain_base, prose
from tests.llm.test_resemblance import plain_kept

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copy(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(["river", "anchor", "Paris"])
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    item = "how many stones lie under the river when seven trees walk over the house quickly and Anna waits"
    rows = []
    for i in range(240):
        text = prose(rng, rng.randrange(30, 150)) + "."
        if i % 8 == 0:
            text = " ".join(f"{w}***" for w in text.split())
        elif i % 40 == 1:
            text = f"{text} {item} {text[:50]}"
        elif i % 20 == 2:
            text += " token = 0123456789abcdef0123456789"
        rows.append((i, text))
    rows += [(300 + k, rows[k * 7 + 1][1]) for k in range(10)]
    rows += [(400 + k, near_copy(rows[k * 11 + 3][1], rng, changes)) for k, changes in enumerate((1, 1, 2, 3, 4, 6, 9, 14))]  # on both sides of 0.8
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, ("en", "de", "fr")[i % 3], f"src{i % 5}", len(t)) for i, t in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(rows), item


def test_stages(spark, corpus):
    at, texts, item = corpus
    frames, df = {}, spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = stage(spark, df, at)
        df = spark.createDataFrame(df.collect(), df.schema)
        frames[name] = {r.doc_id: r for r in df.collect()}
        if name != "mixing":
            assert df.columns == before.columns
    good = {i for i in texts if "***" not in texts[i]}
    kept = set(frames["quality"])
    assert len(kept ^ good) <= 3
    assert set(frames["near_duplicates"]) == set(plain_kept([(i, texts[i]) for i in sorted(kept)]))
    assert set(frames["decontamination"]) == {i for i in frames["near_duplicates"] if item not in texts[i]}
    assert set(frames["secrets"]) == set(frames["decontamination"])
    for i, r in frames["secrets"].items():
        assert plain_base(r.text)[0] == "" and r.n_chars == len(r.text)
        if "token" not in texts[i]:
            assert r.text == texts[i]
    total = sum(len(r.text.split()) for r in frames["secrets"].values())
    mixed = frames["mixing"].values()
    assert 0.8 * total <= sum(r.n_tokens * r.copies for r in mixed) <= total
    assert set(frames["mixing"]) <= set(frames["secrets"])


def test_run_is_its_stages(spark, corpus):
    at, _, _ = corpus
    out = corpus_pipeline.run(spark, at)
    df = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, at)
        df = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_null_rows(spark, corpus):
    at, _, _ = corpus
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (2, "a few words of it", "en", "s", 17), (2, "a few words of it", "en", "s", 17)], DOCS).withColumn("domain_", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, at)
        assert out.count() >= 1, name
        assert stage(spark, df.limit(0), at).count() == 0, name
    assert simhash.keep_one_of_each(df).count() == 2
