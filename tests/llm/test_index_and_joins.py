"""What the permutation index visits and finds with more pivots than its least number, and the joins of labelled fingerprints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import ann, simhash
from tests.llm.test_operators import docs


def visited(x, queries, p, index):
    """Share of the vectors that stand in a file which each query visits."""
    posted = ann.orders(x, p.at, index.post)
    mark = np.zeros((len(queries), len(p.at)), bool)
    for k, order in enumerate(ann.orders(queries, p.at, index.probe)):
        mark[k, order] = True
    return float(np.mean([m[posted].any(1).mean() for m in mark]))


@pytest.mark.parametrize(("kind", "most"), [("normal", 0.85), ("clustered", 0.6)])
def test_more_pivots_visit_less(spark, kind, most):
    rng, n, index = np.random.default_rng(3), 12_000, ann.Index()
    x = rng.standard_normal((n, 32))
    if kind == "clustered":
        x = rng.standard_normal((60, 32))[rng.integers(0, 60, n)] + 0.3 * x
    x = x.astype(np.float32)
    pivots = ann.how_many(n, index)
    assert pivots > 3 * index.pivots
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.search(df, k=10, every=200, index=index).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    queries, hits = np.arange(0, n, 200), 0
    for q in queries:
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(found[int(q)]))
    assert hits / (10 * len(queries)) >= 0.95
    keyed = df.select(F.xxhash64("embedding").alias("v1"), F.xxhash64(F.lit(1), "embedding").alias("v2"), F.size("embedding").alias("n"), F.col("embedding").alias("vector"))
    p = ann.draw(keyed, 32, n, index)
    assert len(p.at) == pivots and visited(x.astype(float), x[queries].astype(float), p, index) < most


def test_labels_are_joined_between_fresh_exchanges(spark):
    """No join stands directly on an exchange of another by the same key, which Spark could not split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = simhash.label_near_duplicates(docs(spark, *((k, f"a b c d e {k % 7}") for k in range(50))))
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k in conf:
            spark.conf.unset(k)
    depth = lambda line: len(line) - len(line.lstrip(" +-:*(0123456789)"))
    joins = [k for k, line in enumerate(plan) if "SortMergeJoin" in line]
    assert joins
    for k in joins:
        below = []
        for line in plan[k + 1 :]:
            if depth(line) <= depth(plan[k]):
                break
            below.append(line)
        sides = [i for i, line in enumerate(below) if depth(line) == min(map(depth, below))]
        for begin, end in zip(sides, [*sides[1:], len(below)], strict=True):
            first = next((line for line in below[begin:end] if "Exchange" in line or "SortMergeJoin" in line), "")
            assert "SortMergeJoin" not in first, "\n".join(plan)
