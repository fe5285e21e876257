"""The bucketed snapshot store: what a batch touches, crashes, repeats, order of arrival; and places by ranges."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthline.operators.merge import merge_snapshot
from hearthline.operators.numbering import number_rows
from hearthline.operators.rank import rank_all
from hearthline.sources.snapshot_store import CommitConflict, SnapshotStore
from hearthline.streaming.ingest import merge_stream_into

OLD = "source string, source_listing_id string, price double, first_seen timestamp, last_seen timestamp, last_verified_at timestamp, is_active boolean"
BATCH = "source string, source_listing_id string, price double, seen_at timestamp"
T0 = datetime(2024, 1, 1)


def old(spark, n=200):
    return spark.createDataFrame([(f"s{i % 3}", str(i), float(i), T0, T0, None, True) for i in range(n)], OLD)


def batch(spark, *rows):
    return spark.createDataFrame([(s, i, p, T0 + timedelta(hours=h)) for s, i, p, h in rows], BATCH)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    store = SnapshotStore.create(old(spark), f"{tmp_path}/s", n_buckets=32)
    before, m0 = files(f"{tmp_path}/s"), store.manifest()
    rows = batch(spark, ("s1", "1", 5.0, 2), ("s9", "new", 6.0, 2))
    m1 = store.merge(rows)
    touched = {b for b, v in m1.buckets.items() if v == 1}
    assert 1 <= len(touched) <= 2 and all(m1.buckets[b] == m0.buckets[b] for b in m0.buckets if b not in touched)
    after = files(f"{tmp_path}/s")
    assert before.items() <= after.items() and {f.split("/")[1] for f in after.keys() - before.keys()} == {"1"}
    assert table(store.read()) == table(merge_snapshot(old(spark), rows, deactivate=False)) and table(store.read(0)) == table(old(spark))
    with pytest.raises(ValueError, match="there is a store"):
        SnapshotStore.create(old(spark), f"{tmp_path}/s")


def test_one_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = SnapshotStore.create(old(spark), f"{tmp_path}/s", n_buckets=8)
    rows = batch(spark, *((f"s{i % 3}", str(i), -1.0, 3) for i in range(0, 200, 7)))

    def dies(self, m):
        raise OSError("no such luck")

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_commit", dies)
        with pytest.raises(OSError):
            store.merge(rows, "crawl", 4)
    assert store.manifest().version == 0 and table(store.read()) == table(old(spark))
    store.merge(rows, "crawl", 4)
    want = table(merge_snapshot(old(spark), rows, deactivate=False))
    assert table(store.read()) == want and store.manifest().version == 1
    assert store.merge(batch(spark, ("s1", "1", 99.0, 9)), "crawl", 4).version == 1 and table(store.read()) == want  # known by its number
    assert store.merge(batch(spark, ("s1", "1", 99.0, 9)), "other", 4).version == 2


def test_two_writers(spark, tmp_path):
    a = SnapshotStore.create(old(spark, 20), f"{tmp_path}/s", n_buckets=4)
    m = a.manifest()
    a.merge(batch(spark, ("s1", "1", 5.0, 2)))
    with pytest.raises(CommitConflict):
        a._commit(m._replace(version=1))


def test_stream_in_any_order_and_the_end_of_a_crawl(spark, tmp_path):
    rng, rows = random.Random(3), []
    for _ in range(300):
        i = rng.randrange(150)
        rows.append((f"s{i % 2}" if i < 120 else "s7", str(i), float(rng.randrange(1000)), 24 + rng.randrange(500) / 60))
    whole = batch(spark, *rows)
    whole.repartition(5, F.col("price")).write.parquet(f"{tmp_path}/in")
    store = SnapshotStore.create(old(spark), f"{tmp_path}/s", n_buckets=8)
    merge_stream_into(store, f"{tmp_path}/in", whole.schema, f"{tmp_path}/cp", files=1).awaitTermination()
    assert store.manifest().streams["crawl"] >= 3
    assert table(store.read()) == table(merge_snapshot(old(spark), whole, deactivate=False, in_order=False))
    store.end_crawl(F.lit(T0 + timedelta(hours=24)))
    assert table(store.read()) == table(merge_snapshot(old(spark), whole, in_order=False))
    assert {r.source for r in store.read().where("not is_active").collect()} == {"s0", "s1"}
    assert store.end_crawl(F.lit(T0 + timedelta(hours=24))).version == store.manifest().version  # nothing more is gone


def test_rebucket_and_vacuum(spark, tmp_path):
    store = SnapshotStore.create(old(spark), f"{tmp_path}/s", n_buckets=2)
    store.merge(batch(spark, ("s1", "1", 5.0, 2)))
    Path(tmp_path, "s/data/1/left").mkdir()
    want = table(store.read())
    assert len(store.rebucket(16).buckets) > 2 and table(store.read()) == want
    assert store.vacuum(keep=1) == [0, 1] and table(store.read()) == want
    with pytest.raises(Exception, match="."):
        store.read(0)
    assert table(store.read(buckets=[0, 1])) == sorted((r for r in want if r in set(table(store.read(buckets=[0]))) | set(table(store.read(buckets=[1])))), key=str)


def test_empty_batches_and_stores(spark, tmp_path):
    store = SnapshotStore.create(old(spark).limit(0), f"{tmp_path}/s")
    assert store.read().count() == 0 and store.merge(batch(spark)).buckets == {}
    store.merge(batch(spark, ("s", "1", None, 1), ("s", "1", 2.0, 1)))
    assert [(r.price, r.is_active) for r in store.read().collect()] == [(None, True)]


def test_places(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(50), k) for k in range(2000)]
    out = number_rows(spark.createDataFrame(rows, "g string, v long, k long"), [F.desc("v"), "k"], ["g"]).collect()
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [tuple(r)[:3] for r in sorted((r for r in out if r.g == g), key=lambda r: r.place)] == want
        assert sorted(r.place for r in out if r.g == g) == list(range(len(want)))
    assert number_rows(spark.createDataFrame([], "v long"), ["v"]).count() == 0


def test_equal_scores_are_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.lit(0.5).alias("score"), F.lit("s").alias("source"), F.format_string("%05d", "id").alias("source_listing_id"))
        ranked = rank_all(rows.unionByName(spark.createDataFrame([(None, "s", "x"), (0.9, "s", "y")], "score double, source string, source_listing_id string")))
        parts = ranked.where("score = 0.5").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 4 and max(r["count"] for r in parts) < 2000
        got = {r.source_listing_id: r["rank"] for r in ranked.collect()}
        assert got["y"] == 1 and got["00000"] == 2 and got["03999"] == 4001 and got["x"] == 4002
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
