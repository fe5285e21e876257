"""A stored snapshot in hash buckets: a batch rewrites the buckets it touches, and one manifest commits them.

    data/<version>/bucket=<k>/…   the rows of a bucket as a version wrote them
    manifests/<version>.json      schema, and of each bucket the version that its rows are in; streams and the last batch of each

A version is what its manifest names. The files of a new one are written first, beside the old ones, and count for nothing until
its manifest is renamed into place. So a run that dies before that changes nothing, one that is repeated is known by its batch
number, and readers of an older version keep their files until `vacuum`. One writer at a time: a second one that commits the same version
gets an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import KEY, gone_after, merge_snapshot
from ..staging import staged, unstage

BUCKET = "bucket"


class Manifest(NamedTuple):
    version: int
    schema: StructType
    n_buckets: int
    buckets: dict[int, int]
    streams: dict[str, int]

    def text(self) -> str:
        return json.dumps({"version": self.version, "schema": self.schema.jsonValue(), "n_buckets": self.n_buckets, "buckets": self.buckets, "streams": self.streams})

    @staticmethod
    def of(text: str) -> Manifest:
        x = json.loads(text)
        return Manifest(x["version"], StructType.fromJson(x["schema"]), x["n_buckets"], {int(k): v for k, v in x["buckets"].items()}, x["streams"])


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class SnapshotStore:
    """Listings by key (source, source_listing_id) in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(snapshot: DataFrame, path: str, n_buckets: int = 256) -> SnapshotStore:
        """A store of version 0 with the rows of a snapshot. Choose n_buckets so that a bucket is a file or a few."""
        store = SnapshotStore(snapshot.sparkSession, path)
        if store._versions():
            raise ValueError(f"there is a store in {path}")
        store._write(snapshot, Manifest(0, snapshot.schema, n_buckets, {}, {}), None)
        return store

    # reading

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or an older version's."""
        found = self._versions()
        if not found:
            raise ValueError(f"no store in {self.path}")
        return Manifest.of(self._read_text(self._manifest_path(found[-1] if version is None else version)))

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or some."""
        m = self.manifest(version)
        return self._rows(m, m.buckets if buckets is None else [b for b in buckets if b in m.buckets])

    # writing

    def merge(self, batch: DataFrame, stream: str | None = None, batch_id: int = 0, in_order: bool = False) -> Manifest:
        """Rows of a batch (see merge_snapshot) over those of the same key; nothing is deactivated. Only buckets of the batch's keys are
        read and written. A batch of a named stream that has been committed already changes nothing."""
        m = self.manifest()
        if stream is not None and m.streams.get(stream, -1) >= batch_id:
            return m
        rows = staged(batch.withColumn(BUCKET, self._bucket(m)), "store-batch")
        touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())  # n_buckets at most
        old = self._rows(m, [b for b in touched if b in m.buckets])
        streams = m.streams if stream is None else m.streams | {stream: batch_id}
        done = self._write(merge_snapshot(old, rows.drop(BUCKET), deactivate=False, in_order=in_order), m._replace(streams=streams), touched)
        unstage(rows)
        return done

    def end_crawl(self, since: Column, scope: tuple[str, ...] = ("source",)) -> Manifest:
        """Deactivate what a crawl that began at `since` has not seen, in the scopes that it has rows of. Only buckets that
        hold such rows are written."""
        m = self.manifest()
        changed = staged(gone_after(self._rows(m, m.buckets), since, scope).withColumn(BUCKET, self._bucket(m)), "store-gone")
        touched = sorted(r[BUCKET] for r in changed.select(BUCKET).distinct().collect())  # n_buckets at most
        if touched:
            old, now = self._rows(m, touched), changed.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("crawled").alias("_crawled"))
            joined = old.join(now, [old[c] == now[f"_{c}"] for c in KEY], "left")
            gone = F.col("_crawled").isNotNull()
            rows = joined.withColumn("is_active", F.col("is_active") & ~gone).withColumn("last_seen", F.coalesce("_crawled", "last_seen")).select(*m.schema.names)
            m = self._write(rows, m, touched)
        unstage(changed)
        return m

    def rebucket(self, n_buckets: int) -> Manifest:
        """All rows into another number of buckets, as a store outgrows its own."""
        m = self.manifest()
        return self._write(self._rows(m, m.buckets), m._replace(n_buckets=n_buckets), None)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete manifests but the newest `keep`, and data that none of these names (so also what a run that died has left).
        Returns the versions whose data went."""
        kept = [self.manifest(v) for v in self._versions()[-max(1, keep):]]
        wanted, newest = {v for m in kept for v in m.buckets.values()}, kept[-1].version
        fs, names = self._fs(), self._list(f"{self.path}/data")
        gone = [int(n) for n in names if n.isdigit() and int(n) not in wanted and int(n) <= newest]
        for v in gone:
            fs.delete(self._hadoop(f"{self.path}/data/{v}"), True)
        for v in self._versions()[: -len(kept)]:
            fs.delete(self._hadoop(self._manifest_path(v)), False)
        return sorted(gone)

    # inside

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(m.n_buckets)).cast("int")

    def _rows(self, m: Manifest, buckets: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/data/{m.buckets[b]}/{BUCKET}={b}" for b in buckets]
        return self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)

    def _write(self, rows: DataFrame, m: Manifest, touched: list[int] | None) -> Manifest:
        """The rows of the touched buckets (None: of all) as the next version, and its manifest."""
        found = self._versions()
        version = found[-1] + 1 if found else 0
        out = f"{self.path}/data/{version}"
        dealt = rows.withColumn(BUCKET, self._bucket(m)).repartition(BUCKET)
        dealt.sortWithinPartitions(BUCKET, "is_active", *KEY).write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(out)
        written = {int(n.split("=")[1]) for n in self._list(out) if n.startswith(f"{BUCKET}=")}
        kept = {b: v for b, v in m.buckets.items() if b not in touched} if touched is not None else {}
        done = m._replace(version=version, buckets=kept | dict.fromkeys(sorted(written), version))
        self._commit(done)
        return done

    def _commit(self, m: Manifest) -> None:
        """Write the manifest aside and rename it into place, which fails where that place is taken."""
        fs, at, aside = self._fs(), self._manifest_path(m.version), f"{self.path}/manifests/.{m.version}.json.tmp"
        stream = fs.create(self._hadoop(aside), True)
        stream.write(m.text().encode())
        stream.close()
        if fs.exists(self._hadoop(at)) or not fs.rename(self._hadoop(aside), self._hadoop(at)):
            raise CommitConflict(f"version {m.version} of {self.path} is taken")

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list(f"{self.path}/manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        fs, at = self._fs(), self._hadoop(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _read_text(self, path: str) -> str:
        fs, at = self._fs(), self._hadoop(path)
        stream = fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
