"""The stored snapshot, crawl payloads and saved searches on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LISTING_COLUMNS, PAYLOAD


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def active_listings(snapshot: DataFrame) -> DataFrame:
    """The listing columns of active rows; the filter reaches the scan."""
    return snapshot.where("is_active").select(*(c for c in LISTING_COLUMNS if c in snapshot.columns), "is_active")


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """A new snapshot directory, cut by is_active so that searches read one part. The old one stays until the caller swaps them."""
    snapshot.write.partitionBy("is_active").option("compression", "zstd").parquet(path)


def read_payloads(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(PAYLOAD).format(form).load(path)


#: Pages in a file of payloads at most. Pages of a site are alike and pack to little: a file of all of them is one task's, though
#: what they are made into is many tasks' work.
FILE_PAGES = 20_000


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Payloads cut by source, so that a source's normaliser reads its own part only, in files of FILE_PAGES."""
    payloads.write.partitionBy("source").option("compression", "zstd").option("maxRecordsPerFile", FILE_PAGES).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved searches as JSON lines: id, ts, sig, mode, label, ref_label, ranked rows; entries may lack any of them."""
    row = "source string, source_listing_id string, url string, source_links array<struct<source:string,url:string>>, barrio string, conjunto string, city string, address string, area_m2 double, price double, admin double, cost_per_m2 double, distance_km double, driving_km double, bedrooms int"
    schema = f"id string, ts timestamp, sig string, mode string, label string, meta struct<refLabel:string>, result struct<ranked:array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in row.split(', '))}>>>"
    return spark.read.schema(schema).json(path).select("id", "ts", "sig", "mode", "label", F.col("meta.refLabel").alias("ref_label"), F.col("result.ranked").alias("ranked"))
