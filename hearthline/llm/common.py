"""Reading tables, cutting lineage, and Arrow helpers shared by the operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, shared_dir, staged, unstage
from ..workers import ship

__all__ = ["SPACES", "discard", "fresh", "id_and_text", "map_arrow", "release", "shared_dir", "ship", "staged", "table", "unstage", "words"]

#: Words everywhere in this subpackage: runs of bytes that are none of these white-space characters.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as bigint and text as string, without any other column of the input."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referred to, rather than at some later collection."""
    for _ in range(2):  # the first finds what Python held, the second what that held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """One Arrow batch in, one or more out; f must be a function of the batch alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """The words of a text as an array (none for null or blank texts)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")
