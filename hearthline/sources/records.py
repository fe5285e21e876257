"""Records of delimited text whose quoted fields may hold separators and line breaks, wherever the files are split.

A line is a function of two states: whether a quoted field is open before it, to whether one is open after it. Such a function
is a constant, nothing, or a swap, so the state before any line is that after the last constant before it, swapped as often as
lines in between say. That is worked out by windows within a split, then over one row for each split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Lines of a record at most; a line that an open quote would carry further is a (malformed) record of its own.
MOST_LINES = 10_000
_WHITE = " \t\r"


def separator_pattern(sep: str) -> str:
    return {"|": r"\|", "\t": r"\t"}.get(sep, sep)


_INNER = r'[^"]*+(?:""[^"]*+)*+'  # of a quoted field


def _open_after(sep: str) -> tuple[str, str]:
    """Patterns of lines after which a quoted field is open: of lines that begin outside one, and inside one."""
    s = separator_pattern(sep)
    field = f'(?:"{_INNER}"[^{s}]*+|[^"{s}][^{s}]*+|)'
    outside = f'(?:{field}{s})*+"{_INNER}\\z'
    return f"^{outside}", f'^{_INNER}(?:\\z|"(?!")[^{s}]*+{s}{outside})'


def is_open(record: Column, sep: str) -> Column:
    return record.rlike(_open_after(sep)[0])


def count_fields(record: Column, sep: str) -> Column:
    """Fields of a record; separators inside quoted ones count for nothing."""
    s = separator_pattern(sep)
    return F.size(F.split(F.regexp_replace(record, f'(?<=^|{s})"{_INNER}"', ""), s, -1))


def _follow(df: DataFrame, by: list[str], order: str, constant: Column, value: Column, swap: Column) -> DataFrame:
    """Adds fixed (the state after the last constant up to a row; null: none yet) and odd (whether it is swapped since)."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum(F.coalesce(swap, F.lit(False)).cast("int")).over(upto)
    df = df.withColumn("_swaps", swaps)
    last = F.last(F.when(constant, F.struct(value.alias("value"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(upto)
    df = df.withColumn("_last", last)
    odd = (F.col("_swaps") - F.coalesce("_last.swaps", F.lit(0))) % 2 == 1
    return df.withColumns({"fixed": F.col("_last.value"), "odd": odd}).drop("_swaps", "_last")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split begins), at (ascending within the split) and value of every line, on the shared folder."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    marked = (F.col("block") == 0) & F.startswith("value", F.lit("\ufeff"))  # a byte order mark may stand before the first quote of a file
    return staged(lines.withColumns({"value": F.when(marked, F.ltrim("value", F.lit("\ufeff"))).otherwise(F.col("value")), "at": F.monotonically_increasing_id()}), "list-lines")


def records(lines: DataFrame, sep: str) -> DataFrame:
    """n (from 0, blank records not counted), record (its lines joined by line breaks) and cut (whether an open quote was cut off
    after MOST_LINES) of lines(file, block, at, value). A file ends its last record.

    Two windows over the lines of a split and some over a row for each split; only lines that continue a record are grouped
    and joined to its first.
    """
    split = ["file", "block"]
    here = Window.partitionBy(*split).orderBy("at")
    quoted = F.contains("value", F.lit('"'))
    from_out, from_in = _open_after(sep)
    x = lines.withColumns({"a": F.when(quoted, F.col("value").rlike(from_out)).otherwise(F.lit(False)), "b": F.when(quoted, F.col("value").rlike(from_in)).otherwise(F.lit(True))})
    a, b = F.col("a"), F.col("b")
    x = _follow(x, split, "at", a == b, a, a & ~b)
    x = x.withColumns({"fixed_before": F.lag("fixed").over(here), "odd_before": F.coalesce(F.lag("odd").over(here), F.lit(False)), "row": F.row_number().over(here)})
    x = staged(x.drop("a", "b"), "list-states")

    ends = x.groupBy(*split).agg(F.max_by(F.struct("fixed", "odd"), "at").alias("e"))
    fixed, odd = F.col("e.fixed"), F.col("e.odd")
    ends = _follow(ends.withColumns({"f": fixed, "o": odd}), ["file"], "block", F.col("f").isNotNull(), F.col("f") != F.col("o"), F.col("f").isNull() & F.col("o"))
    before = Window.partitionBy("file").orderBy("block")
    ends = ends.select(*split, F.coalesce(F.lag(F.coalesce("fixed", F.lit(False)) != F.col("odd")).over(before), F.lit(False)).alias("open"))

    same = ["file", "block"]
    x = x.join(ends, same).withColumn("inside", F.coalesce("fixed_before", "open") != F.col("odd_before"))
    begun = F.last(F.when(~F.col("inside"), F.col("row")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("cut", F.col("inside") & (F.col("row") - F.coalesce(begun, F.lit(0)) >= MOST_LINES))
    x = x.withColumn("starts", ~F.col("inside") | F.col("cut"))
    real = F.col("starts") & (F.col("cut") | (F.btrim("value", F.lit(_WHITE)) != ""))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"r": F.sum(F.col("starts").cast("int")).over(upto), "n": F.sum(real.cast("bigint")).over(upto), "real": real})

    counts = x.groupBy(*split).agg(F.max("r").alias("r"), F.max("n").alias("n"))
    whole = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # of a row for each split
    owner = F.last(F.when(F.col("r") > 0, F.struct("block", "r")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*split, F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("offset"), owner.alias("owner"))
    x = x.join(counts, same)
    heads = x.where("real").select(*split, "r", (F.col("offset") + F.col("n") - 1).alias("n"), "value", "cut")
    mine = F.col("r") > 0
    rest = x.where("not starts").select("file", F.when(mine, F.col("block")).otherwise(F.col("owner.block")).alias("block"), F.when(mine, F.col("r")).otherwise(F.col("owner.r")).alias("r"), F.struct(F.col("block").alias("b"), "at", "value").alias("line"))
    rest = rest.groupBy("file", "block", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda v: v["value"]), "\n").alias("more"))
    return heads.join(rest, ["file", "block", "r"], "left").select("n", F.concat_ws("\n", "value", "more").alias("record"), "cut")
