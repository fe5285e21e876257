"""Many patterns over one text, each tried only where a literal that it needs stands."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds_any(text: Column, literals: Iterable[str]) -> Column:
    """Whether the text holds one of the literals: a search for bytes, many times faster than an expression."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in literals))


def first_match(text: Column, pattern: str, literals: Iterable[str]) -> Column:
    """The first match of the pattern, or null. Every match must hold one of the literals; without them the pattern isn't tried."""
    hit = F.regexp_extract(text, f"({pattern})", 1)
    return F.when(holds_any(text, literals), F.nullif(hit, F.lit("")))


def count_word(text: Column, word: str) -> Column:
    """How often a word, escaped for a pattern, stands between word boundaries in the text."""
    return F.when(F.contains(text, F.lit(word.replace("\\", ""))), F.regexp_count(text, F.lit(rf"\b{word}\b"))).otherwise(F.lit(0))


def once(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f uses it, and only where the outcome is asked for."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, worked out once a row whatever is made of them.

    The optimizer puts a column's expression into each filter that names it, and those filters as far down as they go, so that a page is
    searched as often as it is named. What comes out of a generator stays there, and columns of it are read like those of a table.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = df.withColumns(columns).select(*kept, F.explode(F.array(F.struct(*columns))).alias("settled_"))
    return made.select(*kept, *(F.col(f"settled_.{c}") for c in columns))
