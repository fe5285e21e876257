"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' contents in a tree of domain, language and source. A token budget is split over the domains by weight, a
domain's share over its languages, a language's over its sources. No node gets more than it can give (its tokens times the
epochs allowed); what it can't give goes to its siblings by their weights, and only what all of them can't take goes up to its
parent's siblings. Each leaf then takes whole seeded epochs of its documents, and of the last epoch the documents of the
token-prefix that fits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, staged

#: Documents of a leaf that are put in order at a time, about; names of domains at most (their budgets are made in one task).
RUN, MOST_DOMAINS = 1024, 1_000_000


class Mix(NamedTuple):
    """Integer weights by name, `other` for names without one; 0 leaves a name and all below it out, and what it would have got
    goes to its siblings. budget: tokens, or None for as many as the input has."""

    domains: tuple[tuple[str, int], ...] = ()
    languages: tuple[tuple[str, int], ...] = (("en", 50), ("de", 20), ("fr", 20), ("es", 10))
    sources: tuple[tuple[str, int], ...] = ()
    other: int = 10
    epochs: int = 2
    seed: int = 17
    budget: int | None = None


def domain_of(source: Column) -> Column:
    """The domain a source belongs to, unless a column domain is given: its name without a number at the end (books2: books)."""
    return F.coalesce(F.nullif(F.regexp_replace(source, r"[-_. ]*[0-9]+$", ""), F.lit("")), source)


def _weight(name: Column, weights: tuple[tuple[str, int], ...], other: int) -> Column:
    out = F.lit(other).cast("bigint")
    for key, value in weights:
        out = F.when(name == key, F.lit(value).cast("bigint")).otherwise(out)
    return out


def share(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Adds column given to (parent..., weight, can, name): each node's part of its parent's budget.

    Nodes in rising order of can / weight are filled up until the rest, split by weight, overflows none. All of this is a
    window over the nodes of one parent. Nodes of weight 0 get nothing.
    """
    able = F.when(F.col("weight") > 0, F.col("can")).otherwise(F.lit(0))
    left = nodes.withColumn("able", able).withColumn("turn", F.coalesce(F.try_divide("able", "weight"), F.lit(0.0)))
    order = Window.partitionBy(*parent).orderBy("turn", "name")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = left.withColumn("budget", budget).withColumn("spent", F.coalesce(F.sum("able").over(back), F.lit(0)))
    left = left.withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(back), F.lit(0)))
    left = left.withColumn("rate", F.try_divide(F.col("budget") - F.col("spent"), F.col("weights")))
    level = left.withColumn("level", F.min(F.when((F.col("weight") > 0) & (F.col("rate") <= F.col("turn")), F.struct("turn", "name", "rate"))).over(whole)["rate"])
    given = F.when(F.col("level").isNull(), F.col("able")).otherwise(F.least(F.col("able"), F.floor(F.greatest(F.lit(0.0), F.col("level")) * F.col("weight"))))
    return level.withColumn("given", given).drop("budget", "spent", "weights", "rate", "level", "able", "turn")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens and given of every leaf; leaves: domain, lang, source, tokens."""
    ways = {"domain": mix.domains, "lang": mix.languages, "source": mix.sources}
    weight = {c: _weight(F.col(c), w, mix.other) for c, w in ways.items()}
    leaves = leaves.withColumn("can", F.when(F.least(*weight.values()) > 0, F.col("tokens") * mix.epochs).otherwise(F.lit(0)))
    budget = F.lit(mix.budget).cast("bigint") if mix.budget is not None else F.sum("tokens").over(Window.partitionBy())
    above = leaves.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("can").alias("can")).withColumn("above", budget)
    for c, parent in (("domain", []), ("lang", ["domain"]), ("source", ["domain", "lang"])):
        nodes = leaves.groupBy(*parent, c).agg(F.sum("tokens").alias("tokens"), F.sum("can").alias("can")) if c == "lang" else leaves
        nodes = nodes.join(above, parent) if parent else above
        nodes = nodes.select(*parent, F.col(c).alias("name"), "tokens", "can", weight[c].alias("weight"), "above")
        above = share(nodes, parent, F.col("above")).select(*parent, F.col("name").alias(c), F.col("given").alias("above"), *(["tokens"] if c == "source" else []))
    return above.select("domain", "lang", "source", "tokens", F.col("above").alias("given"))


def n_words(text: Column) -> Column:
    """Words of a text, its tokens here (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("bigint")


def mix_sources(docs: DataFrame, mix: Mix | None = None, keep: tuple[str, ...] = (), tokens: str | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of every row that is taken; copies counts its epochs.

    tokens names a column of docs that counts them (as count_tokens makes it); without one, tokens are words. Null and blank
    lang, source or domain are the name "unknown"; a null or blank text has no tokens and comes along at no cost where its place
    in the order falls inside the prefix. The order of an epoch is the hash of seed, epoch, doc_id and text; rows that tie (equal
    ids and texts) are all in or all out. A leaf with nothing but empty texts keeps all of them, if no weight above it is 0. An
    empty table gives an empty one. `keep` names further columns to carry.

    Leaves are counted before any shuffle of rows, and equal rows are one unit. The running sum over a leaf is made of runs of
    about RUN units: a leaf's units are dealt by their order into as many ranges as it needs, the ranges' sums are added up, and
    only the one range that the budget ends in is ordered unit by unit. A leaf with a third of all rows is so many ranges in as
    many tasks, and a row repeated so often is one unit, joined back where Spark splits a common key.
    """
    mix = mix or Mix()
    name = lambda c: F.coalesce(F.when(F.trim(c) != "", c), F.lit("unknown"))
    source, lang, text = name(F.col("source").cast("string")), name(F.col("lang").cast("string")), F.col("text").cast("string")
    domain = name(F.col("domain").cast("string")) if "domain" in docs.columns else domain_of(source)
    n_tokens = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)) if tokens else n_words(text)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain.alias("domain"), lang.alias("lang"), source.alias("source"), n_tokens.alias("n_tokens"), key.alias("unit"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = staged(rows, "mix-rows")
    leaf = ["domain", "lang", "source"]
    leaves = staged(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-counts")
    if leaves.select("domain").distinct().count() > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    given = leaf_budgets(leaves.drop("rows"), mix).join(leaves.select(*leaf, "rows"), leaf)
    out = F.least(*(_weight(F.col(c), w, mix.other) for c, w in zip(leaf, (mix.domains, mix.languages, mix.sources), strict=True))) == 0
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(F.when(out, F.lit(0)).otherwise(F.lit(1))).cast("bigint")
    given = staged(given.where(~(out & (F.col("given") == 0))).withColumn("whole", whole).withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens")).withColumn("runs", F.ceil(F.col("rows") / F.lit(RUN))), "mix-leaves")
    units = rows.groupBy(*leaf, "unit").agg(F.sum("n_tokens").alias("unit_tokens"))
    units = units.join(given.select(*leaf, "whole", "rest", "runs"), leaf)
    draw = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.col("unit")))
    part = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint") * F.col("runs") / F.lit(1 << 32)).cast("bigint")
    units = staged(units.withColumn("draw", draw).withColumn("part", part), "mix-units")
    sums = units.groupBy(*leaf, "part").agg(F.sum("unit_tokens").alias("part_tokens"))
    before = Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    placed = units.join(sums, [*leaf, "part"])
    inside = Window.partitionBy(*leaf, "part").orderBy("draw", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("before") + F.col("part_tokens") <= F.col("rest")
    clear = placed.where(ends | (F.col("before") > F.col("rest"))).withColumn("extra", ends.cast("int"))
    border = placed.where(~ends & (F.col("before") <= F.col("rest")))
    border = border.withColumn("extra", (F.col("before") + F.sum("unit_tokens").over(inside) <= F.col("rest")).cast("int"))
    taken = clear.unionByName(border).select(*leaf, "unit", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")
    same = F.bitwise_not(F.xxhash64("unit"))  # dealt anew on both sides, so that Spark can split a common unit
    taken = taken.select(*(F.col(c).alias(f"its_{c}") for c in leaf), F.col("unit").alias("its_unit"), "copies", same.alias("k"))
    joined = rows.withColumn("k2", same).join(taken, F.expr(" and ".join(["k2 = k", "unit = its_unit", *(f"{c} = its_{c}" for c in leaf)])))
    return joined.select("doc_id", *leaf, "n_tokens", "copies", *(F.col(f"kept_{c}").alias(c) for c in keep))


#: The same in DuckDB's SQL over a relation docs(doc_id, text, lang, source), with the default mix.
MIX_SQL = r"""
rows_ AS (
  SELECT doc_id, coalesce(nullif(regexp_replace(source, '[-_. ]*[0-9]+$', ''), ''), source) AS domain, lang, source, n_tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS unit
  FROM (SELECT doc_id, text, coalesce(CASE WHEN trim(lang) <> '' THEN lang END, 'unknown') AS lang, coalesce(CASE WHEN trim(source) <> '' THEN source END, 'unknown') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM docs)),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_rows FROM rows_ GROUP BY ALL),
d0 AS (SELECT domain AS name, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(2 * sum(tokens) AS BIGINT) AS can, 10 AS weight, CAST(sum(sum(tokens)) OVER () AS BIGINT) AS budget FROM leaves GROUP BY domain),
d1 AS (SELECT *, (budget - coalesce(sum(can) OVER w, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS rate FROM d0 WINDOW w AS (ORDER BY can / CAST(weight AS DOUBLE), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, arg_min(rate, row(can / CAST(weight AS DOUBLE), name)) FILTER (rate <= can / CAST(weight AS DOUBLE)) OVER () AS level FROM d1),
d3 AS (SELECT name AS domain, CASE WHEN level IS NULL THEN can ELSE least(can, CAST(floor(greatest(0, level) * weight) AS BIGINT)) END AS above FROM d2),
l0 AS (SELECT domain, lang AS name, CAST(2 * sum(tokens) AS BIGINT) AS can, CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 10 END AS weight, any_value(above) AS budget FROM leaves JOIN d3 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, (budget - coalesce(sum(can) OVER w, 0)) / CAST(sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS rate FROM l0 WINDOW w AS (PARTITION BY domain ORDER BY can / CAST(weight AS DOUBLE), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, arg_min(rate, row(can / CAST(weight AS DOUBLE), name)) FILTER (rate <= can / CAST(weight AS DOUBLE)) OVER (PARTITION BY domain) AS level FROM l1),
l3 AS (SELECT domain, name AS lang, CASE WHEN level IS NULL THEN can ELSE least(can, CAST(floor(greatest(0, level) * weight) AS BIGINT)) END AS above FROM l2),
s0 AS (SELECT domain, lang, source AS name, tokens, n_rows, 2 * tokens AS can, 10 AS weight, above AS budget FROM leaves JOIN l3 USING (domain, lang)),
s1 AS (SELECT *, (budget - coalesce(sum(can) OVER w, 0)) / CAST(sum(weight) OVER (PARTITION BY domain, lang) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS rate FROM s0 WINDOW w AS (PARTITION BY domain, lang ORDER BY can / CAST(weight AS DOUBLE), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, arg_min(rate, row(can / CAST(weight AS DOUBLE), name)) FILTER (rate <= can / CAST(weight AS DOUBLE)) OVER (PARTITION BY domain, lang) AS level FROM s1),
s3 AS (SELECT domain, lang, name AS source, tokens, CASE WHEN level IS NULL THEN can ELSE least(can, CAST(floor(greatest(0, level) * weight) AS BIGINT)) END AS given FROM s2),
g0 AS (SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END AS n_whole FROM s3),
o0 AS (SELECT r.*, g.n_whole, g.given - g.n_whole * g.tokens AS rest, md5('17:' || CAST(g.n_whole AS VARCHAR) || ':' || unit) AS draw FROM rows_ r JOIN g0 g USING (domain, lang, source)),
o1 AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, unit RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o0),
mixed AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(n_whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INT) AS copies FROM o1 WHERE n_whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0)
"""
