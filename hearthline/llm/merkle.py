"""Merkle manifest of a table: a tree of digests over each group of rows, one over the groups' roots, and every row's proof.

A run is up to `fanout` consecutive nodes, and the node above them is its digest. Proofs are made by pointer jumping: a run first
points at the run above and holds the siblings that it has there (its segment). Each round joins the runs with themselves on the
pointer, which appends the segment of the run pointed at and takes over its pointer: the distance to the ancestor doubles until
every run points past the root. A leaf's proof is its own siblings and its run's path, put together where leaves meet their run,
so that the paths are joined once for sixteen leaves and no leaf carries one through a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import staged

STEPS = "array<struct<left:binary,right:binary>>"
#: The tree over the groups' roots; groups are trees 0, 1, ...
TOP = -1


def field(x: Column) -> Column:
    """One value as it goes into a digest: `-` for null, else its length in UTF-8 bytes, a colon, and the value."""
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def digest(*parts: Column) -> Column:
    """H: lower-case hex sha256 of the parts concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _text(x: Column) -> Column:
    return F.lower(F.hex(x))


def proof_digest(steps: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(steps, leaf, lambda own, s: digest(_text(s["left"]), own, _text(s["right"])))


class Manifest(NamedTuple):
    """leaves: the key columns, leaf, other_leaf (of the tampered row; null where none is), subroot and steps (the proof); root: of
    the whole table, None for an empty one."""

    leaves: DataFrame
    root: str | None


def _runs(nodes: DataFrame, name: str, fanout: int) -> tuple[DataFrame | None, DataFrame]:
    """(runs of all levels of each tree, or None; tree, root of each tree). nodes: tree, pos, n (of the tree's level), digest.

    runs: tree, level (from 1), pos, n (runs of the tree's level), members (digests in order) and digest. A level is one aggregate
    over groups of at most `fanout` rows, with a sixteenth of the rows of the level below.
    """
    most = nodes.agg(F.max("n").alias("n")).first()["n"]  # one row
    done, found, level = nodes.where("n = 1").select("tree", F.col("digest").alias("root")), None, 0
    while most > 1:
        level, most = level + 1, -(-most // fanout)
        member = F.struct("pos", "digest")
        up = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("up")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("m"))
        up = up.select("tree", F.lit(level).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), F.col("m")["digest"].alias("members"))
        up = staged(up.withColumn("digest", digest(F.array_join("members", ""))), f"{name}-{level}")
        nodes = up.select("tree", "pos", "n", "digest")
        done = done.unionByName(nodes.where("n = 1").select("tree", F.col("digest").alias("root")))
        found = up if found is None else found.unionByName(up)
    return found, done


def _step(members: Column, place: Column) -> Column:
    """The siblings of a run's member, left and right of it, as bytes."""
    raw = lambda x: F.unhex(F.array_join(x, ""))
    place = place.cast("int")
    return F.struct(raw(F.slice(members, F.lit(1), place)).alias("left"), raw(F.slice(members, place + 2, F.greatest(F.size(members) - place - 1, F.lit(0)))).alias("right"))


def _paths(runs: DataFrame, trees: int, fanout: int) -> DataFrame:
    """Each run with its path: the steps from its digest up to the root of all.

    up_* is the run that a run points at (null: past the root). After a round the pointers reach twice as far, and only runs at
    least that high are pointed at, so the side looked up shrinks by the power of the fanout: a run is pointed at by as many rows
    as lie below it at that distance, and where these are many, the runs pointed at are few enough for Spark to broadcast.
    """
    whole = F.col("n") == 1  # the root of its tree
    top = (F.col("tree") == TOP) | (F.lit(trees) == 1)
    up = lambda inside, above: F.when(~whole, inside).when(~top, above)
    place = up(F.col("pos") % fanout, F.col("tree") % fanout)
    own = runs.select(
        "tree", "level", "pos", "members", place.alias("place"), up(F.col("tree"), F.lit(TOP).cast("bigint")).alias("up_tree"),
        up(F.col("level") + 1, F.lit(1)).alias("up_level"), up(F.floor(F.col("pos") / fanout), F.floor(F.col("tree") / fanout)).alias("up_pos"),
    )
    look = lambda df, *more: df.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("pos").alias("p"), *more)
    at = (F.col("up_tree") == F.col("t")) & (F.col("up_level") == F.col("l")) & (F.col("up_pos") == F.col("p"))
    first = own.join(look(runs, F.col("members").alias("of")), at, "left")
    steps = F.when(F.col("t").isNotNull(), F.array(_step(F.col("of"), F.col("place")))).otherwise(F.array()).cast(STEPS)
    paths = staged(first.select("tree", "level", "pos", "members", steps.alias("steps"), "up_tree", "up_level", "up_pos"), "merkle-paths")
    distance = 1
    while paths.where("up_tree is not null").limit(1).count():
        there = look(paths.where((F.col("tree") == TOP) | (F.col("level") > distance)), F.col("steps").alias("s"), *(F.col(f"up_{c}").alias(f"next_{c}") for c in ("tree", "level", "pos")))
        joined = paths.join(there, at, "left")
        paths = staged(joined.select("tree", "level", "pos", "members", F.concat("steps", F.coalesce("s", F.array().cast(STEPS))).alias("steps"), *(F.col(f"next_{c}").alias(f"up_{c}") for c in ("tree", "level", "pos"))), "merkle-paths")
        distance *= 2
    return paths.select("tree", "level", "pos", "members", "steps")


def build(rows: DataFrame, fanout: int = 16) -> Manifest:
    """The manifest of rows(group, id, leaf, other_leaf): groups by value (null first), leaves by id (null first), then leaf."""
    placed = number_rows(rows, ["id", "leaf"], ["group"], "pos")
    sizes = staged(placed.groupBy("group").agg(F.count("*").alias("n")), "merkle-groups")
    groups = number_rows(sizes, ["group"], [], "tree")
    trees = sizes.count()
    if trees == 0:
        return Manifest(rows.select(*rows.columns, F.lit(None).cast("string").alias("subroot"), F.array().cast(STEPS).alias("steps")).limit(0), None)
    named = groups.select(F.col("group").alias("g"), "tree", "n")
    leaves = staged(placed.join(named, F.col("group").eqNullSafe(F.col("g"))).drop("g"), "merkle-leaves")
    runs, subroots = _runs(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")), "merkle-runs", fanout)
    subroots = staged(subroots, "merkle-subroots")
    above, root = _runs(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("bigint").alias("n"), F.col("root").alias("digest")), "merkle-top", fanout)
    root = root.first()["root"]  # one row
    of = subroots.select(F.col("tree").alias("r"), F.col("root").alias("subroot"))
    leaves = leaves.join(of, F.col("tree") == F.col("r")).drop("r")
    runs = above if runs is None else runs if above is None else runs.unionByName(above)
    if runs is None:  # one leaf
        return Manifest(leaves.select(*rows.columns, "subroot", F.array().cast(STEPS).alias("steps")), root)
    paths = _paths(runs, trees, fanout).where((F.col("level") == 1))
    paths = paths.select(F.col("tree").alias("t"), F.col("pos").alias("p"), "members", F.col("steps").alias("path"))
    alone = F.col("n") == 1  # a group's only leaf is a member of the tree over groups
    at = (F.when(alone, F.lit(TOP).cast("bigint")).otherwise(F.col("tree")) == F.col("t")) & (F.floor(F.when(alone, F.col("tree")).otherwise(F.col("pos")) / fanout) == F.col("p"))
    own = _step(F.col("members"), F.when(alone, F.col("tree")).otherwise(F.col("pos")) % fanout)
    return Manifest(leaves.join(paths, at).select(*rows.columns, "subroot", F.concat(F.array(own), "path").cast(STEPS).alias("steps")), root)


def merkle_manifest(docs: DataFrame, fanout: int = 16, every: int = 5) -> DataFrame:
    """doc_id, source, leaf, subroot, root, steps (the proof), folded_root and verified of every row.

    A leaf is H of doc_id, source, lang, n_chars and text. Leaves of a source ascend by doc_id (null first), rows of one id by
    their leaf, so that repeated rows are leaves side by side; null and '' are different sources, null first. Where `every` divides
    the crc32 of doc_id (a null id: nowhere), the root is folded from a tampered row, whose text has its A-Z in lower case: null
    texts and those without A-Z verify all the same. Every row's whole text is read once and goes no further than its digest.
    Other columns take no part. An empty table gives an empty one, and one row is its own root, with an empty proof.
    """
    text = F.col("text").cast("string")
    fields = [F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("bigint")]
    leaf = lambda t: digest(*(field(x) for x in (*fields, t)))
    tampered = F.crc32(fields[0].cast("string")) % every == 0
    rows = docs.select(fields[1].alias("group"), fields[0].alias("id"), leaf(text).alias("leaf"), F.when(tampered, leaf(lowered(text))).alias("other_leaf"))
    found = build(staged(rows, "merkle-rows"), fanout)
    root = F.lit(found.root).cast("string")
    folded = fold(F.coalesce("other_leaf", "leaf"), F.col("steps"))
    out = found.leaves.select(F.col("id").alias("doc_id"), F.col("group").alias("source"), "leaf", "subroot", root.alias("root"), "steps", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """The manifest with each proof as one digest."""
    return merkle_manifest(docs).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


def merkle_sql(levels: int = 6, fanout: int = 16) -> str:
    """The same in DuckDB's SQL over documents, for groups and numbers of groups up to fanout ** levels: a node alone on its level
    passes through, others are hashed run by run; a leaf looks up its ancestor's siblings on each level by its place."""
    enc = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(enc(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"base AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS other_leaf FROM documents)"]
    out.append("leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base)")

    def tree(name: str, source: str) -> str:
        nodes = source
        for k in range(levels):
            side = f"PARTITION BY tree, pos // {fanout} ORDER BY pos ROWS BETWEEN"
            out.append(f"{name}{k} AS (SELECT tree, pos, d, n, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}))")
            nodes = f"(SELECT tree, pos // {fanout} AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d FROM {name}{k} GROUP BY tree, pos // {fanout})"
        return nodes

    out.append(f"subroots AS (SELECT tree, d FROM {tree('a', '(SELECT tree, pos, leaf AS d FROM leaves)')})")
    out.append(f"roots AS (SELECT d AS root FROM {tree('b', '(SELECT 0 AS tree, tree AS pos, d FROM subroots)')})")
    joins = "".join(f" JOIN a{k} ON a{k}.tree = x.tree AND a{k}.pos = x.pos // {fanout**k}" for k in range(levels)) + "".join(f" JOIN b{k} ON b{k}.pos = x.tree // {fanout**k}" for k in range(levels))
    names, folds = [f"{t}{k}" for t in "ab" for k in range(levels)], ["coalesce(x.other_leaf, x.leaf) AS f0"]
    folds += [f"CASE WHEN l{k} IS NULL THEN f{k} ELSE sha256(l{k} || f{k} || r{k}) END AS f{k + 1}" for k in range(len(names))]
    sides = ", ".join(f"{x}.l AS l{k}, {x}.r AS r{k}" for k, x in enumerate(names))
    out.append(f"found AS (SELECT x.doc_id, x.leaf, x.other_leaf, s.d AS subroot, root, {sides} FROM leaves x JOIN subroots s ON s.tree = x.tree CROSS JOIN roots{joins})")
    proof = " || ".join(f"coalesce(l{k} || r{k}, '')" for k in range(len(names)))
    out.append(f"folded AS (SELECT x.doc_id, x.leaf, x.subroot, x.root, sha256({proof}) AS proof_sha256, {', '.join(folds)} FROM found x)")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(names)} AS folded_root, f{len(names)} = root AS verified FROM folded"
