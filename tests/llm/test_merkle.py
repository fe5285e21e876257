"""The manifest against a plain tree, its folding, odd rows and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from hearthline.llm import merkle
from hearthline.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_levels(nodes, fanout=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def plain_proof(levels, k, fanout=16):
    out = []
    for level in levels[:-1]:
        first = k - k % fanout
        out.append((level[first:k], level[k + 1 : first + fanout]))
        k //= fanout
    return out


def plain_manifest(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: h(*map(enc, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        own = leaf(r, r[1])
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, own, leaf(r, r[1].translate(low)) if tampered else own, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_levels([x[2] for x in sorted(groups[s])]) for s in order]
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(order):
        for k, (_, _, own, other, doc_id) in enumerate(sorted(groups[s])):
            steps = plain_proof(trees[g], k) + plain_proof(top, g)
            folded = other
            for left, right in steps:
                folded = h(*left, folded, *right)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], h(*(x for left, right in steps for x in (*left, *right))), folded, folded == top[-1][0]))
    return out


def rows_of(seed, sizes):
    rng, rows = random.Random(seed), []
    for s, n in sizes:
        rows += [(rng.randrange(10_000), rng.choice(["A Text é", "lower only", "", None, "Zz " * rng.randrange(40)]), rng.choice(["en", None]), s, rng.choice([3, None])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("rows", [
    rows_of(1, [("a", 300), (None, 17), ("", 1), ("é", 16), ("b", 2), *((f"s{k}", 1 + k % 3) for k in range(40))]),
    rows_of(2, [("one", 4200)]), rows_of(3, [("one", 16)]), [(5, "A", "en", "s", 1)], rows_of(4, [(f"s{k}", 1) for k in range(20)]),
    [(1, "Same", "en", "s", 4)] * 40 + [(None, None, None, None, None)] * 3 + [(9, "Long " * 200_000, "en", "s", 0)],
])
def test_manifest(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("leaf", "tree", "pos", "n", "group", "id", "steps", "up_tree", "_at", "_range")})
    out = merkle.manifest_digests(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_no_rows(spark):
    assert merkle.manifest_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_proofs_are_whole(spark):
    rows = rows_of(5, [("a", 50), ("b", 3)])
    out = merkle.merkle_manifest(spark.createDataFrame(rows, DOCS)).collect()
    for r in out:
        own = r.leaf
        for left, right in r.steps:
            own = h(bytes(left).hex(), own, bytes(right).hex())
        assert own == r.root
    assert {r.verified for r in out} == {True, False}


def test_sql(spark, tmp_path):
    rows = rows_of(6, [("a", 300), (None, 20), ("b", 1), ("c", 16)])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["op11_merkle_manifest"]).fetchall(), key=str) == sorted(plain_manifest(rows), key=str)
