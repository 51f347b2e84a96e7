"""Merkle manifests against whole trees built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fenceline.llm import manifest
from fenceline.llm.queries import QUERIES

from .edge_tables import documents, nothing

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def brute_path(tree, at, fanout):
    path = []
    for level in tree[:-1]:
        start = at - at % fanout
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + fanout])))
        at //= fanout
    return path


def brute_audit(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified)"""
    groups = {}
    for r in rows:
        values = {c: r[c] for c in manifest.COLUMNS}
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(values.values()), values))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
    trees = [brute_tree([m[2] for m in groups[g]], fanout) for g in names]
    top = brute_tree([t[-1][0] for t in trees], fanout)
    out = []
    for number, (name, tree) in enumerate(zip(names, trees)):
        for i, (_, _, leaf, values) in enumerate(groups[name]):
            path = brute_path(tree, i, fanout) + brute_path(top, number, fanout)
            if values["doc_id"] is not None and zlib.crc32(str(values["doc_id"]).encode()) % 7 == 0 and values["n_chars"] is not None:
                values = {**values, "n_chars": values["n_chars"] + 1}
            now = brute_leaf(values.values())
            for left, right in path:
                now = digest(left + now + right)
            out.append((values["doc_id"], leaf, tree[-1][0], top[-1][0], digest("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def audited(df, **settings):
    found = manifest.audited(df, **settings)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()), key=repr)


# Blocks of 2, 4 and 27 leaves: several rounds, and subtrees that the end of the data cuts short.
@pytest.mark.parametrize("settings", [{}, {"rise": 1, "steps": 1}, {"rise": 2, "steps": 2}, {"fanout": 3, "rise": 3, "steps": 1}])
def test_documents(spark, settings):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_audit(docs.collect(), settings.get("fanout", 2))
    assert audited(docs, **settings) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 8, 9, 33])
def test_sizes(spark, rows):
    docs = spark.range(rows).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n_chars"), F.lit("text").alias("text")
    )
    assert audited(docs, rise=1, steps=1) == brute_audit(docs.collect())


@pytest.mark.parametrize("rise", [1, 10])
def test_edges(spark, rise):
    """Nulls in every column, repeated ids and rows, an empty language beside the null one, clashing columns."""
    docs = documents(spark).drop("n_chars").withColumn("n_chars", F.length("text").cast("bigint"))
    extra = docs.limit(1).withColumns({"doc_id": F.lit(77).cast("bigint"), "lang": F.lit("")})
    docs = docs.unionByName(extra).unionByName(extra.withColumns({"doc_id": F.lit(-5).cast("bigint"), "n_chars": F.lit(2**63 - 1), "text": F.lit(None).cast("string")}))
    assert audited(docs, rise=rise) == brute_audit(docs.collect())


def test_nothing(spark):
    docs = nothing(spark).drop("n_chars").withColumn("n_chars", F.lit(1))
    assert audited(docs) == []


def test_fold_and_places(spark):
    """What a manifest hands out is enough to check a row, and any change of it is seen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in manifest.manifest(docs, rise=3, steps=1).limit(50).collect():
        places = ((r["position"], r["leaves"]), (r["group_position"], r["groups"]))
        assert manifest.fold(r["leaf"], r["siblings"], places) == r["root"]
        assert manifest.fold(r["leaf"][::-1], r["siblings"], places) != r["root"]
        swapped = r["siblings"][64:128] + r["siblings"][:64] + r["siblings"][128:]
        assert manifest.fold(r["leaf"], swapped, places) != r["root"]


def test_query(spark):
    found = QUERIES["op13_manifest"](spark, SF)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_audit(spark.read.parquet(f"{SF}/documents.parquet").collect())
