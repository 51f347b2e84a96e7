"""The pipeline's stages, each on what its predecessor kept."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from fenceline.llm import pii, quality

from .edge_tables import documents, stored
from .test_corpus_operators import brute_fingerprint, check_pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = f"{tmp_path}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        seen.append(name)
        if number < 4:
            assert docs.columns == columns
        if name == "quality":
            assert 0 < len(after) < len(before)
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            assert sum(i in kept for i, q in labels.items() if q) >= 0.95 * sum(labels.values())
        elif name == "near_duplicates":
            marks = [brute_fingerprint(r["text"]) for r in after]
            assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(marks) for b in marks[:i])
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        elif name == "pii":
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
            assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: pii.redacted(r["text"]) for r in before}
        elif name == "mixing":
            size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
            words = Counter()
            for r in after:
                words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            assert all(n <= 3 * size[i] for i, n in words.items()) and sum(words.values()) == pytest.approx(sum(size.values()), rel=0.05)
        else:
            check_pieces(after, [(r["doc_id"], r["text"]) for r in before])
    assert seen == ["quality", "near_duplicates", "pii", "mixing", "packing"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("rows", [None, []])
def test_edges(spark, tmp_path, rows):
    """Awkward rows and an empty table through every stage, with the columns of documents."""
    docs = documents(spark, *([] if rows is None else [rows]), clashes=False).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    (tmp_path / "in").mkdir()
    docs = stored(docs, tmp_path / "in")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    assert (docs.count() > 0) == (rows is None)


def test_rejected_by_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    vectors, model = quality.learned(docs, labels)
    good = {r["doc_id"] for r in quality.score(vectors, model, ["doc_id"]).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.good_documents(spark, docs, SF).collect()} == good


def test_texts_without_a_break(spark, tmp_path):
    """Very long numbers and very long white space through every stage."""
    prose = "The quick brown fox of the long road met an old friend near the river and they talked about the harvest. " * 20
    texts = ["0" * 5000 + ".1.1.1 " + prose, prose[::-1] + " 1." + "9" * 5000 + ".1.1", "a" + "\n" * 1_200_000 + "b " + prose.upper(), prose + " " * 1_200_000]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)], clashes=False).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    (tmp_path / "in").mkdir()
    docs = whole = stored(docs, tmp_path / "in")
    corpus_pipeline.private_documents(spark, docs, SF).write.parquet(f"{tmp_path}/private")
    private = spark.read.parquet(f"{tmp_path}/private")
    assert private.count() == len(texts) and private.where("text LIKE '%[IP]%'").count() == 1
    check_pieces(corpus_pipeline.packed_documents(spark, private, SF).collect(), [(r["doc_id"], r["text"]) for r in private.collect()])
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/again-{name}"
        stage(spark, whole, SF).write.parquet(path)
        whole = spark.read.parquet(path)
    assert whole.columns
