"""Byte-level BPE against the plain rule and the public library."""

import hashlib
import random
import struct
from array import array

import pytest
from hypothesis import given, settings, strategies as st

from fenceline.llm import bpe
from fenceline.llm.queries import QUERIES
from fenceline.llm.vocabulary import ranks, splitting_pattern, vocabulary_path

from .edge_tables import documents, nothing

SF = "/root/testdata/sf0.001"
PATH = vocabulary_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=splitting_pattern(), mergeable_ranks=ranks(PATH), special_tokens={})


def numbers(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def one(own, text):
    return own.encode([text])[0]


def brute_word(word, own):
    """Merge the leftmost pair of lowest rank until none is left."""
    if word in own:
        return [own[word]]
    parts = [bytes([b]) for b in word]
    while True:
        found = min(((own[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own), default=None)
        if found is None:
            return [own[p] for p in parts]
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeé日\n\t 's0123🙂<|endoftext>", max_size=80) | st.text(max_size=40))
def test_random_texts(text):
    import regex

    own, rank = bpe.vocabulary(PATH), ranks(PATH)
    want = [i for w in regex.findall(splitting_pattern(), text) for i in brute_word(w.encode(), rank)]
    assert numbers(one(own, text)) == want
    assert own.decode(one(own, text)) == text.encode()


# A small vocabulary in which a merge may open a pair of lower rank, and pairs of one rank overlap.
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=150), st.permutations(["ab", "bc", "ca", "aa", "bb", "abc", "aaa", "bca", "abab", "aab", "cab", "abcabc", "aaaa"]))
def test_any_order_of_ranks(text, order):
    rank = {bytes([b]): b for b in range(256)} | {w.encode(): 256 + i for i, w in enumerate(order)}
    made = bpe.Bpe(rank, r"(?s).+")
    assert numbers(one(made, text)) == brute_word(text.encode(), rank)
    assert not made.queue.top and not made.queue.rows and not any(made.queue.low) and not any(made.queue.middle)


def test_rank_queue():
    rng = random.Random(3)
    queue, held = bpe.RankQueue(200_000), []
    for _ in range(20_000):
        if held and rng.random() < 0.5:
            assert queue.pop() == held.pop(held.index(min(held)))
        else:
            entry = (rng.choice([rng.randrange(200_000), rng.randrange(70)]), rng.randrange(10_000))
            held.append(entry)
            queue.add(*entry)
        if len(held) > 300:
            while held:
                assert queue.pop() == held.pop(held.index(min(held)))
    while held:
        assert queue.pop() == held.pop(held.index(min(held)))
    assert queue.pop() is None
    queue.put(5, bpe.Bucket(array("i", [1, 4])))
    queue.add(5, 2)
    assert [queue.pop() for _ in range(4)] == [(5, 1), (5, 2), (5, 4), None]


def test_long_words(own, library):
    rng = random.Random(1)
    for alphabet in ("a", "ab", "abcdefgh", "aé", "日本"):
        for size in (63, 64, 500, 20_000):
            text = "".join(rng.choices(alphabet, k=size))
            assert numbers(one(own, text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" + "\n" * 2_000_000 + "b", " " * 2_000_000, "x" * 2_000_000, "0" * 1_000_000 + ".1.1.1"])
def test_runs_without_a_break(own, text):
    ids = one(own, text)
    assert own.decode(ids) == text.encode() and len(ids) // 4 <= len(text)  # blanks have no merges


def test_memory_does_not_change_ids(monkeypatch, own):
    import pyarrow.parquet as pq

    made = bpe.Bpe(ranks(PATH), splitting_pattern())
    made.words = bpe.Memory(8)
    for text in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist():
        assert one(made, text) == one(own, text)
        assert len(made.words.new) <= 8 and len(made.words.old) <= 8


def test_query(spark, library):
    found = {r["doc_id"]: r for r in QUERIES["op11_bpe"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text)
        r = found[doc_id]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_rows(spark, own):
    docs = documents(spark).withColumnRenamed("start", "ids")
    texts = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert {(r["doc_id"], bytes(r["bytes"]).decode()) for r in back} == texts and len(back) == docs.count()
    assert bpe.encoded(docs, back=True).select("doc_id", "bytes").exceptAll(bpe.decoded(bpe.encoded(docs))).count() == 0
    assert bpe.decoded(bpe.encoded(nothing(spark))).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert bytes(bpe.decoded(nulls).first()["bytes"]) == b""


def test_bytes_must_be_entries():
    with pytest.raises(ValueError):
        bpe.Bpe({b"a": 0}, ".")
