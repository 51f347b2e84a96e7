"""Winnowed fingerprints of whole texts.

Every k-gram of code points gets a 64-bit polynomial hash, built by doubling so that a
gram's hash comes from the hashes of its halves, then mixed and cut to 32 bits. In each
window of w consecutive grams the smallest hash is chosen, the rightmost among equals;
the chosen (hash, position) pairs are the fingerprint. Any passage of w + k - 1 code
points that two texts share is thereby seen in both: its window chooses the same hash,
and the positions tell where.

A text with fewer than w grams has one window; one with fewer than k code points has one
gram, the whole text; an empty text has no pairs. Likeness is Dice's: twice the number of
distinct hashes in common over the sum of their numbers; two empty fingerprints have 1.

``edited`` pairs every document with the next one in descending order of doc_id (the last
one with the first) and compares it with an edited text and with that next document.
Defined cases: a null text counts as empty. Equal doc_ids follow one another in
descending order of text; null doc_ids come last; doc_id is a number. A single document is its own next one.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .rows import TEXT, column, ddl, over_texts

# Dense enough that a text of forty code points keeps several hashes; about two of nine grams are kept.
GRAM, WINDOW = 8, 8

_BASE = 0x9E3779B97F4A7C15
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def _powers(n: int) -> tuple:
    return tuple(np.uint64(pow(_BASE, 1 << b, 1 << 64)) for b in range(n))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all windows of ``gram`` codes, as uint64."""
    whole, size, have = None, 0, codes.astype(np.uint64) + np.uint64(1)
    n = len(codes) - gram + 1
    with np.errstate(over="ignore"):
        for b, power in enumerate(_powers(gram.bit_length())):
            step = 1 << b
            if gram & step:  # append this stretch to what is gathered
                whole = have[size : size + n].copy() if whole is None else whole[:n] * power + have[size : size + n]
                size += step
            if step * 2 <= gram:
                have = have[: len(have) - step] * power + have[step:]
        whole = (whole ^ (whole >> np.uint64(30))) * _ONE
        whole = (whole ^ (whole >> np.uint64(27))) * _TWO
    return (whole ^ (whole >> np.uint64(31))) >> np.uint64(32)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Smallest key of every ``window`` consecutive ones, by doubling."""
    step = 1
    low, n = keys, len(keys) - window + 1
    while step * 2 <= window:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[:n], low[window - step : window - step + n])


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, by position."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    hashes = gram_hashes(codes, min(gram, len(codes)))
    spots = np.arange(len(hashes), dtype=np.uint64)
    keys = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - spots)  # smallest hash, then rightmost
    chosen = window_minima(keys, min(window, len(keys)))
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice's coefficient of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    return float(2 * np.count_nonzero(both[1:] == both[:-1]) / len(both))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of every whole text; one map, no shuffle."""

    def work(texts: list[str]):
        made = [winnow(t, gram, window) for t in texts]
        return [[h.tolist() for h, _ in made], [p.tolist() for _, p in made]]

    return over_texts(df, text, [doc_id], work, [("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])


def _written(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the following text's first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


FIELDS = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("positions", pa.list_(pa.int64())),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below value, by a search in two steps; null is below all."""
    if not bounds:
        return F.lit(0)
    stride = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.lit(bounds[::stride]), F.lit(bounds)
    at = F.greatest(F.size(F.filter(coarse, lambda b: b < value)) - 1, F.lit(0)) * stride
    inside = F.size(F.filter(F.slice(fine, (at + 1).cast("int"), F.lit(stride)), lambda b: b < value))
    return F.when(value.isNull(), F.lit(0)).otherwise(at + inside).cast("int")


def edited(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, buckets: int | None = None
) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness to these and to the next document.

    Documents go to ``buckets`` ranges of doc_id of about equal size (default: the
    session's shuffle partitions), each sorted; texts cross the network once. The first
    document of a range is also sent to the range before it, where its predecessor
    stands. Range bounds come from a quantile sketch over the ids alone.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(column(doc_id).alias("id"))
    kind = ids.schema["id"].dataType
    cuts = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("id", cuts, 10_000)).first()[0] if cuts else None
    bounds = sorted(set(found or []))
    # Heads of the ranges: one row each, at most ``buckets`` rows.
    heads = ids.groupBy(_bucket(F.col("id"), bounds).alias("b")).agg(F.max("id").alias("head")).collect()
    heads = sorted(((r["b"], r["head"]) for r in heads), reverse=True)
    guests = {}
    for (_, head), (host, _) in zip(heads, heads[-1:] + heads[:-1]):
        guests.setdefault(head, []).append(host)
    # Rows of null ids stand last, in range 0; the last range is followed by the first.
    visit = F.create_map(
        *[x for head, hosts in guests.items() if head is not None for x in (F.lit(head).cast(kind), F.lit(hosts))]
    ) if any(h is not None for h in guests) else None
    rows = df.select(
        column(doc_id).alias("id"), F.coalesce(column(text), F.lit("")).alias(TEXT), _bucket(column(doc_id), bounds).alias("home")
    )
    hosts = visit[F.col("id")] if visit is not None else F.lit(None).cast("array<int>")
    if None in guests:
        hosts = F.when(F.col("id").isNull(), F.lit(guests[None])).otherwise(hosts)
    none = F.array().cast("array<struct<b:int,guest:boolean>>")
    stays = F.concat(
        F.array(F.struct(F.col("home").alias("b"), F.lit(False).alias("guest"))),
        F.coalesce(F.transform(hosts, lambda b: F.struct(b.alias("b"), F.lit(True).alias("guest"))), none),
    )
    dealt = (
        rows.select("id", TEXT, F.explode(stays).alias("at"))
        .select("id", F.col("at.b").alias("b"), F.col("at.guest").alias("guest"), TEXT)
        .repartitionById(max(1, len(bounds) + 1), F.col("b"))
        .sortWithinPartitions("b", "guest", F.col("id").desc_nulls_last(), F.col(TEXT).desc())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken(name, key, value):
            own, spots = winnow(value, gram, window)
            return name, key, value, own, spots, np.unique(own)

        def finished(now, after):
            key, value, own, spots, distinct = now[1:]
            new = edited_text(value, after[2])
            new_own, _ = winnow(new, gram, window)
            return (
                key, len(value), hashlib.sha256(new.encode()).hexdigest(), _written(own), spots, _written(new_own),
                likeness(distinct, np.unique(new_own)), likeness(distinct, after[5]),
            )

        waiting = None  # the document whose next one is still to come
        for batch in batches:
            out = []
            for key, b, guest, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if guest and (waiting is None or waiting[0] != b):
                    continue  # a further copy of the id that the range looks for
                now = taken(b, key, value)
                if waiting is not None:
                    out.append(finished(waiting, now))
                waiting = None if guest else now
            kinds = [batch.schema.field(0).type, *[k for _, k in FIELDS]]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(columns, kinds)], names=["id", *[n for n, _ in FIELDS]])

    made = dealt.mapInArrow(run, ddl(rows.select("id", TEXT), FIELDS))
    return made.withColumnRenamed("id", doc_id)
