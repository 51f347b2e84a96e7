"""SimHash near-duplicates linked through BK-trees.

A text's fingerprint takes the majority of each bit over the XXH64 hashes (seed 42) of
its word shingles. Equal fingerprints are folded into one first. Two fingerprints that
differ in at most ``radius`` bits agree in at least ``blocks - radius`` of ``blocks``
stretches of bits, so each fingerprint is sent to one shard for every such choice of
stretches, keyed by the bits there; all neighbours meet in some shard. Inside a shard a
BK-tree (children keyed by their Hamming distance to the parent) is asked for the
neighbours of each member; a search follows only edges within the radius of the
member's distance. Members that have been reached are retired, and branches without
members left are not entered, so a dense group costs about as much as it has members
and yields a chain of links, not all its pairs. Components of the links follow.

The trees stay with their shards instead of being broadcast: all fingerprints together
have no size bound.

Defined cases: a null text counts as empty; texts without words have fingerprint zero,
which links like any other; a text shorter than a shingle is one shingle. Rows with
repeated doc_ids are separate documents of that id. A component is named by its smallest
doc_id; one whose ids are all null has a null name. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut_lineage
from .components import components
from .rows import column, numbered, over_texts

SHINGLE, BITS, RADIUS, BLOCKS, SEED = 3, 64, 3, 5, 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64 bits as a signed number."""
    import xxhash

    words = text.encode().lower().split()  # ASCII white space; A to Z only
    if not words:
        return 0
    if len(words) < shingle:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big", signed=True)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), ">u8", n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 100_000):
        counts += np.unpackbits(hashes[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and the signed 64-bit ``fingerprint`` of every whole text; one map, no shuffle."""
    return over_texts(df, text, keep, lambda texts: [[fingerprint(t, shingle) for t in texts]], [("fingerprint", pa.int64())])


class BKTree:
    """Members are retired as they are reached; ``live`` counts what is left below each node."""

    def __init__(self, members: list[int]):
        self.values = members
        self.children: list[dict[int, int]] = [{} for _ in members]
        self.parent = [-1] * len(members)
        self.live = [1] * len(members)
        self.here = [True] * len(members)
        for k in range(1, len(members)):
            at = 0
            while True:
                self.live[at] += 1
                distance = (members[k] ^ members[at]).bit_count()
                down = self.children[at].get(distance)
                if down is None:
                    self.children[at][distance] = k
                    self.parent[k] = at
                    break
                at = down

    def retire(self, k: int) -> None:
        self.here[k] = False
        while k >= 0:
            self.live[k] -= 1
            k = self.parent[k]

    def within(self, value: int, radius: int) -> list[int]:
        """Members not yet retired within the radius of value."""
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.live[at]:
                continue
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius and self.here[at]:
                found.append(at)
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                stack += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]
            else:
                stack += [k for d, k in children.items() if distance - radius <= d <= distance + radius]
        return found


def links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the distinct members of a shard exactly as all pairs within the radius would."""
    if len(members) == 2:
        return [(members[0], members[1])] if (members[0] ^ members[1]).bit_count() <= radius else []
    tree, out = BKTree(members), []
    for k in range(len(members)):
        if not tree.here[k]:
            continue
        tree.retire(k)
        queue = [k]
        while queue:
            now = queue.pop()
            for other in tree.within(members[now], radius):
                tree.retire(other)
                queue.append(other)
                out.append((members[now], members[other]))
    return out


def shard_keys(value: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One key for each choice of ``blocks - radius`` stretches of the 64 bits: a number for the choice over its bits, hashed."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(value, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    return F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(*[parts[i] for i in chosen]).alias("bits")) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def near_links(values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fingerprint``) that join exactly those within the radius, step by step."""
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    shards = (
        values.select("fingerprint", F.explode(shard_keys(F.col("fingerprint"), radius, blocks)).alias("key"))
        .select(F.xxhash64("key.choice", "key.bits").alias("shard"), "fingerprint")
        .repartition("shard")
        .sortWithinPartitions("shard", "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << BITS) - 1

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            sides = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(sides[:, 0]), pa.array(sides[:, 1])], names=["a", "b"])

        rest_shard, rest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        found: list[tuple[int, int]] = []

        def settle(shard: np.ndarray, value: np.ndarray) -> None:
            starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            sizes = np.diff(np.append(starts, len(shard)))
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                found.extend(links([v & mask for v in dict.fromkeys(value[start : start + size].tolist())], radius))

        for batch in batches:
            shard = np.concatenate((rest_shard, batch.column(0).to_numpy()))
            value = np.concatenate((rest, batch.column(1).to_numpy()))
            cut = int(np.searchsorted(shard, shard[-1], side="left")) if len(shard) else 0  # the last shard may go on
            rest_shard, rest = shard[cut:], value[cut:]
            if cut:
                settle(shard[:cut], value[:cut])
                yield out(found)
                found = []
        if len(rest):
            settle(rest_shard, rest)
        yield out(found)

    return shards.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, keep: list[str] | None = None
) -> DataFrame:
    """doc_id (and ``keep``), fingerprint, component (its smallest fingerprint) and component_id (its smallest doc_id)."""
    marked = cut_lineage(fingerprints(df, [doc_id, *(keep or [])], text, shingle))
    # One row per distinct fingerprint from here on: copies meet in the aggregate, before the shuffle.
    distinct = cut_lineage(marked.groupBy("fingerprint").agg(F.min(column(doc_id)).alias("first")))
    group = components(near_links(distinct.select("fingerprint"), radius, blocks))
    # Smallest doc_id of each linked component; an unlinked fingerprint is its own component.
    linked = distinct.join(group.withColumnRenamed("node", "fingerprint"), "fingerprint")
    named = linked.groupBy("component").agg(F.min("first").alias("name"))
    names = linked.join(named, "component").select("fingerprint", "component", "name")
    whole = distinct.join(names, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("component", "fingerprint").alias("component"),
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("name")).alias("component_id"),
    )
    return marked.join(whole, "fingerprint").select(column(doc_id), *[column(c) for c in keep or []], "fingerprint", "component", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """All columns of docs, one row per component: its smallest doc_id (nulls last), the first row of that id.

    docs is read once and kept, with its rows' numbers, in the shared folder.
    """
    rows = numbered(docs, "__row")
    groups = near_duplicates(rows, doc_id, text, keep=["__row"], **settings)
    part = F.struct(column(doc_id).isNull().alias("none"), column(doc_id).alias("id"), F.col("__row"))
    chosen = groups.groupBy("component").agg(F.min(part).alias("chosen"))
    return rows.join(chosen.select(F.col("chosen.__row").alias("__row")), "__row", "left_semi").drop("__row")
