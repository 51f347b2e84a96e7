"""Merkle manifest of a dataset: every row's leaf, its group's root, the whole's root, and the proof between them.

A leaf is the SHA-256 of a row's columns. A group's leaves, in order, are hashed together
in runs of ``fanout`` until one node, the group's root, is left; the groups' roots in order
of their names give the dataset's root in the same way. A proof holds, level by level, the
other nodes of the run that a node is hashed with.

Leaves are sorted by ranges and numbered from the ranges' counts. Aligned stretches of
``fanout ** rise`` leaves are blocks; each is one small tree. Above the blocks runs a
butterfly exchange: in a round every block swaps its node with the blocks at the same
place of the other subtrees of its aligned group, and all of them hash the ancestors anew.
After a number of rounds that is the logarithm of the blocks every block holds the root
and its own upper proof; nothing is handed down. A round takes ``steps`` levels at once,
so its groups are ``fanout ** steps`` subtrees. A subtree that the end of the data cuts
short is asked at its blocks in turn. The groups' roots go through the same steps as one
more group.

Digests are hex text, and a node hashes its children's digests one after another. A run at
the end of a level may be shorter, one node even, which is hashed alone.

Memory is one block; nodes travel by joins on (group, block). Each round is
written to the checkpoint folder.

Defined cases: null columns are written as ``-``, so they differ from empty texts. The
null group comes first, null ids come first in their group. Rows of equal ids are ordered
by leaf; equal rows may exchange their places. A lone leaf is its group's root. An empty
table gives no rows. Extra columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import broadcast_if_small, cut_lineage
from .rows import column, ddl

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, RISE, STEPS = 2, 10, 4

_INDEX = (1 << 33) - 1  # monotonically_increasing_id: the partition above these bits, the row in it below


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and itself, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def tree(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The leaves and so many levels above them."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([node(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def others(level: list[str], at: int, fanout: int) -> str:
    """The rest of the run of node ``at``, left to right."""
    start = at - at % fanout
    return "".join(level[start:at] + level[at + 1 : start + fanout])


def depth(leaves: int, fanout: int) -> int:
    """Levels above so many leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def fold(leaf: str, siblings: str, places: Sequence[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a leaf and a proof lead to; ``places`` are (position, number of nodes) in the group and of the group."""
    now, at, size = leaf, 0, len(leaf)
    for position, nodes in places:
        while nodes > 1:
            start = position - position % fanout
            left = position - start
            rest = min(fanout, nodes - start) - 1
            run = siblings[at : at + size * rest]
            now = sha256((run[: size * left] + now + run[size * left :]).encode()).hexdigest()
            at += size * rest
            position, nodes = position // fanout, -(-nodes // fanout)
    return now


def _proofs(block: list[str], levels: int, fanout: int, upper: str) -> list[str]:
    """Proof of every leaf of a block, ``upper`` being what all share."""
    grown = tree(block, levels, fanout)
    above = [upper]
    for level in reversed(grown[:-1]):
        above = [others(level, i, fanout) + above[i // fanout] for i in range(len(level))]
    return above


def _numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position`` in the order of the columns ``order`` within ``key``, from 0, and ``leaves``, the key's rows."""
    ranged = cut_lineage(items.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()))
    part, index = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(_INDEX))
    placed = ranged.withColumn("part", part).withColumn("index", index)
    within = Window.partitionBy("key")
    runs = placed.groupBy("key", "part").agg(F.min("index").alias("first"), F.count("*").alias("n"))
    runs = runs.select(
        "key", "part", (F.coalesce(F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(within).alias("leaves"),
    )
    return placed.join(broadcast_if_small(runs), ["key", "part"]).withColumn("position", F.col("index") + F.col("shift")).drop("part", "index", "at", "shift")


def _exchange(state: DataFrame, fanout: int, steps: int) -> DataFrame:
    """Rounds of the butterfly over (key, block, blocks, levels, root): roots of the keys, and ``siblings`` above the blocks."""
    radix, stride = fanout**steps, 1
    state = cut_lineage(state.withColumn("siblings", F.lit("")))
    most = state.agg(F.max("blocks")).first()[0] or 0

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, roots, proofs = [], [], []
            for left, siblings, nodes, at in zip(*(batch.column(c).to_pylist() for c in ("levels", "siblings", "nodes", "place"))):
                rise = min(steps, left)
                for level in tree(nodes, rise, fanout)[:rise]:
                    siblings += others(level, at, fanout)
                    at //= fanout
                levels.append(left - rise)
                roots.append(tree(nodes, rise, fanout)[-1][0])
                proofs.append(siblings)
            kept = [batch.column(c) for c in ("key", "block", "blocks")]
            made = [pa.array(levels, pa.int32()), pa.array(roots, pa.string()), pa.array(proofs, pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names=["key", "block", "blocks", "levels", "root", "siblings"])

    while stride < most:
        offset = F.col("block") % stride
        start = F.col("block") - F.col("block") % (stride * radix)
        begin = lambda digit: start + digit * stride
        wanted = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(radix - 1)), lambda d: begin(d) < F.col("blocks")),
            lambda d: F.struct(d.alias("digit"), (begin(d) + offset % F.least(F.lit(stride), F.col("blocks") - begin(d))).alias("of")),
        )
        asked = state.select("key", F.col("block").alias("to"), F.explode(wanted).alias("want")).select("key", "to", "want.digit", F.col("want.of").alias("block"))
        heard = asked.join(state.select("key", "block", "root"), ["key", "block"]).groupBy("key", F.col("to").alias("block")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("digit", "root"))), lambda s: s["root"]).alias("nodes")
        )
        place = F.floor(F.col("block") / stride) % radix
        ready = state.join(heard, ["key", "block"]).withColumn("place", place)
        state = cut_lineage(ready.mapInArrow(climb, "key string, block bigint, blocks bigint, levels int, root string, siblings string"))
        stride *= radix
    return state


def _forest(items: DataFrame, order: list[str], carry: list[str], fanout: int, rise: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """Trees of the digests of each key: rows (key, carry, position, leaves, digest, siblings, tip) and the keys' roots (key, tip)."""
    size = fanout**rise
    placed = cut_lineage(_numbered(items, order).select("position", "key", F.floor(F.col("position") / size).alias("block"), "leaves", "digest", *carry))

    def block_root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        leaves = rows["leaves"][0].as_py()
        levels = depth(leaves, fanout)
        root = tree(rows["digest"].to_pylist(), min(rise, levels), fanout)[-1][0]
        made = [pa.array([-(-leaves // size)], pa.int64()), pa.array([max(0, levels - rise)], pa.int32()), pa.array([root])]
        return pa.table([rows["key"].slice(0, 1), rows["block"].slice(0, 1), *made], names=["key", "block", "blocks", "levels", "root"])

    state = placed.select("position", "key", "block", "leaves", "digest").groupBy("key", "block").applyInArrow(
        block_root, "key string, block bigint, blocks bigint, levels int, root string"
    )
    state = _exchange(state, fanout, steps)

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        levels = min(rise, depth(rows["leaves"][0].as_py(), fanout))
        siblings = _proofs(rows["digest"].to_pylist(), levels, fanout, above["siblings"][0].as_py())
        tip = pa.repeat(above["root"][0], rows.num_rows)
        return rows.select(kept).append_column("tip", tip).append_column("siblings", pa.array(siblings, pa.string()))

    kept = ["position", "key", "leaves", "digest", *carry]
    shape = placed.select(*kept, "block")  # ddl leaves the last column out
    upper = state.select("key", "block", "root", "siblings")
    rows = placed.groupBy("key", "block").cogroup(upper.groupBy("key", "block")).applyInArrow(prove, ddl(shape, [("tip", pa.string()), ("siblings", pa.string())]))
    return rows, state.where("block = 0").select("key", F.col("root").alias("tip"))


def manifest(
    df: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", doc_id: str = "doc_id", carry: dict[str, Column] | None = None,
    fanout: int = FANOUT, rise: int = RISE, steps: int = STEPS,
) -> DataFrame:
    """One row per row of df.

    doc_id, leaf, subroot (of its group), root, siblings (the proof: digests one after
    another), position and leaves (in its group), group_position and groups, and the
    columns ``carry`` names (new columns computed from df).
    """
    carry = carry or {}
    own = [f"carried{i}" for i in range(len(carry))]
    # The key keeps null apart from the empty text and sorts it first.
    key = F.when(column(group).isNull(), "").otherwise(F.concat(F.lit("="), column(group).cast("string")))
    leaves = cut_lineage(
        df.select(
            key.alias("key"), column(doc_id).alias("id"), leaf([column(c) for c in columns]).alias("digest"), F.monotonically_increasing_id().alias("row"),
            *[c.alias(name) for c, name in zip(carry.values(), own)],
        )
    )
    rows, tips = _forest(leaves, ["id", "digest", "row"], ["id", *own], fanout, rise, steps)
    tops, _ = _forest(tips.select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("tip").alias("digest")), ["name"], ["name"], fanout, rise, steps)
    tops = tops.select(F.col("name").alias("key"), F.col("position").alias("group_position"), F.col("leaves").alias("groups"), F.col("siblings").alias("last"), F.col("tip").alias("root"))
    return rows.join(broadcast_if_small(tops), "key").select(
        F.col("id").alias(doc_id), F.col("digest").alias("leaf"), F.col("tip").alias("subroot"), "root", F.concat("siblings", "last").alias("siblings"),
        "position", "leaves", "group_position", "groups", *[F.col(n).alias(name) for n, name in zip(own, carry)],
    )


def folded(proofs: DataFrame, leaf: str = "leaf", into: str = "folded_root", fanout: int = FANOUT) -> DataFrame:
    """Adds the root that column ``leaf`` and each row's proof lead to; one map."""
    inputs = [leaf, "siblings", "position", "leaves", "group_position", "groups"]
    names = proofs.columns
    plain = proofs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)])
    at = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fold(a, s, ((p, n), (q, m)), fanout) for a, s, p, n, q, m in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "made"])

    shape = plain.withColumn("last", F.lit(0))
    return plain.mapInArrow(run, ddl(shape, [("made", pa.string())])).toDF(*names, into)


def audited(df: DataFrame, every: int = 7, n_chars: str = "n_chars", doc_id: str = "doc_id", columns: Sequence[str] = COLUMNS, **settings) -> DataFrame:
    """Proofs of df's rows tried on rows of which every ``every``-th, by CRC-32 of the id, has ``n_chars`` raised by one.

    Adds folded_root and verified: whether it equals the root. A null id is never chosen,
    a null n_chars stays null.
    """
    changed = [column(c).cast("decimal(38,0)") + 1 if c == n_chars else column(c) for c in columns]
    chosen = F.crc32(column(doc_id).cast("string")) % every == 0
    own = manifest(df, columns, doc_id=doc_id, carry={"tampered": F.when(chosen, leaf(changed))}, **settings)
    tried = folded(own.withColumn("tried", F.coalesce("tampered", "leaf")), "tried", fanout=settings.get("fanout", FANOUT))
    return tried.withColumn("verified", F.col("folded_root") == F.col("root"))
