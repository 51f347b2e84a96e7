"""How far a corpus's sources differ in their vocabulary, by a frequent-pattern tree of term rows.

Per language the terms of at least ``least`` documents are kept. A group (language and
source) gives every kept term the whole number p = 1 + floor(scale * (count + prior) /
(N + prior * V)), N being its count over the V kept terms, and the language gives each a
number in the same way. Two such numbers differ by f = floor((p - q)^2 / (p + q)). The audit
lists, for each group, its distance to each other source of the language, the sum of f
over all kept terms, and the terms that it favours most over its language.

The distances of all pairs of sources never visit (pair, term) combinations that are
zero. With z for a source's number at count 0, the sum over the terms is V f(z, z') for
all terms alike, plus f(p, z') - f(z, z') for each term that one source has, counted by
distinct p, plus f(p, p') - f(p, z') - f(z, p') + f(z, z') for each term that both have.
The last part comes from the tree: a term's row is the path of its sources with their
numbers, in the order of the sources; equal rows are folded into one with a multiplicity,
and rows that begin alike share nodes. A node's multiplicity is that of all rows below it, so each
combination of a node and an ancestor is corrected once for all the terms that share it.
Rows are sorted by ranges of the path, so a task sees its part of the tree in depth-first
order: it holds the current path, and a node is settled when the path leaves it.

All arithmetic is on whole numbers and exact. Words are folded into counts inside the map
over texts, in a bounded memory. What one task holds: the sources of one term, the
sources of one language (for their order and ranks).

Defined cases: null text, language and source count as empty. A term is a run of letters
A to Z (lower-cased) and characters beyond ASCII. A group without terms has count 0
throughout; where a language keeps no term its distances are 0 and it lists no terms.
Repeated rows count as often as they stand; ties in a ranking go to the smaller item by
UTF-8 bytes. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import broadcast_if_small, cut_lineage
from .rows import column

LEAST, SCALE, PRIOR, TOP = 10, 1_000_000_000, 2, 10

#: Counts, and pairs of sources, that a task holds before it hands them on; texts beyond so many characters are read word by word.
HELD, PAIRS, LONG = 200_000, 100_000, 1_000_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: str) -> Counter[bytes]:
    """Counts of a text's terms, as UTF-8."""
    low = text.encode().lower()  # A to Z only
    return Counter(_TERM.findall(low)) if len(low) < LONG else Counter(m[0] for m in _TERM.finditer(low))


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, folded by task; one map."""
    blank = [F.coalesce(column(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                k = len(n)
                columns = [pa.repeat(lang, k), pa.repeat(source, k), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for of_lang, of_source, of_text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = terms(of_text)
                n, docs = held.setdefault((of_lang, of_source), (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return df.select(*blank).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _share(count: str, whole: str) -> Column:
    """p of a count; the division is on whole decimals."""
    return F.expr(f"1 + cast({SCALE} as decimal(38, 0)) * ({count} + {PRIOR}) div {whole}")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def gap(p: int, q: int) -> int:
    return (p - q) * (p - q) // (p + q)


class Paths:
    """The tree in depth-first order: rows must come sorted; ``sums`` gathers corrections by pair of sources."""

    def __init__(self):
        self.path: list[list[int]] = []  # (source, p, z, multiplicity)
        self.sums: dict[tuple[int, int], int] = {}

    def settle(self) -> None:
        """Close the last node of the path."""
        source, p, z, m = self.path.pop()
        if self.path:
            self.path[-1][3] += m
        sums = self.sums
        for ancestor, q, y, _ in self.path:
            pair = (ancestor, source)
            sums[pair] = sums.get(pair, 0) + m * (gap(q, p) - gap(q, z) - gap(y, p) + gap(y, z))

    def insert(self, row: list[int], m: int) -> None:
        """A row of (source, p, z) after (source, p, z), with its multiplicity."""
        path, shared = self.path, 0
        for node, at in zip(path, range(0, len(row), 3)):
            if node[0] != row[at] or node[1] != row[at + 1]:
                break
            shared += 1
        while len(path) > shared:
            self.settle()
        path.extend([*row[at : at + 3], 0] for at in range(3 * shared, len(row), 3))
        path[-1][3] += m

    def close(self) -> dict[tuple[int, int], int]:
        while self.path:
            self.settle()
        sums, self.sums = self.sums, {}
        return sums


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) from (lang, path, m), a before b; path is source, p and z of each of a term's sources."""
    sorted_rows = rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").select("lang", "m", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = Paths(), None

        def out() -> pa.RecordBatch:
            sums = tree.close()
            sides = np.array(list(sums), np.int64).reshape(-1, 2)
            # Sums as text: they are not bounded by 64 bits until all parts are together.
            columns = [pa.repeat(now or "", len(sums)), pa.array(sides[:, 0]), pa.array(sides[:, 1]), pa.array(map(str, sums.values()), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

        for batch in batches:
            for lang, m, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if lang != now or len(tree.sums) > PAIRS:
                    yield out()
                    now = lang
                tree.insert(path, m)
        yield out()

    found = sorted_rows.mapInArrow(run, "lang string, a bigint, b bigint, value string")
    return found.select("lang", "a", "b", F.col("value").cast("decimal(38,0)").alias("value"))


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: each group's distance to the others of its language, and its ``top`` terms."""
    counts = term_counts(df, text, lang, source).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    rows = cut_lineage(rows.where(F.col("docs") >= least).drop("docs"))
    kept = rows.select("lang", "term", "total", F.inline("row"))

    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("of_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    named = df.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    groups = (
        named.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["v", "of_lang", "size"])
        .withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint"))
        .withColumn("whole", F.col("size") + PRIOR * F.col("v")).withColumn("lang_whole", F.col("of_lang") + PRIOR * F.col("v"))
        .withColumn("z", F.when(F.col("v") > 0, _share("0", "whole")))
    )
    groups = cut_lineage(groups.select("lang", "source", "s", "v", "whole", "lang_whole", "z"))

    entries = kept.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", _share("n", "whole"))

    # Terms that a group favours.
    best = entries.withColumn("q", _share("total", "lang_whole")).where("p > q").withColumn("value", _gap("p", "q"))
    within = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    favoured = best.withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)

    # Distances: all terms alike, terms that one source has, terms that both have.
    sides = groups.select("lang", F.col("s").alias("b"), F.col("z").alias("y"))
    alike = groups.join(broadcast_if_small(sides), "lang").where("s <> b").select("lang", F.col("s").alias("a"), "b", F.when(F.col("v") > 0, F.col("v").cast("decimal(38,0)") * _gap("z", "y")).otherwise(0).alias("value"))
    own = entries.groupBy("lang", "s", "p", "z").agg(F.count("*").alias("m"))
    singles = own.join(broadcast_if_small(sides), "lang").where("s <> b").select("lang", F.col("s").alias("a"), "b", (F.col("m").cast("decimal(38,0)") * (_gap("p", "y") - _gap("z", "y"))).alias("value"))
    singles = singles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    paths = entries.groupBy("lang", "term").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("s", "p", "z"))), lambda e: F.array(e["s"], e["p"], e["z"]))).alias("path"))
    both = corrections(paths.groupBy("lang", "path").agg(F.count("*").alias("m"))).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    parts = alike
    for part in (singles, both):
        again = cut_lineage(part)
        parts = parts.union(again).union(again.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").cast("bigint").alias("value"))
    names = groups.select("lang", "s", "source")
    pairs = summed.join(broadcast_if_small(names.withColumnRenamed("s", "a")), ["lang", "a"]).join(
        broadcast_if_small(names.select("lang", F.col("s").alias("b"), F.col("source").alias("item"))), ["lang", "b"]
    )
    pairs = pairs.withColumn("rank", F.row_number().over(within))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(
        favoured.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )
