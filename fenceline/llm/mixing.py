"""Mixing sources to target weights, by blocks of words.

Each source's words, its documents one after another, are cut into blocks of fixed
length. Sources share the corpus's size by weight; a target stops at ``most`` times its
source's size, and what is over goes to the others by weight until none is above. The
mix is a row of output shards of equal numbers of slots, one block per slot. A shard
gets the whole part of what it expects of each source, and the rest of its slots by a
multinomial draw over the fractional parts. A source's slots are numbered through all
shards; slot j is pass j div (blocks of the source), and j mod that is sent through a
pseudorandom permutation of the source's block numbers (swap-or-not rounds, keyed by
source and pass). So each pass takes every block once, and no block is taken more than
``most`` times. Slots and blocks meet in a join by source and block number.

Draws are hashes of seed, shard and slot: reruns agree. Only DataFrame functions are
used. A source's running word count is taken in ranges of hashed doc_id, then over the
ranges' totals, so a source with most of the documents is no single task's work.

What one task holds: the table of sources (one row per source, for targets), a source's
ranges, a source's shards. Defined cases: a null text counts as empty and has size 0; a
document without words is taken 0 times. Null sources form the last source, null doc_ids
follow the others. Repeated rows are documents of their own that lie side by side; equal
rows may exchange their places. A source without words has target 0. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut_lineage
from .rows import column, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, the last one also with what follows; and white space at the beginning.
SPACED, LEADING = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?", r"^[\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK, SLOTS, RANGE, SEED, ROUNDS = (5, 2, 1), 3, 64, 4096, 5_000, 7, 20

#: Parts of a slot in which wanted slots are counted.
FIXED = 1 << 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def _unit(*parts: Column) -> Column:
    """Hash of the parts as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights repeat over sources by code point, null last.

    Sharing what is over by weight until no target is above its limit ends where every
    target is the smaller of its limit and one common level times its weight. Sources by
    limit per weight: those that reach their limit come first, and the level is what they
    leave over the weights that remain, at the first source that stays below.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    placed = sources.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", F.element_at(listed, (F.col("number") % len(weights) + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("source_size") * most / F.col("weight"), "number")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(float(most))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = placed.withColumn("limit", limit).withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "number", "level"))).over(everything)["level"])
    return found.select("source", "number", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. size - 1: each round may swap a number with its mirror image, as a hash of the pair says."""

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), size) - x, size)
        swap = F.xxhash64(r, F.greatest(x, mirror), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


class Mix:
    """Tables of one mix. ``row`` names a column that numbers the rows, if there is one.

    sources    source, number, source_size, target, blocks
    documents  row, doc_id, number, size, start (its words' place in its source)
    slots      shard, number, pass, block: one row per drawn block
    pieces     row, number, block, first (word in the document), words
    """

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most=MOST, block=BLOCK, slots=SLOTS, seed=SEED, row: str | None = None):
        spark = df.sparkSession
        self.block, self.most, self.seed = block, most, seed
        # Numbers only from here on; texts are read once, and only for their word counts.
        counted = cut_lineage(
            df.select(
                (column(row) if row else F.monotonically_increasing_id()).alias("row"), column(doc_id).alias("doc_id"), column(source).cast("string").alias("source"),
                word_count(column(text)).alias("size"),
            )
        )
        sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        listed = targets(sizes, weights, most)
        self.sources = cut_lineage(
            listed.join(sizes.select("source", "n"), listed["source"].eqNullSafe(sizes["source"])).select(
                listed["source"], "number", "source_size", "target", "n", F.ceil(F.col("source_size") / block).alias("blocks")
            )
        )
        named = self.sources.select(F.col("source").alias("s"), "number", "n", F.ceil(F.col("n") / RANGE).alias("ranges"))
        placed = counted.join(named, counted["source"].eqNullSafe(named["s"])).select(
            "row", "doc_id", "number", "size", F.pmod(F.xxhash64("doc_id"), F.col("ranges")).alias("range")
        )
        totals = placed.groupBy("number", "range").agg(F.sum("size").alias("total"))
        earlier = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        begins = totals.select("number", "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("begin"))
        inside = Window.partitionBy("number", "range").orderBy(F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        ahead = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        self.documents = cut_lineage(
            ahead.join(begins, ["number", "range"]).select("row", "doc_id", "number", "size", (F.col("begin") + F.col("ahead")).alias("start"))
        )
        self.slots = self._draw(slots)
        spans = self.documents.where("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
        )
        low = F.greatest("start", F.col("block") * block)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        self.pieces = spans.select("row", "number", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))

    def _draw(self, slots: int) -> DataFrame:
        """Every slot's block."""
        # Slots wanted of each source in fixed point: sums of whole numbers do not depend on the order of rows.
        want = F.round(F.col("target") * F.col("blocks") / F.col("source_size") * FIXED).cast("bigint")
        plan = self.sources.where("blocks > 0").select("number", "blocks", want.alias("want"))
        total, sources = plan.agg(F.sum("want"), F.count("*")).first()
        if not sources:
            return self.sources.sparkSession.createDataFrame([], "shard bigint, number int, pass bigint, block bigint")
        per_shard = max(slots, 64 * sources)  # a shard has room for every source
        slots_in_all = max(1, round(total / FIXED))
        shards = -(-slots_in_all // per_shard)
        # One row per shard and source: at most a 64th of the slots. ``size``: slots of the shard.
        grid = plan.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))).withColumn(
            "size", F.least(F.lit(per_shard), F.lit(slots_in_all) - F.col("shard") * per_shard)
        )
        grid = grid.withColumn("expected", F.col("want") * F.col("size") / F.lit(float(total)))
        grid = grid.withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.col("whole"))
        within = Window.partitionBy("shard")
        upto = within.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        grid = (
            grid.withColumn("rest", F.col("size") - F.sum("whole").over(within))
            .withColumn("to", F.sum("part").over(upto))
            .withColumn("parts", F.max("to").over(within))
        )
        low = (F.col("to") - F.col("part")) / F.col("parts")
        high = F.when(F.col("number") == F.max("number").over(within), F.lit(1.0)).otherwise(F.col("to") / F.col("parts"))
        draws = F.when(F.col("rest") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("rest"))).otherwise(F.array().cast("array<bigint>"))
        grid = grid.withColumn("low", low).withColumn("high", high).withColumn(
            "drawn", F.size(F.filter(draws, lambda i: (_unit(F.lit(self.seed), F.col("shard"), i) >= F.col("low")) & (_unit(F.lit(self.seed), F.col("shard"), i) < F.col("high"))))
        )
        earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        counts = grid.withColumn("taken", F.col("whole") + F.col("drawn")).withColumn("before", F.coalesce(F.sum("taken").over(earlier), F.lit(0)))
        # The grid is small and its slots are many: deal it out before they are listed.
        parts = int(self.sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = (
            counts.where("taken > 0")
            .repartition(parts, "shard", "number")
            .select("shard", "number", "blocks", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("taken") - 1)).alias("slot"))
            .where(F.col("slot") < F.col("blocks") * int(self.most))  # a draw may exceed a full last pass by a few slots
            .select("shard", "number", "blocks", F.floor(F.col("slot") / F.col("blocks")).alias("pass"), F.pmod("slot", "blocks").alias("index"))
        )
        return each.select(
            "shard", "number", "pass", permuted(F.col("index"), F.col("blocks"), F.lit(self.seed), F.col("number"), F.col("pass")).alias("block")
        )

    def taken(self) -> DataFrame:
        """row and ``taken``: how many words of the document the mix holds, repeats counted."""
        times = self.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
        return self.pieces.join(times.hint("merge"), ["number", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))

    def drawn_pieces(self) -> DataFrame:
        """The mix itself: shard, number, pass, block, row, first, words.

        Slots are listed from few rows, whose size is all that Spark goes by when it
        broadcasts a side. They are as many as the mix has blocks, so both sides are dealt out.
        """
        return self.pieces.join(self.slots.hint("merge"), ["number", "block"])


def mix(df: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    m = Mix(df, **settings)
    facts = m.documents.join(m.sources.select("number", "source_size", "target"), "number")
    return facts.join(m.taken(), "row", "left").select(
        F.col("doc_id").alias(settings.get("doc_id", "doc_id")), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", **settings) -> DataFrame:
    """The mix as documents: for every pass of its source that holds words of a document, one row of its columns.

    A pass that holds the whole document leaves its text as it is; otherwise the text is
    its words in the blocks drawn, in order, each with the white space before it, and the
    last also with what follows it; only the first word of a cut beginning stands without.
    Documents without words are in no block and so not in the mix. docs is read once and
    kept, with its rows' numbers, in the shared folder.
    """
    rows = numbered(docs, "__row")
    m = Mix(rows, doc_id=doc_id, text=text, source=source, row="__row", **settings)
    runs = m.drawn_pieces().groupBy("row", "pass").agg(
        F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs")
    )
    runs = runs.join(m.documents.select("row", "size"), "row").select(
        F.col("row").alias("__row"), F.when(F.col("words") < F.col("size"), F.col("runs")).alias("__runs")
    )
    found = rows.join(runs, "__row")
    words = F.regexp_extract_all(column(text), F.lit(SPACED), F.lit(0))
    # The words are bound to a name first: within the inner function they would be found anew for every run.
    cut = F.transform(
        F.array(words),
        lambda w: F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(w, (r["first"] + 1).cast("int"), r["words"].cast("int")))), ""),
    )[0]
    cut = F.when(F.col("__runs")[0]["first"] > 0, F.regexp_replace(cut, LEADING, "")).otherwise(cut)
    found = found.withColumn("__text", F.when(F.col("__runs").isNull(), column(text)).otherwise(cut))
    new = {text: F.col("__text"), n_chars: F.length("__text").cast("bigint")}
    return found.select(*[new[c].alias(c) if c in new else column(c) for c in docs.columns])
