"""Secret scans with corpus-wide ownership of every candidate value.

Candidates are found by patterns in the JVM. A value that many repositories and owners
carry is an example that people copy; one that stays with a single owner looks live. So
the hashes of all candidate values are counted by distinct repositories and owners over
the whole corpus, and every candidate gets a verdict from its counts.

Base kinds: assign, access, hex. Further kinds: pem (a private key's opening line), jwt
(three dotted base64url parts), pat (prefixed platform tokens), entropy-free by design.
Positions come from the lengths of what lies between matches, summed per document.

Only DataFrame functions are used. Documents without matches, nearly all, take part in
no shuffle. Rows of one value are folded to (value, repository, owner) before they are
counted; verdicts return in a join whose large keys adaptive execution splits.

Defined cases: a null text counts as empty. A null owner or repository is one of its own.
Repeated rows are documents of their own and add nothing to distinct counts. Equal texts
of one owner have equal rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut_lineage
from .rows import column

#: kind -> (pattern, group of the value, least length of the value); listed order settles ties of position.
#: The first three are the base kinds. For access and hex a pattern with the least length finds what the
#: open pattern would leave after dropping short runs, as a shorter run inside a run is shorter still.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "pat": (r"(?:ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-)[A-Za-z0-9_-]{20,}", 0, 1),
}
BASE = ("assign", "access", "hex")

#: A value held by more owners than this is a copied example.
OWNERS = 1


def _matches(text: Column) -> Column:
    """Array of (kind, order of the kind, gaps before the matches, matches, values), one entry per kind that occurs."""
    entries = []
    for rank, (kind, (pattern, group, _)) in enumerate(KINDS.items()):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        entries.append(
            F.when(
                text.rlike(pattern),
                F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), gaps.alias("gaps"), F.transform(hits, lambda x: F.length(x)).alias("sizes"), values.alias("values")),
            )
        )
    return F.array_compact(F.array(*entries))


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, candidates): every row as (row, doc_id), and every candidate as (row, doc_id, kind, rank, start, end, value, owner, repository).

    The scan over the texts is made once and kept in the checkpoint folder without the texts.
    """
    scanned = cut_lineage(
        df.select(
            F.monotonically_increasing_id().alias("row"), column(doc_id).alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), column(owner).cast("string")), F.lit("")).alias("owner"),
            F.coalesce(F.concat(F.lit("="), column(repository).cast("string")), F.lit("")).alias("repository"),
            _matches(F.coalesce(column(text), F.lit(""))).alias("found"),
        )
    )
    each = (
        scanned.where(F.size("found") > 0)
        .select("row", "doc_id", "owner", "repository", F.explode("found").alias("f"))
        .select("row", "doc_id", "owner", "repository", "f.kind", "f.rank", F.posexplode(F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.sizes")).alias("gap"), F.col("f.sizes").alias("size"), F.col("f.values").alias("value"))).alias("at", "m"))
    )
    upto = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto)).select(
        "row", "doc_id", "owner", "repository", "kind", "rank", (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.value").alias("value"),
    )
    least = F.create_map(*[F.lit(x) for kind, (_, _, n) in KINDS.items() for x in (kind, n)])
    return scanned.select("row", "doc_id"), placed.where(F.length("value") >= least[F.col("kind")])


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repositories, n_owners and n_places of every candidate value."""
    pairs = found.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("places"))
    return pairs.groupBy("value_hash").agg(
        F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("places").alias("n_places")
    )


def secrets(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "source", owners: int = OWNERS
) -> DataFrame:
    """One row per document: counts per kind, digest of base spans, all spans, and how many spans look live or copied."""
    documents, found = candidates(df, doc_id, text, owner, repository)
    found = cut_lineage(found.withColumn("value_hash", F.sha2("value", 256)).drop("value"))
    judged = found.join(ownership(found), "value_hash").withColumn("live", F.col("n_owners") <= owners)
    span = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("text"))
    base = F.col("kind").isin(*BASE)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: s["text"]), ",")

    kinds = list(KINDS)
    per_row = judged.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds],
        joined(F.collect_list(F.when(base, span))).alias("base"),
        joined(F.collect_list(span)).alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )
    counts = [*[f"n_{k}" for k in kinds], "n_live", "n_copied", "most_owners", "most_repositories"]
    return documents.join(per_row, "row", "left").select(
        F.col("doc_id").alias(doc_id),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
