"""Exact top-k inner products through a pivot-distance index.

Vectors are stored by their nearest pivot and their distance to it. For a query q and a
vector v at distances a and b from a pivot, the triangle inequality gives |q - v| >=
|a - b|, and q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2, so a region of vectors with known
ranges of distance and norm has a known ceiling for its scores. Each pivot's vectors are
cut by distance into annuli. A query goes to the annuli whose ceiling reaches its floor,
the k-th best score among a bounded sample of the vectors; within an annulus it walks
outwards from its own distance and stops where the ceiling falls below what it has.

The pivots are fitted on that sample; every vector is indexed. Annuli are described by
a fixed number of rows (pivots times rings). A heavy annulus is dealt over several tasks,
equal vectors included. Queries are numbered into blocks too, and a group is a block of
queries with a part of an annulus, so that neither side of it grows with the table; what
leaves a group is at most k rows per query, and the last ranking sees k rows per group and query.

Components become floor(scale * x), x as double; scores are exact integers (within 2**53).
Defined cases: vectors that are null, empty, or hold a null or non-finite component take
no part, nor do null ids. Only vectors of equal length are compared. Equal scores go to
the smaller id; repeated ids are separate candidates, except that a query never meets
rows of its own id; repeated queries of one id and vector count once. A query without candidates gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut_lineage
from .rows import column

K, SCALE, PIVOTS, RINGS, SAMPLE, BLOCK, QUERIES = 10, 1024, 16, 4, 4096, 8192, 16384


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and the integer vector ``v`` (as doubles) of the rows that take part."""
    x = F.transform(column(vector), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        df.where(column(vec_id).isNotNull() & column(vector).isNotNull())
        .select(column(vec_id).cast("bigint").alias("id"), x.alias("x"))
        .where((F.size("x") > 0) & sound)
        .select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first traversal of the sample from its first row."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def _ceiling(q2, v2, gap):
    """Most that a score can be; the slack covers rounding of distances."""
    return (q2 + v2 - np.maximum(gap - 1e-6 * (1.0 + np.sqrt(q2 + v2)), 0.0) ** 2) / 2.0 + 0.5


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def top_k(
    df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
    pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows of df; both tables have ``vec_id`` and ``vector``.

    ``sample`` bounds the rows used to fit pivots and floors, ``block`` the vectors of an
    annulus that one group holds and ``query_block`` its queries (both on average of a hash).
    """
    base = quantised(df, vec_id, vector, scale)
    parts = []
    # Lengths of vectors are few; each is a search of its own.
    for size, rows in sorted(tuple(r) for r in base.groupBy(F.size("v").alias("size")).count().collect()):
        own = base.where(F.size("v") == size)
        asked = quantised(queries, vec_id, vector, scale).where(F.size("v") == size).dropDuplicates(["id", "v"])
        parts.append(_search(own, asked, size, rows, k, pivots, rings, sample, block, query_block))
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _search(base: DataFrame, asked: DataFrame, size: int, rows: int, k: int, pivots: int, rings: int, sample: int, block: int, query_block: int) -> DataFrame:
    # A bounded sample by hashed ids, so that it does not depend on the order of rows. The share taken
    # keeps about four times the sample for the final cut, however many rows there are.
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    drawn = base.where(spot < int(min(1.0, 4 * sample / rows) * (1 << 30))).orderBy(spot, "id").limit(sample).toPandas()
    if not len(drawn):
        drawn = base.orderBy("id").limit(1).toPandas()
    fitted, fitted_ids = _matrix(drawn["v"]), drawn["id"].to_numpy()
    centres = choose_pivots(fitted, pivots)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"])
            d = _distances(x, centres) if len(f) else np.zeros((0, 1))
            near = d.argmin(axis=1)
            yield pd.DataFrame({"id": f["id"], "pivot": near.astype(np.int32), "d": d[np.arange(len(f)), near], "n2": (x**2).sum(axis=1) if len(f) else [], "v": [r.tobytes() for r in x]})

    indexed = cut_lineage(base.mapInPandas(place, "id bigint, pivot int, d double, n2 double, v binary"))
    # Ring bounds per pivot, then what each annulus holds: pivots x rings rows at most.
    cuts = {r["pivot"]: sorted(set(r["cuts"])) for r in indexed.groupBy("pivot").agg(F.percentile_approx("d", [i / rings for i in range(1, rings)], 1000).alias("cuts")).collect()}
    bounds = F.create_map(*[x for p, c in cuts.items() for x in (F.lit(p), F.array(*[F.lit(float(b)) for b in c]))])
    ringed = indexed.withColumn("ring", F.size(F.filter(bounds[F.col("pivot")], lambda b: b < F.col("d"))))
    annuli = ringed.groupBy("pivot", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("n2").alias("n2"), F.count("*").alias("n")).orderBy("pivot", "ring").collect()
    table = {c: np.array([r[c] for r in annuli], np.float64) for c in ("pivot", "lo", "hi", "n2", "n")}
    salts = np.maximum(1, -(-table["n"].astype(np.int64) // block))
    first = np.concatenate(([0], np.cumsum(salts)[:-1]))  # tasks are numbered through
    number = F.create_map(*[F.lit(x) for i, r in enumerate(annuli) for x in (r["pivot"] * rings + r["ring"], int(first[i]))])
    spread = F.create_map(*[F.lit(x) for i, r in enumerate(annuli) for x in (r["pivot"] * rings + r["ring"], int(salts[i]))])
    key = F.col("pivot") * rings + F.col("ring")
    dealt = ringed.select((number[key] + F.pmod(F.xxhash64("id", "v"), spread[key])).cast("int").alias("task"), "id", "d", "n2", "v")
    middle = centres[table["pivot"].astype(int)]

    blocks = max(1, -(-asked.count() // query_block))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"])
            for at in range(0, len(f), 512):
                q, ids = x[at : at + 512], f["id"].to_numpy()[at : at + 512]
                scores = q @ fitted.T
                scores[ids[:, None] == fitted_ids[None, :]] = -np.inf
                floor = np.partition(scores, -k, axis=1)[:, -k] if len(fitted_ids) >= k else np.full(len(q), -np.inf)
                d = _distances(q, middle)
                gap = np.maximum(np.maximum(table["lo"] - d, d - table["hi"]), 0.0)
                goes = _ceiling((q**2).sum(axis=1)[:, None], table["n2"], gap) >= floor[:, None]
                i, a = np.nonzero(goes)
                raw = np.array([r.tobytes() for r in q], dtype=object)
                yield pd.DataFrame({
                    "first": first[a], "last": first[a] + salts[a] - 1, "part": f["part"].to_numpy()[at : at + 512][i],
                    "id": ids[i], "d": d[i, a], "floor": floor[i], "v": raw[i],
                })

    numbered = asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    # A row per annulus leaves Python; the parts of a heavy one are listed outside it.
    routed = numbered.mapInPandas(route, "first int, last int, part int, id bigint, d double, floor double, v binary").select(
        F.explode(F.sequence("first", "last")).alias("task"), "part", "id", "d", "floor", "v"
    )
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values(["d", "id"])
            x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), size)
            ids, d, n2 = left["id"].to_numpy(), left["d"].to_numpy(), float(left["n2"].max())
            for qid, qd, floor, raw in zip(right["id"], right["d"], right["floor"], right["v"]):
                q = np.frombuffer(raw, np.float64)
                q2 = float(q @ q)
                got, got_ids = np.zeros(0), np.zeros(0, np.int64)
                lo = hi = int(np.searchsorted(d, qd))
                least = floor
                step = 1024
                while lo > 0 or hi < len(d):  # nearer side first, outwards
                    below = qd - d[lo - 1] if lo > 0 else np.inf
                    above = d[hi] - qd if hi < len(d) else np.inf
                    if _ceiling(q2, n2, max(0.0, min(below, above))) < least:
                        break
                    if below <= above:
                        part = slice(max(0, lo - step), lo)
                        lo = part.start
                    else:
                        part = slice(hi, min(len(d), hi + step))
                        hi = part.stop
                    scores = x[part] @ q
                    fit = np.flatnonzero((scores >= least) & (ids[part] != qid))
                    if len(fit):
                        got, got_ids = np.concatenate((got, scores[fit])), np.concatenate((got_ids, ids[part][fit]))
                        keep = _best(got, got_ids, k)
                        got, got_ids = got[keep], got_ids[keep]
                        if len(got) == k:
                            least = max(least, got[-1])
                out["query_id"] += [qid] * len(got)
                out["vec_id"] += got_ids.tolist()
                out["score"] += got.astype(np.int64).tolist()
        return pd.DataFrame(out)

    found = dealt.groupBy("task", "part").cogroup(routed.groupBy("task", "part")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
