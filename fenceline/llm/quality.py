"""Quality scores by a regularised quadratic discriminant on transformed document statistics.

Every document becomes a short vector of statistics of its whole text, transformed
so that each is roughly bell-shaped (logarithms of sizes, arcsine square roots of
shares). Each class gets its mean and a covariance shrunk towards the average of
the classes and a floor on the diagonal. A score is the logistic of the difference
of the two log densities, each a Mahalanobis term plus a log determinant, both
taken from Cholesky factors that are computed once and carried with the model.

Defined cases: a null text counts as empty; an empty text has the zero vector and
so a score like any other. Rows without a label, with a null label or a label other
than 0 and 1 teach nothing; a repeated label row counts once. With labels of one
class only, every score is 0 or 1 for that class; with none, 0.5. Repeated document
rows are scored alike. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from .rows import column, ddl, over_texts

STATISTICS = (
    "log_words", "log_word_length", "upper", "digits", "marks", "shouts", "bars", "stops",
    "variety", "top_word", "stutter", "line_breaks", "repeated_lines", "spaces",
)

#: Bytes of plain prose that every text's shares are mixed with, so that a line of a few words is not far
#: out in any of them, and what such prose has of each. Words count as six bytes, lines as sixty.
PROSE = 100.0
TYPICAL = {"upper": 0.04, "stops": 0.025, "line_breaks": 0.008, "spaces": 0.165, "top_word": 0.05, "word_length": 5.0}

#: Shares of a class covariance that come from the mean of the classes and from its diagonal.
POOL, DIAGONAL, FLOOR = 0.1, 0.1, 1e-4


def _classes() -> np.ndarray:
    table = np.zeros((256, 9))
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~_=+<>{}[]\\/`", b"!?", b"|", b".,;:", b"\n", b" \t\r\x0b\x0c\n"]
    for k, members in enumerate(groups):
        table[list(members), k] = 1.0
    return table


_BYTES = _classes()


def _share(part: float, whole: float, typical: float = 0.0, prose: float = PROSE) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, (part + prose * typical) / (whole + prose)))))


def document_statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; zeros for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode(), np.uint8)
    upper, lower, digits, marks, shouts, bars, stops, breaks, spaces = np.bincount(raw, minlength=256) @ _BYTES
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    stutter = sum(map(str.__eq__, words, words[1:] + [""]))
    t, words_of, lines_of = TYPICAL, PROSE / 6, PROSE / 60
    return [
        float(np.log1p(n)),
        float(np.log((size - spaces + words_of * t["word_length"]) / (n + words_of))),
        _share(upper, upper + lower, t["upper"]),
        _share(digits, size),
        _share(marks, size),
        _share(shouts, size),
        _share(bars, size),
        _share(stops, size, t["stops"]),
        float(np.log1p(len(counts)) / np.log1p(n)),
        _share(max(counts.values()) - 1, n, t["top_word"], words_of),
        _share(stutter, n, 0.0, words_of),
        _share(breaks, size, t["line_breaks"]),
        _share(len(lines) - len(set(lines)), len(lines), 0.0, lines_of),
        _share(spaces, size, t["spaces"]),
    ]


def statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the array ``features`` of every row; one map, no shuffle."""
    return over_texts(df, text, [doc_id], lambda texts: [[document_statistics(t) for t in texts]], [("features", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Discriminant:
    """Per class: log share, mean, Cholesky factor of the shrunk covariance and half its log determinant."""

    shares: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    half_logdets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of x."""
        if not (self.shares[0] > 0 and self.shares[1] > 0):
            return np.full(len(x), 0.5 if self.shares == (0.0, 0.0) else float(self.shares[1] > 0))
        logs = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            logs.append(np.log(self.shares[k]) - self.half_logdets[k] - 0.5 * np.einsum("ij,ij->j", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Discriminant:
    """Learn from the rows of ``features`` whose id has a label.

    Only ids, labels and vectors meet in the join. Counts, sums and products are
    taken by one aggregate per class, so what reaches the driver is two rows.
    """
    d = len(STATISTICS)
    known = labels.select(column(doc_id).alias("__id"), column(label).cast("int").alias("__class")).where("__class in (0, 1)").distinct()
    rows = features.select(column(doc_id).alias("__id"), "features").join(known, "__id").select("__class", *[F.col("features")[i].alias(f"x{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("__class").agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )
    found = {r["__class"]: r for r in sums.collect()}  # at most two rows
    total = sum(r["n"] for r in found.values())
    means, spreads = np.zeros((2, d)), np.stack([np.eye(d)] * 2)
    for k, r in found.items():
        means[k] = [r[f"s{i}"] / r["n"] for i in range(d)]
        for i, j in pairs:
            spreads[k, i, j] = spreads[k, j, i] = r[f"p{i}_{j}"] / r["n"] - means[k, i] * means[k, j]
    pooled = spreads.mean(axis=0)
    factors, halves = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        own = (1 - POOL) * spreads[k] + POOL * pooled
        shrunk = (1 - DIAGONAL) * own + np.diag(DIAGONAL * np.diag(own) + FLOOR)
        factors[k] = np.linalg.cholesky(shrunk)
        halves[k] = np.log(np.diag(factors[k])).sum()
    shares = tuple(found[k]["n"] / total if k in found else 0.0 for k in (0, 1))
    return Discriminant(shares, means, factors, halves)


def held_out(doc_id: str = "doc_id"):
    """Rows kept for testing: crc32 of the id's text leaves no remainder by 5. A null id is not held out."""
    return F.coalesce(F.crc32(column(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score(features: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` from the array ``features``."""
    work = features.select(*[column(c).alias(f"kept{i}") for i, c in enumerate(keep)], "features")

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            made = pa.array(model.scores(x) if len(x) else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*work_names, "score"])

    work_names = work.columns[:-1]
    return work.mapInArrow(run, ddl(work, [("score", pa.float64())])).toDF(*keep, "score")


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Discriminant]:
    """The vectors of all documents, kept in the checkpoint folder, and the model of their labelled part."""
    vectors = cut_lineage(statistics(docs, doc_id, text))
    return vectors, fit(vectors.where(~held_out(doc_id)), labels, doc_id)


def keep_good(docs: DataFrame, model: Discriminant, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score at least ``least``, all columns unchanged."""

    def judge(texts: list[str]):
        x = np.array([document_statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        return [model.scores(x) >= least]

    return over_texts(docs, text, docs.columns, judge, [("__good", pa.bool_())], only="__good").drop("__good")
