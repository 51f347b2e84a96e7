"""Bounded-space online packing of token ids into sequences of fixed length.

A task reads its documents one after another and keeps a fixed number of windows
open. A document longer than a window fills whole sequences first. What is left is
placed into the open window that it fits best. When none can hold it and all windows
are in use, the fullest is topped up with the head of the piece and emitted, and the
rest of the piece is placed the same way. At the end of the partition the leftovers
are merged: fullest first, cut to full sequences; the last rest is cut into powers of
two (or stays one padded sequence, with ``powers=False``).

Memory is the open windows and one batch of texts. There is no shuffle. A partition
that is read again after a lost executor gives the same sequences, as their ids
count on from the partition's number.

Defined cases: a null text counts as empty; an empty text is one piece that holds
only the closing id. Each row of the input is a document of its own, also where
doc_ids repeat. Empty input gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .rows import TEXT, column, ddl
from .vocabulary import encoder, vocabulary_path

LENGTH, WINDOWS = 1024, 64

FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class Packer:
    """Open windows of one partition; ``done`` gathers the pieces of emitted sequences.

    A piece is (document, start, ids, document's tokens); ids are 4 bytes each.
    """

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS, first_id: int = 0):
        self.length, self.most, self.next_id = length, windows, first_id
        self.open: list[tuple[int, list]] = []  # (free tokens, pieces)
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for document, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.done.append((document, start, n, ids, tokens, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, document, ids: bytes) -> None:
        tokens, size = len(ids) // 4, 4 * self.length
        at = 0
        while len(ids) - at >= size:
            self.emit([(document, at // 4, ids[at : at + size], tokens)])
            at += size
        if at < len(ids):
            self.place(document, at // 4, ids[at:], tokens)

    def place(self, document, start: int, ids: bytes, tokens: int) -> None:
        n = len(ids) // 4
        best = min((k for k, (free, _) in enumerate(self.open) if free >= n), key=lambda k: self.open[k][0], default=None)
        if best is not None:
            free, pieces = self.open[best]
            pieces.append((document, start, ids, tokens))
            if free == n:
                self.emit(pieces)
                del self.open[best]
            else:
                self.open[best] = (free - n, pieces)
        elif len(self.open) < self.most:
            self.open.append((self.length - n, [(document, start, ids, tokens)]))
        else:
            k = min(range(self.most), key=lambda k: self.open[k][0])
            free, pieces = self.open.pop(k)
            self.emit([*pieces, (document, start, ids[: 4 * free], tokens)])
            self.place(document, start + free, ids[4 * free :], tokens)

    def close(self, powers: bool = True) -> None:
        """Merge the leftovers."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]
        self.open = []
        rest = sum(len(p[2]) for p in left) // 4
        sizes = [self.length] * (rest // self.length)
        if last := rest % self.length:
            sizes += [1 << b for b in reversed(range(last.bit_length())) if last >> b & 1] if powers else [last]
        left.reverse()
        for size in sizes:
            pieces, want = [], size
            while want:
                document, start, ids, tokens = left.pop()
                take = min(want, len(ids) // 4)
                pieces.append((document, start, ids[: 4 * take], tokens))
                want -= take
                if 4 * take < len(ids):
                    left.append((document, start + take, ids[4 * take :], tokens))
            self.emit(pieces)


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    windows: int = WINDOWS,
    close_id: int = 0,
    powers: bool = True,
    path: str | None = None,
    rank_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    rank_path = rank_path or vocabulary_path("byte_bpe_50k.tiktoken")
    work = df.select(column(doc_id).alias("document"), F.coalesce(column(text), F.lit("")).alias(TEXT))
    closing = np.array([close_id], "<u4").tobytes()
    names = ["document", *[name for name, _ in FIELDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, rank_path)
        packer = Packer(length, windows, TaskContext.get().partitionId() << 33)

        def out(kinds: list[pa.DataType]) -> pa.RecordBatch:
            columns = zip(*packer.done) if packer.done else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(columns, kinds)], names=names)
            packer.done = []
            return made

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[k for _, k in FIELDS]]
            documents = batch.column(0).to_pylist()
            for at in range(0, len(documents), 1000):
                texts = batch.column(1).slice(at, 1000).to_pylist()
                for document, ids in zip(documents[at : at + 1000], encode(texts)):
                    packer.add(document, ids + closing)
                yield out(kinds)
        if kinds:
            packer.close(powers)
            yield out(kinds)

    return work.mapInArrow(run, ddl(work, FIELDS)).withColumnRenamed("document", doc_id)
