"""Byte-level BPE encoding with a rank queue over hierarchical bitmaps, and decoding.

A pre-token starts as a linked list of its bytes. Merging always takes the pair of lowest
rank, the leftmost of these. Pairs wait in buckets, one for each merge rank, that hold the
list positions of their left halves; a bitmap of three levels, sixty-four ways each, marks
the ranks whose buckets are not empty, so that three find-first-set steps give the next
rank, however many pairs wait. An entry whose pair has meanwhile changed is stale and is
skipped when it comes up. A merge renews at most two pairs, so a pre-token of n bytes makes
at most 3 n entries, and time is in proportion to n but for the order inside a bucket:
entries that come in order of position, as nearly all do, are appended, the others wait in
a small heap beside them. The list and the entries are arrays of 4-byte numbers.

A text's pre-tokens are the matches of the vocabulary's pattern, and a pre-token that is a
vocabulary entry is its id. The distinct ones of some hundred texts share a queue, without
links between them: each is merged in its own order of ranks, and a rank's bucket is emptied
in one go as long as no lower rank comes up. A worker remembers a bounded number of short
pre-tokens; results do not depend on it.

Defined cases: a null text counts as empty; an empty text has no ids. White space of any
length is encoded. Special tokens are ordinary text. Ids of equal texts are equal. When
decoding, null ids count as none; an unknown id raises. Extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import over_texts
from .vocabulary import ranks, splitting_pattern, vocabulary_path

#: Pre-tokens that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 100

#: Rows handed on at once, characters of texts encoded together (a longer text is alone), bytes of pre-tokens that share a queue (likewise).
ROWS, TOGETHER, SHARED = 1000, 1_000_000, 1 << 18


class Bucket:
    """Positions of one rank: ``row`` in order, from ``at`` on, and a heap of those that came out of order."""

    __slots__ = ("row", "at", "late")

    def __init__(self, row: array):
        self.row, self.at, self.late = row, 0, []

    def add(self, position: int) -> None:
        if self.row[-1] < position:
            self.row.append(position)
        else:
            heappush(self.late, position)

    def pop(self) -> int:
        late, row, at = self.late, self.row, self.at
        if late and (at == len(row) or late[0] < row[at]):
            return heappop(late)
        self.at = at + 1
        return row[at]

    def __bool__(self) -> bool:
        return self.at < len(self.row) or bool(self.late)


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank. A lone position is its own bucket."""

    def __init__(self, size: int):
        if size > 1 << 18:
            raise ValueError("three levels of sixty-four hold 262144 ranks")
        self.low, self.middle, self.top = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1), 0
        self.rows: dict[int, int | Bucket] = {}

    def add(self, rank: int, position: int) -> None:
        row = self.rows.get(rank)
        if row is None:
            self.put(rank, position)
        elif row.__class__ is int:
            self.rows[rank] = bucket = Bucket(array("i", (row,)))
            bucket.add(position)
        else:
            row.add(position)

    def put(self, rank: int, row: int | Bucket) -> None:
        """Fill the empty bucket of a rank."""
        self.rows[rank] = row
        i = rank >> 6
        word = self.low[i]
        self.low[i] = word | 1 << (rank & 63)
        if not word:
            self.middle[i >> 6] |= 1 << (i & 63)
            self.top |= 1 << (i >> 6)

    def first(self) -> int:
        """The lowest rank whose bucket is not empty; there must be one."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def clear(self, rank: int) -> None:
        """Take an emptied bucket out."""
        del self.rows[rank]
        i = rank >> 6
        self.low[i] = word = self.low[i] ^ 1 << (rank & 63)
        if not word:
            self.middle[i >> 6] ^= 1 << (i & 63)
            if not self.middle[i >> 6]:
                self.top ^= 1 << (i >> 6)

    def pop(self) -> tuple[int, int] | None:
        """(rank, position), or None when nothing waits."""
        if not self.top:
            return None
        rank = self.first()
        position = row = self.rows[rank]
        if row.__class__ is not int:
            position = row.pop()
        if row.__class__ is int or not row:
            self.clear(rank)
        return rank, position


class Memory:
    """The latest results by text: when as many as ``most`` are held, all that were not asked for since the last time go."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most // 2:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Bpe:
    """Ids of one vocabulary, given as ranks of byte strings."""

    def __init__(self, own: dict[bytes, int], pattern: str):
        import regex

        self.ids = own
        self.bytes = {i: b for b, i in own.items()}
        if any(bytes([b]) not in own for b in range(256)):
            raise ValueError("every byte must be a vocabulary entry")
        self.single = np.array([own[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        # Rank of two adjacent bytes, -1 if they never merge.
        self.pairs = np.full(1 << 16, -1, np.int32)
        for b, i in own.items():
            if len(b) == 2:
                self.pairs[b[0] << 8 | b[1]] = i
        self.queue = RankQueue(max(own.values()) + 1)  # empty between calls of merge
        self.words = Memory(REMEMBERED)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, which share one queue but no links."""
        n = sum(map(len, words))
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        letters = np.frombuffer(b"".join(words), np.uint8)
        links = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        links[0][ends - 1], links[1][starts] = n, -1  # a word's last byte has no next one, its first none before
        tokens, after, before = (array("i", x.tobytes()) for x in (self.single[letters], *links))
        rank = self.pairs[letters[:-1].astype(np.int32) << 8 | letters[1:]]
        rank[ends[:-1] - 1] = -1
        queue, find, spelled = self.queue, self.ids.get, self.bytes
        places = np.flatnonzero(rank >= 0).astype(np.int32)
        places = places[np.argsort(rank[places], kind="stable")]
        for run in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1):
            if len(run):
                queue.put(int(rank[run[0]]), Bucket(array("i", run.tobytes())))
        # The id of a merged pair is its rank; -1 marks a position that has gone into its left neighbour.
        while queue.top:
            now = queue.first()
            row, more, lower = queue.rows[now], True, False
            while more and not lower:
                if row.__class__ is int:
                    at, more = row, False
                else:
                    at = row.pop()
                    more = row.at < len(row.row) or row.late
                if not more:
                    queue.clear(now)
                token = tokens[at]
                if token < 0 or (right := after[at]) >= n:
                    continue
                text = spelled[token] + spelled[tokens[right]]
                if find(text) != now:
                    continue  # stale: the pair has changed since
                tokens[at], tokens[right] = now, -1
                after[at] = following = after[right]
                if following < n:
                    before[following] = at
                    new = find(text + spelled[tokens[following]])
                    if new is not None:
                        queue.add(new, at)
                        lower = new < now
                left = before[at]
                if left >= 0:
                    new = find(spelled[tokens[left]] + text)
                    if new is not None:
                        queue.add(new, left)
                        lower = lower or new < now
        merged = np.frombuffer(tokens, np.int32)
        kept = np.flatnonzero(merged >= 0)
        ids = merged[kept].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(kept, np.concatenate((starts, [n])))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, fresh: dict[str, bytes | None]) -> None:
        """Fill in the ids of pre-tokens."""
        waiting, size = [], 0

        def settle() -> None:
            for word, ids in zip(waiting, self.merge([w.encode() for w in waiting])):
                fresh[word] = ids
                if len(word) <= LONGEST:
                    self.words.put(word, ids)

        for word in [w for w, ids in fresh.items() if ids is None]:
            own = word.encode()
            whole = self.ids.get(own)
            if whole is not None:
                fresh[word] = whole.to_bytes(4, "little")
                continue
            if waiting and size + len(own) > SHARED:
                settle()
                waiting, size = [], 0
            waiting.append(word)
            size += len(own)
        if waiting:
            settle()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit."""
        remembered, split_texts = self.words.get, list(map(self.split, texts))
        fresh: dict[str, bytes | None] = {}
        for words in split_texts:
            for word in set(words).difference(fresh):
                fresh[word] = remembered(word)
        self.learn(fresh)
        return [b"".join(map(fresh.__getitem__, words)) for words in split_texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of bounded length."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@cache
def vocabulary(rank_path: str) -> Bpe:
    """One per worker and vocabulary."""
    return Bpe(ranks(rank_path), splitting_pattern())


def encoded(df: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", rank_path: str | None = None, back: bool = False) -> DataFrame:
    """Columns ``keep`` and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text; one map, no shuffle.

    ``back`` adds ``bytes``, what the ids spell, decoded in the same map.
    """
    rank_path = rank_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def work(texts: list[str]):
        own, ids = vocabulary(rank_path), []
        for group in together(texts):
            ids += own.encode(group)
        return [ids, list(map(own.decode, ids))] if back else [ids]

    fields = [("ids", pa.binary()), ("bytes", pa.binary())]
    return over_texts(df, text, list(keep), work, fields if back else fields[:1], at_once=ROWS)


def decoded(df: DataFrame, keep: Iterable[str] = ("doc_id",), ids: str = "ids", rank_path: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``bytes``, what the ids spell; one map, no shuffle."""
    rank_path = rank_path or vocabulary_path("byte_bpe_50k.tiktoken")
    return over_texts(df, ids, list(keep), lambda values: [list(map(vocabulary(rank_path).decode, values))], [("bytes", pa.binary())], at_once=ROWS)
