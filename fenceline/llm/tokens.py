"""Unigram token counts by dynamic programming on a trie of distinct pre-tokens.

A unigram model gives each vocabulary entry a log probability; a pre-token's best
segmentation maximises their sum (ties: fewer tokens). The best score of a prefix
does not depend on what follows, so the forward scores live in the nodes of a trie
into which the distinct pre-tokens are inserted: a shared prefix is scored once, and
the node where a pre-token ends stores its number of tokens. The entries that end at a
byte are found by walking a trie of the vocabulary backwards from it, as far as some
entry goes on.

Memory is bounded: a worker keeps its trie between texts and starts a new one beyond a
fixed number of nodes, and a pre-token enters it with its first bytes only; its further
scores are kept as far back as the longest entry reaches. Counts do not depend on that.

The public vocabularies carry ranks, not probabilities, and none is trained here: an
entry of rank r has a probability in proportion to 1 / (r + 1), and single bytes,
which make every text segmentable, come last, as rank ``size of the vocabulary``. The
probabilities of all entries sum to 1.

Defined cases: a null text counts as empty; an empty text has no tokens. Repeated
rows are counted alike. Extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import fsum, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import over_texts
from .vocabulary import pieces, ranks, splitting_pattern, vocabulary_path

#: Nodes and pieces a worker keeps before it starts anew, bytes of a pre-token that enter the trie, longest piece that is kept.
NODES, REMEMBERED, DEEP, LONGEST = 400_000, 200_000, 256, 200


def log_probabilities(own: dict[bytes, int]) -> dict[bytes, float]:
    last = len(own)
    weights = {b: 1.0 / ((r if len(b) > 1 else last) + 1.0) for b, r in own.items()}
    norm = log(fsum(weights.values()))
    return {b: log(w) - norm for b, w in weights.items()}


class Endings:
    """Vocabulary entries from their last byte on: ``edges`` maps (node, byte) to a node in one key, ``gains`` has an entry's score."""

    def __init__(self, scores: dict[bytes, float]):
        self.edges: dict[int, int] = {}
        self.gains: list[float | None] = [None]
        for entry, score in scores.items():
            node = 0
            for byte in reversed(entry):
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(self.gains)
                    self.gains.append(None)
                node = self.edges[key]
            self.gains[node] = score


class Trie:
    """Nodes are numbers; ``edges`` maps (node, byte) to a node, in one key."""

    def __init__(self, scores: dict[bytes, float]):
        self.longest = max(map(len, scores))
        self.endings = Endings(scores)
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.forward, self.tokens = [0.0], [0]  # of the root

    def count(self, word: bytes) -> int:
        """Tokens of the best segmentation of a pre-token, inserting it."""
        if len(self.forward) > NODES:
            self.clear()
        edges, forward, tokens = self.edges, self.forward, self.tokens
        back, gains = self.endings.edges, self.endings.gains
        node, path = 0, [0]
        for end, byte in enumerate(word[:DEEP], 1):
            key = node << 8 | byte
            node = edges.get(key, 0)
            if not node:
                best, fewest, at = -1e300, 0, 0
                for start in range(end - 1, -1, -1):
                    at = back.get(at << 8 | word[start])
                    if at is None:
                        break
                    gain = gains[at]
                    if gain is not None:
                        before = path[start]
                        total, n = forward[before] + gain, tokens[before] + 1
                        if total > best or total == best and n < fewest:
                            best, fewest = total, n
                node = edges[key] = len(forward)
                forward.append(best)
                tokens.append(fewest)
            path.append(node)
        return tokens[node] if len(word) <= DEEP else self._beyond(word, path)

    def _beyond(self, word: bytes, path: list[int]) -> int:
        """The same for the bytes that do not enter the trie, over a ring of the latest scores."""
        back, gains, size = self.endings.edges, self.endings.gains, self.longest + 1
        best_of, tokens_of = [0.0] * size, [0] * size
        for end in range(max(0, len(path) - size), len(path)):
            best_of[end % size], tokens_of[end % size] = self.forward[path[end]], self.tokens[path[end]]
        for end in range(len(path), len(word) + 1):
            best, fewest, at = -1e300, 0, 0
            for start in range(end - 1, -1, -1):
                at = back.get(at << 8 | word[start])
                if at is None:
                    break
                gain = gains[at]
                if gain is not None:
                    total, n = best_of[start % size] + gain, tokens_of[start % size] + 1
                    if total > best or total == best and n < fewest:
                        best, fewest = total, n
            best_of[end % size], tokens_of[end % size] = best, fewest
        return tokens_of[len(word) % size]


class Counter:
    def __init__(self, rank_path: str):
        import regex

        self._split = regex.compile(splitting_pattern()).findall
        self._trie = Trie(log_probabilities(ranks(rank_path)))
        self._known: dict[str, int] = {}

    def _count(self, text: str) -> int:
        count = self._trie.count
        return sum(count(w.encode()) for w in self._split(text))

    def __call__(self, text: str) -> int:
        cut, known = pieces(text), self._known
        if cut is None or not cut[-1] or cut[-1][-1].isspace():
            return self._count(text)
        if len(known) > REMEMBERED:
            known.clear()
        total = self._count(cut[0])
        for piece in cut[1:]:
            n = known.get(piece)
            if n is None:
                n = self._count(" " + piece)
                if len(piece) <= LONGEST:
                    known[piece] = n
            total += n
        return total


@cache
def counter(rank_path: str) -> Counter:
    return Counter(rank_path)


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rank_path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text; one map, no shuffle."""
    rank_path = rank_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def work(texts: list[str]):
        count = counter(rank_path)
        return [[count(t) for t in texts]]

    return over_texts(df, text, [doc_id], work, [("n_tokens", pa.int64())])
