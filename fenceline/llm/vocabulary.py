"""Byte-pair ids of a public vocabulary, cut at white space so that frequent pieces are encoded once.

The vocabulary's own splitting never joins a visible character with the white space
that follows it. A blank after a visible character therefore starts a new piece, and
a text's ids are the ids of its blank-led pieces one after another. Pieces are looked
up in a bounded memory; the unknown ones of a batch are encoded as one text, whose ids
are cut again at the pieces' byte offsets.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np

#: Pieces remembered by a worker; beyond it the memory starts anew. Results do not depend on it.
REMEMBERED = 200_000

_CROWDED = re.compile(r"\s ")
#: White space that is too long for the quick encoder, which descends once per character.
LONG_GAP = 5000
_LONG_GAP = re.compile(rf"\s{{{LONG_GAP}}}")


def vocabulary_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks(path: str) -> dict[bytes, int]:
    """{token bytes: id} of a vocabulary in rank form."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pieces(text: str) -> list[str] | None:
    """The text cut before every blank, without these blanks; None if a blank comes first or after white space."""
    return None if text[:1] == " " or _CROWDED.search(text) else text.split(" ")


class Encoder:
    """Ids of whole texts, little-endian unsigned 32-bit, as the tokenizer file gives them.

    ``path`` is that file, ``rank_path`` the same vocabulary in rank form, which is
    several times quicker. A text that holds the beginning of a special token, or white
    space of thousands of characters in a row, goes to the tokenizer file itself.
    """

    def __init__(self, path: str, rank_path: str):
        import tiktoken

        own = ranks(rank_path)
        self._path = path
        self._quick = tiktoken.Encoding("pieces", pat_str=splitting_pattern(), mergeable_ranks=own, special_tokens={})
        self._lengths = np.zeros(max(own.values()) + 1, np.int64)
        self._lengths[list(own.values())] = [len(b) for b in own]
        self._known: dict[str, bytes] = {}

    @property
    @cache
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def _learn(self, fresh: list[str]) -> None:
        sizes = np.fromiter((len(p.encode()) + 1 for p in fresh), np.int64, len(fresh))
        ids = np.array(self._quick.encode_ordinary(" " + " ".join(fresh)), "<u4")
        cuts = np.searchsorted(np.cumsum(self._lengths[ids]), np.cumsum(sizes), side="left") + 1
        whole, at = ids.tobytes(), 0
        for piece, end in zip(fresh, (4 * cuts).tolist()):
            self._known[piece] = whole[at:end]
            at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [None if self._slow(t) else pieces(t) for t in texts]
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = set()
        for c in cut:
            if c:
                fresh.update(c[1:])
        if fresh := [p for p in fresh if p not in known and not p[-1:].isspace() and p]:
            for at in range(0, len(fresh), 50_000):
                self._learn(fresh[at : at + 50_000])
        look, out = known.get, []
        for text, c in zip(texts, cut):
            if c is None:
                out.append(self._whole(text))
            elif c[-1] == "" or c[-1][-1].isspace():  # the end of a text may be white space
                out.append(self._whole(text))
            else:
                first = np.array(self._quick.encode_ordinary(c[0]), "<u4").tobytes()
                out.append(first + b"".join(map(look, c[1:])))
        return out

    @staticmethod
    def _slow(text: str) -> bool:
        # So long a gap covers one of every LONG_GAP-th characters; only then is it looked for.
        return "<|" in text or any(map(str.isspace, text[LONG_GAP - 1 :: LONG_GAP])) and _LONG_GAP.search(text) is not None

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self._slow(text) else self._quick.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@cache
def encoder(path: str, rank_path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, rank_path)
