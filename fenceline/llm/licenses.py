"""Licence scans: phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser.

A text's words (A to Z lower-cased, cut at ASCII characters that are neither digit nor
letter) are joined by single blanks, and one automaton over that line finds the phrases
of the table below wherever their words stand consecutively. A second look goes to
identifier tags (``SPDX-License-Identifier:`` and the ``license =``/``license:`` lines
of manifests), whose places a second automaton gives: what follows on the line is read as a licence expression. Its operators,
``with`` before ``and`` before ``or``, and brackets are put in postfix order by the
shunting-yard algorithm and evaluated to the licences named and to whether the whole can
be met by permissive licences alone (``or`` needs one side, ``and`` both, ``with`` keeps
the licence's own).

Labels: those of the phrases; ``tag:<id>`` for each licence named in an expression;
``permissive`` or ``reciprocal`` for its value. Score: 1 minus the product of the doubts
of the distinct kinds of evidence (base phrase 0.3, other phrase 0.5, tag with a known
licence 0.1, tag with unknown ones 0.6); 0 without evidence.

After ``license`` an expression needs a licence of the table, or has to be a single id with
a digit, as prose follows there too; after the SPDX tag every id counts but ``none`` and
``noassertion``, which name no licence.

Defined cases: a null text counts as empty; an empty text has no words, null places,
empty labels and score 0. Prose after an expression is cut off; what then does not parse
gives its known ids only.
Equal texts have equal rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import over_texts

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "permission is hereby granted free of charge": "mit-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}

TAGS = ("spdx license identifier", "license", "licence")

PERMISSIVE = frozenset("mit mit-0 apache-2.0 bsd-2-clause bsd-3-clause 0bsd isc zlib unlicense cc0-1.0 bsl-1.0 python-2.0 cc-by-4.0".split())
RECIPROCAL = frozenset(
    f"{base}{suffix}" for base in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "epl-2.0", "cc-by-sa-4.0") for suffix in ("", "+", "-only", "-or-later")
)

_WORDLESS = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 0x20 for b in range(256))
_TAG = re.compile(r"(?:(spdx-license-identifier)|(?<![\w-])licen[cs]e)[\"']?[ \t]*[:=][ \t]*[\"']?([^\n\"'<>;*]+)")
_PART = re.compile(r"[()]|(?:documentref-[a-z0-9.-]+:)?[a-z0-9][a-z0-9.+-]*")
_NAMELESS = {"none", "noassertion"}
_LISTED = PERMISSIVE | RECIPROCAL
_BINDS = {"or": 1, "and": 2, "with": 3}


@cache
def _phrases():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES}.items():
        automaton.add_word(f" {phrase} ", (phrase in BASE, label, phrase.count(" ") + 1))
    for tag in TAGS:
        key = f" {tag} "
        if not automaton.exists(key):
            automaton.add_word(key, (False, None, 0))
    automaton.make_automaton()
    return automaton


@cache
def _tags():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for tag in ("spdx-license-identifier", "license", "licence"):
        automaton.add_word(tag, len(tag))
    automaton.make_automaton()
    return automaton


def tag_values(low: str):
    """(value, after an SPDX tag) of the identifier tags of a lower-cased text; no tag is read inside another's value."""
    past = 0
    for last, length in _tags().iter(low):
        start = last + 1 - length
        if start >= past and (m := _TAG.match(low, start)):
            past = m.end()
            yield m[2], bool(m[1])


def longest_prefix(parts: list[str]) -> int:
    """Length of the longest prefix that is a whole expression, 0 if none is; one pass."""
    longest = depth = 0
    operand = True  # what the next part has to be
    for i, part in enumerate(parts, 1):
        if operand != (part == "(" or (part != ")" and part not in _BINDS)):
            break
        depth += (part == "(") - (part == ")")
        if depth < 0:
            break
        operand = part == "(" or part in _BINDS
        if not operand and depth == 0:
            longest = i
    return longest


def postfix(parts: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what the next part has to be
    for part in parts:
        if part == "(":
            if not operand:
                return None
            stack.append(part)
        elif part == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif part in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[part]:
                out.append(stack.pop())
            stack.append(part)
            operand = True
        else:
            if not operand:
                return None
            out.append(part)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(order: list[str]) -> tuple[frozenset[str], bool, bool]:
    """(licences, all known, permissive) of an expression in postfix order; smaller sets go into larger ones."""
    stack: list[tuple[set[str], bool, bool]] = []
    for part in order:
        if part in _BINDS:
            (b, b_known, b_free), (a, a_known, a_free) = stack.pop(), stack.pop()
            if part != "with":
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
                a_known, a_free = a_known and b_known, a_free or b_free if part == "or" else a_free and b_free
            stack.append((a, a_known, a_free))
        else:
            stack.append(({part}, part in _LISTED, part in PERMISSIVE))
    ids, known, free = stack[0]
    return frozenset(ids), known, free


def expression(text: str, spdx: bool = False) -> tuple[set[str], bool, str | None]:
    """Labels of a licence expression, whether all its licences are known, and its value; spdx after an SPDX tag."""
    parts = [p.rstrip(".-") if p not in "()" else p for p in _PART.findall(text)]
    whole = longest_prefix(parts)
    # Prose after the expression is dropped, but no licence of the table with it.
    if not whole or any(p in _LISTED for p in parts[whole:]):
        return {f"tag:{p}" for p in parts if p in _LISTED}, False, None
    ids, known, free = evaluate(postfix(parts[:whole]))
    if not ids & _LISTED:
        if spdx:
            return {f"tag:{i}" for i in ids - _NAMELESS}, False, None
        return ({f"tag:{i}" for i in ids} if len(ids) == 1 and re.search(r"\d", *ids) else set()), False, None
    return {f"tag:{i}" for i in ids}, known, "permissive" if free else "reciprocal"


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    low = text.encode().lower()
    words = low.translate(_WORDLESS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0
    line = " " + (b" ".join(words)).decode("latin-1") + " "
    base, labels, doubt, places, tagged = set(), set(), {}, [], False
    word = at = 0
    for last, (is_base, label, length) in _phrases().iter(line):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        doubt[label] = 0.3 if is_base else 0.5
        if is_base:
            word += line.count(" ", at, last)  # blanks so far: the number of words that have ended
            at = last
            base.add(label)
            places.append(word - length)
    if tagged:
        for text_after, spdx in tag_values(low.decode()):
            found, known, value = expression(text_after, spdx)
            for label in found:
                labels.add(label)
                doubt[label] = 0.1 if known else 0.6
            if value:
                labels.add(value)
    score = 1.0
    for label in sorted(doubt):
        score *= doubt[label]
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 - score, 12) if doubt else 0.0,
    )


FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
]


def licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what ``scan`` finds in every whole text; one map, no shuffle."""

    def work(texts: list[str]):
        return list(zip(*map(scan, texts))) if texts else [[]] * len(FIELDS)

    return over_texts(df, text, [doc_id], work, FIELDS)
