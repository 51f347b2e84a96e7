"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits,
URL schemes and cues that announce an identifier. Around each anchor a small
deterministic parser walks outwards to the boundaries of an address, number or
account and validates it. Kinds and their rules (leftmost, not overlapping within
a kind; a candidate that fails validation is dropped; only an IBAN is tried again shorter):

email    local@label.label..., ASCII; found at the at-sign
ip       four numbers up to 255 joined by dots; found at a digit
card     12 to 19 digits, at most one space or dash between two, Luhn sum right
phone    plus sign, digits with spaces, brackets, dots and dashes, 9 to 15 digits
url      a scheme (http, https, ftp, mailto) and what follows to white space or a closing mark
account  after a cue (iban, account, acct, ssn): an IBAN with right check digits, a number
         of 6 to 17 digits, or ddd-dd-dddd after ssn. An IBAN ends where its country's length
         says, or else at the last end of a word that gives right check digits

The first four are the base kinds. Offsets are code points, ends exclusive.

Defined cases: a null text counts as empty; an empty text has no spans. Texts are
read whole at any length. Equal texts have equal spans. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import column, over_texts

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_RUN = re.compile(r"[0-9]+")
_DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LINK = re.compile(r"[^\s<>\"'`|{}\\^]+")
_IBAN = re.compile(r"[ :=#.]{0,3}(?:(?:no|number|nr)[ :=#.]{0,3})?([a-z]{2}[0-9]{2})(?= ?[a-z0-9]{4})")
_GROUP = re.compile(r" ?(?:[a-z0-9]{4}|[a-z0-9]{1,3}(?![a-z0-9]))")
_ALNUM = re.compile(r"[a-z0-9]")
_ACCOUNT = re.compile(r"[ :=#.]{0,3}(?:(?:no|number|nr)[ :=#.]{0,3})?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"[ :=#.]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_SCHEMES = ("http://", "https://", "ftp://", "mailto:")
_CUES = ("iban", "account", "acct", "ssn")
# ISO 13616: characters of an IBAN by country.
_LENGTHS = {
    country: length
    for length, countries in {
        15: "no", 16: "be", 18: "dk fk fi fo gl nl sd", 19: "mk si", 20: "at ba ee kz lt lu mn xk", 21: "ch hr li lv",
        22: "bg bh cr de gb ge ie me rs va", 23: "ae gi il iq om so tl", 24: "ad cz es md pk ro sa se sk tn vg",
        25: "ly pt st", 26: "is tr", 27: "bi dj fr gr it mc mr sm", 28: "al az by cy do gt hn hu lb ni pl sv",
        29: "br eg ps qa ua", 30: "jo kw mu ye", 31: "mt sc", 32: "lc", 33: "ru",
    }.items()
    for country in countries.split()
}


@cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    automaton.add_word("@", "@")
    automaton.add_word("+", "+")
    for digit in "0123456789":
        automaton.add_word(digit, "0")
    for scheme in _SCHEMES:
        automaton.add_word(scheme, scheme)
    for cue in _CUES:
        automaton.add_word(cue, cue)
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(low: str, start: int) -> int | None:
    """Where the IBAN at start ends: groups of four, the last maybe shorter, at most one blank between two."""
    at, found = start + 4, []
    while at < start + 43 and (m := _GROUP.match(low, at)):
        at = m.end()
        if not _ALNUM.match(low, at) and iban(value := low[start:at].replace(" ", "")):
            if len(value) == _LENGTHS.get(value[:2]):
                return at
            found.append(at)
    return found[-1] if found else None


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in one text, by start and then kind as listed."""
    if not text:
        return []
    low = text.encode().lower().decode()  # A to Z only, so offsets stay
    spans: list[tuple[int, int, str]] = []
    mail_end = ip_past = card_past = dial_past = link_past = 0
    for last, anchor in _anchors().iter(low):
        if anchor == "0":
            if last >= card_past:
                if m := _CHAIN.match(text, last):
                    card_past = m.end()
                    number = _digits(m[0])
                    if 12 <= len(number) <= 19 and luhn(number):
                        spans.append((last, m.end(), "card"))
                else:
                    card_past = last + 1
            if last >= ip_past:
                if m := _DOTTED.match(text, last):
                    ip_past = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.groups()):
                        spans.append((last, m.end(), "ip"))
                else:
                    ip_past = _RUN.match(text, last).end()
        elif anchor == "@":
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                mail_end = m.end()
                spans.append((start, mail_end, "email"))
        elif anchor == "+":
            if last >= dial_past and (m := _DIAL.match(text, last)):
                dial_past = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    spans.append((last, m.end(), "phone"))
        elif anchor in _SCHEMES:
            start = last + 1 - len(anchor)
            if start >= link_past and (start == 0 or not low[start - 1].isalnum()) and (m := _LINK.match(text, last + 1)):
                end = link_past = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]*#%&$":
                    end -= 1
                if end > last + 1:
                    spans.append((start, end, "url"))
        elif last + 1 - len(anchor) == 0 or not low[last - len(anchor)].isalnum():
            m = _IBAN.match(low, last + 1) if anchor != "ssn" else _SSN.match(low, last + 1)
            end = m and (m.end(1) if anchor == "ssn" else iban_end(low, m.start(1)))
            if end:
                spans.append((m.start(1), end, "account"))
            elif anchor in ("account", "acct") and (m := _ACCOUNT.match(low, last + 1)):
                spans.append((m.start(1), m.end(1), "account"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def written(spans) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _report(texts: list[str]):
    columns = [[] for _ in range(8)]
    for text in texts:
        spans = find_spans(text)
        base = [s for s in spans if s[2] in BASE]
        kinds = [s[2] for s in spans]
        for column, value in zip(columns, [*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)]):
            column.append(value)
    return columns


FIELDS = [*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())]


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts per kind, digest of the base spans, and all spans; one map, no shuffle."""
    return over_texts(df, text, [doc_id], _report, FIELDS)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All columns and rows of df, the text redacted and its length in ``n_chars`` renewed. A null text becomes empty."""

    def work(texts: list[str]):
        new = [redacted(t) for t in texts]
        return [new, [len(t) for t in new]]

    return over_texts(df, text, df.columns, work, [(text, pa.string()), (n_chars, pa.int64())]).select(*map(column, df.columns))
