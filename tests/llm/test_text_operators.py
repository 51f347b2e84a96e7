"""Operators that map whole texts, against brute-force versions."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fenceline.llm import licenses, pii, quality, tokens, vocabulary, winnow

from .edge_tables import LONG, ROWS, documents, nothing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    duckdb = pytest.importorskip("duckdb")
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    spans = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    spans += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]

    def count(m):
        return len(re.sub("[^0-9]", "", m[0]))

    def luhn(m):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0

    spans += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= count(m) <= 19 and luhn(m)]
    spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= count(m) <= 15]
    return sorted(spans, key=lambda s: (s[0], pii.BASE.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.-+ ()45%_é0\n", max_size=60))
def test_base_spans_of_random_texts(text):
    assert [s for s in pii.find_spans(text) if s[2] in pii.BASE] == brute_spans(text)


def test_base_spans_of_documents(texts):
    found = [[s for s in pii.find_spans(t) if s[2] in pii.BASE] for t in texts + [LONG]]
    assert found == [brute_spans(t) for t in texts + [LONG]]
    assert sum(map(len, found)) > 5


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("see https://example.org/a?b=1. Then", ["url"]),
        ("mailto:me@example.org", ["url", "email"]),
        ("IBAN: GB82 WEST 1234 5698 7654 32 end", ["account"]),
        ("IBAN: GB83 WEST 1234 5698 7654 32 end", []),
        ("account no. 12345678 is closed", ["account"]),
        ("ssn 123-45-6789.", ["account"]),
        ("accountant 12345678", []),
    ],
)
def test_further_kinds(text, kinds):
    assert [s[2] for s in pii.find_spans(text) if s[2] != "phone"] == kinds


@pytest.mark.parametrize("digits", ["0" * 5000, "9" * 5000, "0" * 4999 + "7"])
@pytest.mark.parametrize("place", range(4))
def test_very_long_numbers(spark, digits, place):
    text = ".".join(digits if i == place else "1" for i in range(4))
    assert [s for s in pii.find_spans(text) if s[2] == "ip"] == ([(0, len(text), "ip")] if digits[0] == "0" else [])
    if not place:
        assert pii.personal_data(documents(spark, [(1, text, "en", "a")])).first()["n_ip"] == (digits[0] == "0")
        assert pii.redact(documents(spark, [(1, text, "en", "a")])).count() == 1


def test_links_do_not_overlap():
    assert pii.find_spans("http://a.b/?u=http://c.d/x ftp://e.f") == [(0, 26, "url"), (27, 36, "url")]
    assert len(pii.find_spans("mailto:" * 50_000)) == 1


def made_iban(country, rest):
    number = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{country}{98 - number % 97:02d}{rest}"


@pytest.mark.parametrize("after", [" is mine", " to", " for 12 of us", " and", " a", " 1234", " DE12 is", "", ".", ", or", "\nover"])
@pytest.mark.parametrize(
    "country,rest",
    [
        ("NO", "86011117947"), ("BE", "539007547034"), ("NL", "ABNA0417164300"), ("AT", "1904300234573201"), ("GB", "WEST12345698765432"),
        ("ES", "21000418450200051332"), ("FR", "20041010050500013M02606"), ("PL", "109010140000071219812874"), ("XX", "123456789012"),
    ],
)
def test_ibans_before_words(country, rest, after):
    plain = made_iban(country, rest)
    spaced = " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))
    for value in (plain, spaced, plain.lower()):
        text = f"my IBAN: {value}{after}"
        accounts = [s for s in pii.find_spans(text) if s[2] == "account"]
        assert accounts == [(9, 9 + len(value), "account")]
        wrong = text.replace(value[2:4], f"{(int(value[2:4]) + 1) % 97:02d}", 1)
        assert not [s for s in pii.find_spans(wrong) if s == accounts[0]]


def test_known_ibans_before_words():
    for value in ("ES9121000418450200051332", "BE68539007547034", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332"):
        assert pii.redacted(f"IBAN {value} is mine") == "IBAN [ACCOUNT] is mine"


def test_redacted():
    assert pii.redacted("a@b.c and mailto:x@y.zz! 10.1.2.3") == "[EMAIL] and [URL]! [IP]"


def test_personal_data_rows(spark):
    rows = [tuple(r) for r in pii.personal_data(documents(spark)).collect()]
    assert len(rows) == len(ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r[7] == empty for r in rows) == sorted(not brute_spans(t or "") for _, t, *_ in ROWS)
    assert pii.personal_data(nothing(spark)).count() == 0
    again = pii.redact(documents(spark)).collect()
    assert [len(r["text"]) for r in again] == [r["n_chars"] for r in again] and not any("@example" in r["text"] for r in again)


# ---------------------------------------------------------------- licences


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "License,", "apache", "general", "public", "é", "-", "x", "mit-license"]), max_size=12))
def test_base_phrases(parts):
    text = " ".join(parts)
    assert licenses.scan(text)[:5] == brute_license(text)


def test_licenses_of_documents(texts):
    assert [licenses.scan(t)[:5] for t in texts] == [brute_license(t) for t in texts]


@pytest.mark.parametrize(
    "text,labels",
    [
        ("SPDX-License-Identifier: MIT", {"tag:mit", "permissive"}),
        ("// SPDX-License-Identifier: GPL-2.0-only OR MIT\nx", {"tag:gpl-2.0-only", "tag:mit", "permissive"}),
        ("SPDX-License-Identifier: GPL-2.0-only AND MIT", {"tag:gpl-2.0-only", "tag:mit", "reciprocal"}),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR ISC) AND MIT", {"tag:gpl-2.0-only", "tag:isc", "tag:mit", "permissive"}),
        ('license = "Apache-2.0 OR MIT"', {"tag:apache-2.0", "tag:mit", "permissive"}),
        ("SPDX-License-Identifier: MIT AND OR", {"tag:mit", "permissive"}),
        ("SPDX-License-Identifier: (MIT", {"tag:mit"}),
        ("under the Mozilla Public License today", {"mpl"}),
        ("a license: ask us", set()),
    ],
)
def test_expressions(text, labels):
    *_, found, score = licenses.scan(text)
    assert set(filter(None, found.split(","))) == labels
    assert 0 <= score <= 1 and (score > 0) == bool(labels)


@pytest.mark.parametrize(
    "text,labels,score",
    [
        ("SPDX-License-Identifier: WTFPL", {"tag:wtfpl"}, 0.4),
        ("// SPDX-License-Identifier: PostgreSQL */\nint x;", {"tag:postgresql"}, 0.4),
        ("SPDX-License-Identifier: (Ruby OR NCSA)", {"tag:ruby", "tag:ncsa"}, 0.64),
        ("SPDX-License-Identifier: LGPL-2.0-only OR AFL-2.1", {"tag:lgpl-2.0-only", "tag:afl-2.1"}, 0.64),
        ("# SPDX-License-Identifier: Ruby AND (NCSA WITH Some-exception OR WTFPL)", {"tag:ruby", "tag:ncsa", "tag:wtfpl"}, 0.784),
        ("SPDX-License-Identifier: DocumentRef-a:LicenseRef-b", {"tag:documentref-a:licenseref-b"}, 0.4),
        ("SPDX-License-Identifier: WTFPL see the file", {"tag:wtfpl"}, 0.4),
        ("SPDX-License-Identifier: NONE", set(), 0.0),
        ("license: PostgreSQL", set(), 0.0),
        ("license: ask us OR them", set(), 0.0),
        ("license: foo-1.0", {"tag:foo-1.0"}, 0.4),
    ],
)
def test_unlisted_licences(text, labels, score):
    *_, found, given_score = licenses.scan(text)
    assert set(filter(None, found.split(","))) == labels
    assert given_score == pytest.approx(score)


def test_precedence():
    assert licenses.postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert licenses.postfix("( a or b ) and c".split()) == "a b or c and".split()
    assert licenses.postfix(["a", "b"]) is None and licenses.postfix([]) is None and licenses.postfix([")"]) is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "mit", "or", "and", "with", "(", ")"]), max_size=10))
def test_longest_prefix(parts):
    assert licenses.longest_prefix(parts) == max((n for n in range(1, len(parts) + 1) if licenses.postfix(parts[:n]) is not None), default=0)


def test_long_licence_lines():
    """An open bracket, a whole expression and mere tags, each of some megabytes, in one pass."""
    names = [f"a{i}" for i in range(200_000)]
    assert licenses.scan("license: (" + " or ".join(names))[5] == ""
    found, known, value = licenses.expression("(" + " or ".join(names) + " or mit) see the file", True)
    assert len(found) == 200_001 and not known and value == "permissive"
    assert licenses.scan("SPDX-License-Identifier: " + "(" * 200_000 + "mit" + ")" * 200_000)[5] == "permissive,tag:mit"
    assert licenses.scan("license: " * 200_000 + "mit")[5] == "tag:mit"


def test_tags_by_place():
    assert list(licenses.tag_values("license: see license: mit\nx-license: isc\nlicence='zlib'")) == [("see license: mit", False), ("zlib", False)]


def test_license_rows(spark):
    rows = licenses.licenses(documents(spark)).collect()
    assert [tuple(r)[1:6] for r in rows] == [brute_license(t or "") for _, t, *_ in ROWS]
    assert licenses.licenses(nothing(spark)).count() == 0


# ---------------------------------------------------------------- fingerprints


def brute_winnow(text, gram, window):
    gram = min(gram, len(text))
    if not gram:
        return []
    base, codes = winnow._BASE, [ord(c) + 1 for c in text]
    out = []
    for i in range(len(codes) - gram + 1):
        h = 0
        for c in codes[i : i + gram]:
            h = (h * base + c) % 2**64
        for shift, factor in ((30, int(winnow._ONE)), (27, int(winnow._TWO))):
            h = (h ^ (h >> shift)) * factor % 2**64
        out.append((h ^ (h >> 31)) >> 32)
    window = min(window, len(out))
    chosen = {min((out[i], -i) for i in range(s, s + window)) for s in range(len(out) - window + 1)}
    return sorted((-i, h) for h, i in chosen)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé🙂 ", max_size=90), st.integers(1, 9), st.integers(1, 7))
def test_winnow(text, gram, window):
    hashes, positions = winnow.winnow(text, gram, window)
    assert list(zip(positions.tolist(), hashes.tolist())) == brute_winnow(text, gram, window)


def test_shared_passages_are_seen():
    rng = random.Random(3)
    for _ in range(50):
        a, b, passage = ("".join(rng.choices("abcdefgh ", k=n)) for n in (200, 200, winnow.GRAM + winnow.WINDOW - 1))
        one, two = winnow.winnow(a + passage + b)[0], winnow.winnow(b[:77] + passage + a)[0]
        assert set(one.tolist()) & set(two.tolist())


def test_edited_documents(spark):
    rows = [(i, t) for i, t, *_ in ROWS]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        n = len(t) // 3
        expected.append((str(i), len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    for buckets in (1, 3, 8):
        out = winnow.edited(documents(spark), buckets=buckets).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(expected)
    by_text = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert len(r["positions"]) * 8 == len(r["fingerprint"])
        by_text.setdefault(dict(rows).get(r["doc_id"]) if r["doc_id"] != 7 else r["n_chars"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert winnow.edited(nothing(spark)).count() == 0
    assert winnow.edited(documents(spark, ROWS[4:5])).first()["near_next"] == 1.0


def test_short_texts_are_compared_by_several_hashes(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=40))[: 40 + i % 91], "en", "a") for i in range(364)]
    near = [(r["n_chars"], r["near_edited"], r["near_next"]) for r in winnow.edited(documents(spark, rows)).collect()]
    assert {n for n, *_ in near} == set(range(40, 131))
    assert all(0.1 < e < 0.95 and e > after for _, e, after in near)  # two thirds of each text stay
    for low, high in ((40, 63), (63, 126)):
        assert 0.5 < np.mean([e for n, e, _ in near if low <= n < high]) < 0.75


def test_edited_tables_agree_with_any_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {tuple(map(str, r)) for r in winnow.edited(docs, buckets=1).collect()}
    many = {tuple(map(str, r)) for r in winnow.edited(docs, buckets=40).collect()}
    assert one == many and len(one) == docs.count()


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def encoder():
    return vocabulary.Encoder(vocabulary.vocabulary_path("byte_bpe_50k.json"), vocabulary.vocabulary_path("byte_bpe_50k.tiktoken"))


def test_encoder_agrees_with_the_tokenizer_file(encoder, texts):
    samples = texts + [t or "" for _, t, *_ in ROWS] + ["a<|endoftext|>b", " lead", "end ", "x\n y", "it's we'll 12 ab12", " em  nb", "", " ", "\x1c a"]
    ids = [np.frombuffer(b, "<u4").tolist() for b in encoder(samples)]
    assert ids == [e.ids for e in encoder.tokenizer.encode_batch(samples, add_special_tokens=False)]


@pytest.mark.parametrize("gap", ["\n", " ", "\t ", "\u2003"])
@pytest.mark.parametrize("after", ["", "b"])
def test_encoder_on_long_white_space(encoder, gap, after):
    for size in (4_999, 5_000, 5_001, 1_000_000):
        text = "a" + (gap * size)[:size] + after
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encoder_on_random_texts(encoder, text):
    assert np.frombuffer(encoder([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def brute_unigram(word, scores):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        total, n = max(options)
        best[end] = (total, -n)
    return best[-1][1]


def test_unigram_counts(texts):
    import regex

    own = vocabulary.ranks(vocabulary.vocabulary_path("byte_bpe_50k.tiktoken"))
    scores, split = tokens.log_probabilities(own), regex.compile(vocabulary.splitting_pattern()).findall
    count = tokens.Counter(vocabulary.vocabulary_path("byte_bpe_50k.tiktoken"))
    for text in texts[:25] + [t or "" for _, t, *_ in ROWS if t != LONG]:
        assert count(text) == sum(brute_unigram(w.encode(), scores) for w in split(text))


def test_unigram_scores_are_probabilities():
    """They sum to 1, and of all segmentations of a short word the counted one is the most probable."""
    own = vocabulary.ranks(vocabulary.vocabulary_path("byte_bpe_50k.tiktoken"))
    weight = {b: Fraction(1, (r if len(b) > 1 else len(own)) + 1) for b, r in own.items()}
    total = sum(float(w) for w in weight.values())
    scores = tokens.log_probabilities(own)
    assert sum(map(math.exp, scores.values())) == pytest.approx(1.0, abs=1e-12)
    trie = tokens.Trie(scores)
    for word in (b" thonea", b" the", b"abc", b" andershored", "é日".encode(), b"0001", b" x"):
        ways = []
        for cuts in range(1 << (len(word) - 1)):
            ends = [i + 1 for i in range(len(word) - 1) if cuts >> i & 1] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in weight for p in parts):
                ways.append((math.prod(float(weight[p]) / total for p in parts), -len(parts)))
        assert trie.count(word) == -max(ways)[1]


def test_long_pre_tokens_in_a_bounded_trie():
    own = vocabulary.ranks(vocabulary.vocabulary_path("byte_bpe_50k.tiktoken"))
    scores = tokens.log_probabilities(own)
    trie, rng = tokens.Trie(scores), random.Random(6)
    for letters in ("a", "ab", "=", "etaoin", "é日"):
        for size in (tokens.DEEP - 1, tokens.DEEP, tokens.DEEP + 1, 900):
            word = "".join(rng.choices(letters, k=size)).encode()
            assert trie.count(word) == brute_unigram(word, scores)
    trie.clear()
    assert trie.count(b"z" * 500_000) > 0 and len(trie.forward) <= tokens.DEEP + 1


def test_trie_starts_anew(monkeypatch, texts):
    path = vocabulary.vocabulary_path("byte_bpe_50k.tiktoken")
    whole = [tokens.Counter(path)(t) for t in texts[:10]]
    monkeypatch.setattr(tokens, "NODES", 50)
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    small = tokens.Counter(path)
    assert [small(t) for t in texts[:10]] == whole


def test_token_rows(spark):
    rows = tokens.token_counts(documents(spark)).collect()
    assert len(rows) == len(ROWS) and [r["n_tokens"] == 0 for r in rows] == [not t for _, t, *_ in ROWS]
    assert tokens.token_counts(nothing(spark)).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    vectors, model = quality.learned(docs, labels)
    rows = quality.score(vectors, model, ["doc_id"]).join(labels, "doc_id").where(quality.held_out()).collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert len(bad) >= 5
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(vectors, model, ["doc_id"]).where("score >= 0.3").count()


def test_quality_density_matches_the_normal_law():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    spreads = np.stack([np.cov(rng.normal(size=(d, 60))) + np.eye(d) for _ in range(2)])
    model = quality.Discriminant((0.25, 0.75), rng.normal(size=(2, d)), np.linalg.cholesky(spreads), np.linalg.slogdet(spreads)[1] / 2)
    x = rng.normal(size=(7, d))
    logs = [np.log(p) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m) for p, m, s in zip(model.shares, model.means, spreads)]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_edges(spark):
    docs = documents(spark)
    for labels, scores in (
        ([(1, 1), (6, 1), (6, 1), (5, None), (3, 7)], {1.0}),
        ([(1, 0)], {0.0}),
        ([], {0.5}),
    ):
        vectors, model = quality.learned(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        rows = quality.score(vectors, model, ["doc_id"]).collect()
        assert len(rows) == len(ROWS) and {r["score"] for r in rows} == scores
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, 1), (9, 0), (11, 1)], "doc_id bigint, quality int")
    vectors, model = quality.learned(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(vectors, model, ["doc_id"]).collect())
    vectors, model = quality.learned(nothing(spark), labels)
    assert quality.score(vectors, model, ["doc_id"]).count() == 0
