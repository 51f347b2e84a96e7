"""The divergence audit against every pair of groups and every kept term in turn."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fenceline.llm import divergence

from .edge_tables import documents, nothing

SF = "/root/testdata/sf0.001"


def brute_terms(text):
    out, word = [], ""
    for c in text + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or ord(c) > 127:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_audit(rows, least=10, top=10):
    """rows of (lang, source, text)"""
    langs = defaultdict(lambda: defaultdict(Counter))
    docs = defaultdict(Counter)
    for lang, source, text in rows:
        words = brute_terms(text or "")
        langs[lang or ""][source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def numbers(count):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        p = {s: numbers(c) for s, c in sources.items()}
        q = numbers(sum(sources.values(), Counter()))
        for s in sources:
            far = [(sum(divergence.gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(divergence.gap(p[s][t], q[t]), t) for t in kept if sources[s][t] > 0 and p[s][t] > q[t]]
            for part, listed in (("pair", far), ("term", sorted(best, key=lambda x: (-x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(listed, key=lambda x: (-x[0], x[1].encode())), 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(df, **settings):
    return sorted(tuple(r) for r in divergence.divergence(df, **settings).collect())


@pytest.mark.parametrize("least", [10, 1])
def test_documents(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert audited(docs.repartition(5), least=least) == brute_audit(rows, least)


@pytest.mark.parametrize("least", [1, 2, 1000])
def test_edges(spark, least):
    """Nulls, repeated rows, groups without terms, languages without kept terms, clashing columns."""
    docs = documents(spark)
    extra = [(20, "alpha beta Alpha", None, "s"), (21, "alpha É é", "", None), (22, "12 34", "xx", "a"), (23, None, "xx", "b"), (24, "gamma", "yy", "only")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string"), allowMissingColumns=True)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert audited(docs, least=least) == brute_audit(rows, least)


def test_nothing(spark):
    assert audited(nothing(spark)) == []


def test_hot_group(spark):
    """A source and a term that hold most of the rows."""
    docs = spark.range(600).select(
        F.lit("en").alias("lang"), F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"),
        F.concat(F.lit("the the "), F.when(F.col("id") % 2 == 0, "even").otherwise("odd"), F.lit(" w"), F.translate((F.col("id") % 7).cast("string"), "0123456", "abcdefg")).alias("text"),
    )
    assert audited(docs) == brute_audit([tuple(r) for r in docs.collect()])


def test_paths():
    """Corrections of sorted rows, shared paths and multiplicities included, against all pairs of all rows."""
    rng = random.Random(4)
    z = {s: rng.randrange(1, 50) for s in range(8)}
    rows = Counter()
    for _ in range(400):
        rows[tuple(x for s in sorted(rng.sample(range(8), rng.randrange(1, 6))) for x in (s, rng.randrange(50, 53), z[s]))] += rng.randrange(1, 4)
    want = Counter()
    for row, m in rows.items():
        nodes = [row[i : i + 3] for i in range(0, len(row), 3)]
        for i, (a, p, y) in enumerate(nodes):
            for b, q, x in nodes[i + 1 :]:
                g = divergence.gap
                want[a, b] += m * (g(p, q) - g(p, x) - g(y, q) + g(y, x))
    tree = divergence.Paths()
    for row in sorted(rows):
        tree.insert(list(row), rows[row])
    assert tree.close() == want and not tree.path and not tree.sums


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(divergence, "LONG", 5)
    assert divergence.terms("Ab ab, éÉ ab1b") == Counter(brute_terms_utf8("Ab ab, éÉ ab1b"))


def brute_terms_utf8(text):
    return [t.encode() for t in brute_terms(text)]
