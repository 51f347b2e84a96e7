"""The registered queries of this subpackage, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import ship
from . import bpe, divergence, licenses, manifest, mixing, packing, pii, quality, secrets, simhash, tokens, topk, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[function.__name__] = run
    return function


@query
def op1_quality(table):
    vectors, model = quality.learned(table("documents"), table("labels"))
    scored = quality.score(vectors, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_pii(table):
    return pii.personal_data(table("documents"))


@query
def op3_packing(table):
    pieces = packing.pack(table("documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_winnowing(table):
    return winnow.edited(table("documents"))


@query
def op5_simhash(table):
    found = simhash.near_duplicates(table("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_licenses(table):
    return licenses.licenses(table("documents"))


@query
def op7_secrets(table):
    return secrets.secrets(table("documents"))


def _secrets_sql() -> str:
    """Matches and what lies between them by the same patterns, owners counted per value."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        p = pattern.replace("'", "''")
        found.append(f"""SELECT rw, owner, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(text, '{p}', 0) AS hits,
            regexp_extract_all(text, '{p}', {group}) AS vals, regexp_split_to_array(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS)
    span = "kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rank"
    names = [*[f"n_{k}" for k in secrets.KINDS], "n_live", "n_copied", "most_owners", "most_repositories"]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rw, doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(found)}),
e AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m),
f AS (
  SELECT rw, owner, kind, rank, len(hits[i]) AS size, sha256(vals[i]) AS h,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + list_sum(list_transform(hits[1:i], lambda x: len(x))) AS BIGINT) AS stop
  FROM e WHERE len(vals[i]) >= least
),
o AS (SELECT h, count(DISTINCT owner) AS owners FROM f GROUP BY h),
g AS (
  SELECT rw, {counts}, string_agg({span}) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg({span}) AS spans,
    count(*) FILTER (owners <= {secrets.OWNERS}) AS n_live, count(*) FILTER (owners > {secrets.OWNERS}) AS n_copied,
    max(owners) AS most_owners, max(owners) AS most_repositories
  FROM f JOIN o USING (h) GROUP BY rw
)
SELECT doc_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in names)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rw)
"""


ORACLES["op7_secrets"] = _secrets_sql()


@query
def op8_tokens(table):
    return tokens.token_counts(table("documents"))


@query
def op9_topk(table):
    vectors = table("embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLES["op9_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op10_mixing(table):
    return mixing.mix(table("documents"))


@query
def op11_bpe(table):
    found = bpe.encoded(table("documents"), back=True)
    size = F.floor(F.length("ids") / 4).cast("bigint")
    return found.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op12_divergence(table):
    return divergence.divergence(table("documents"))


ORACLES["op12_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS rw, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rw, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rw) >= {divergence.LEAST}),
l AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = s.lang AND c.source = s.source) AS whole FROM (SELECT DISTINCT lang, source FROM d) s),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + {divergence.SCALE}::HUGEINT * (coalesce(n, 0) + {divergence.PRIOR}) // (g.whole + {divergence.PRIOR} * l.v)::HUGEINT AS p,
    1 + {divergence.SCALE}::HUGEINT * (k.total + {divergence.PRIOR}) // (l.whole + {divergence.PRIOR} * l.v)::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
),
a AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item,
    (SELECT coalesce(sum((i.p - j.p) * (i.p - j.p) // (i.p + j.p)), 0) FROM p i JOIN p j ON j.lang = i.lang AND j.term = i.term WHERE i.lang = x.lang AND i.source = x.source AND j.source = y.source) AS value
  FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


@query
def op13_manifest(table):
    found = manifest.audited(table("documents"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def _manifest_sql() -> str:
    """Levels by a recursive grouping, then every leaf's walk up its group and the groups; CRC-32 bit by bit."""

    def written(**changed) -> str:
        values = [f"CAST({changed.get(c, c)} AS VARCHAR)" for c in manifest.COLUMNS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    digits = "CAST(doc_id AS VARCHAR)"
    # Nine steps for each digit: the character first, then its eight bits.
    steps = f"list_transform(range(0, 9 * len({digits})), lambda i: CASE WHEN i % 9 = 0 THEN CAST(ascii(substr({digits}, CAST(i // 9 + 1 AS INTEGER), 1)) AS BIGINT) ELSE -1 END)"
    turn = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, b: {turn}))"

    def walk(name: str, nodes: str, start: str) -> str:
        sibling = "coalesce(s.h, '')"
        return f"""{name}(rw, lang, level, pos, n, now, proof) AS ({start} UNION ALL
  SELECT w.rw, w.lang, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN w.now || {sibling} ELSE {sibling} || w.now END), w.proof || {sibling}
  FROM {name} w LEFT JOIN {nodes} s ON s.lang = w.lang AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""

    def grown(name: str, start: str) -> str:
        return f"""{name}(lang, level, pos, n, h) AS ({start} UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lang, level, pos // 2, n)"""

    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rw, doc_id, coalesce('=' || lang, '') AS lang, {written()} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {written(n_chars="n_chars + 1")} ELSE {written()} END AS tried
  FROM documents
),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
{grown("t", "SELECT lang, 0, pos, n, leaf FROM p")},
g AS (SELECT lang AS name, h AS subroot, row_number() OVER (ORDER BY lang) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{grown("u", "SELECT '', 0, pos, n, subroot FROM g")},
{walk("w", "t", "SELECT rw, lang, 0, pos, n, tried, '' FROM p")},
{walk("x", "u", "SELECT w.rw, '', 0, g.pos, g.n, w.now, w.proof FROM w JOIN g ON g.name = w.lang WHERE w.n = 1")}
SELECT p.doc_id, p.leaf, g.subroot, u.h AS root, sha256(x.proof) AS proof_sha256, x.now AS folded_root, x.now = u.h AS verified
FROM p JOIN g ON g.name = p.lang JOIN x ON x.rw = p.rw AND x.n = 1 CROSS JOIN (SELECT h FROM u WHERE n = 1) u
"""


ORACLES["op13_manifest"] = _manifest_sql()
