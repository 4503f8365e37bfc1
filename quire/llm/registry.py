"""The subpackage's queries, their oracles, and the paths they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, fingerprint, html, jaccard, packing, quality, secrets, topk, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_bpe, op4_secrets, op5_fingerprints, op6_topk, op7_quality, op8_html, op9_jaccard_join, op10_packing)}


def _secrets_oracle() -> str:
    """Op 4 in SQL: places by running sums over unnested pieces, links by a join of the parts of a text.

    SQL's patterns fold letters beyond ASCII and know no look-around, so that cases are written out, and a weak access identifier
    is a whole run of letters and digits.
    """
    cased = lambda words: "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words) + ")"
    value = r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    kinds = [
        ("assign", cased(["password", "passwd", "secret", "token", "api_?key"]) + value, 1),
        ("access", r"AKIA[A-Z0-9]{14,}", 0),
        ("hex", r"[0-9a-f]{16,}", 0),
        ("weak_access", r"[A-Za-z0-9]*AKIA[A-Za-z0-9]*", 0),
        ("user", cased(["client_?id", "access_?key_?id", "account_?id", "username", "user_?id", "login"]) + value, 1),
        ("endpoint", r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\t\n\x0B\f\r\x20\"'<>]+", 0),
    ]
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, string_split_regex(t, {quoted(p)}) AS a, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS g FROM d" for kind, p, group in kinds
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
u AS (SELECT r, kind, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g) AS g, unnest(a[1:len(m)]) AS a FROM f WHERE len(m) > 0),
placed AS (SELECT r, kind, m, length(g) AS n, sum(length(a) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
p AS (
  SELECT r, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN kind = 'assign' AND n < 12 THEN 'weak_secret' ELSE kind END AS kind FROM placed
  WHERE (kind <> 'assign' OR n >= 6) AND (kind <> 'weak_access' OR regexp_full_match(m, 'AKIA[A-Z0-9]{{8,13}}'))
),
beside AS (
  SELECT p.r, p.s, p.e, p.kind, coalesce(bool_or(q.kind IN ('assign', 'weak_secret')), false) AS secret,
         coalesce(bool_or(q.kind IN ('access', 'weak_access', 'user')), false) AS identifier, coalesce(bool_or(q.kind = 'endpoint'), false) AS endpoint
  FROM p LEFT JOIN p q ON p.r = q.r AND q.s - p.e <= 300 AND p.s - q.e <= 300 GROUP BY p.r, p.s, p.e, p.kind
),
k AS (
  SELECT r, s, e, kind, list_position(['assign', 'access', 'hex', 'weak_secret', 'weak_access', 'user', 'endpoint'], kind) AS o FROM beside
  WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'weak_secret' AND (identifier OR endpoint)) OR (kind IN ('weak_access', 'user') AND secret)
     OR (kind = 'endpoint' AND secret AND identifier)
),
w AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, o, e) FILTER (o <= 3) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, o, e) AS spans
  FROM k GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN w USING (r)
"""


#: DuckDB SQL of the queries that SQL can express.
ORACLES = {
    "op4_secrets": _secrets_oracle(),
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM l),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (na + nb - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT l.doc_id, len(l.s) AS n_shingles, coalesce(t.component_id, l.doc_id) AS component_id FROM l LEFT JOIN least t ON l.doc_id = t.doc_id
""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
