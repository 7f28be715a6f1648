"""The operators of this subpackage as registered queries, with SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evseq.llm import bpe, fingerprints, html_extract, licenses, merkle, minhash_dedup, mixing, phrases, substring_dedup, suffix_dedup, toxicity, url_filters, vector_dedup
from evseq.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.articles(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.self_check(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.placed(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.sealed(table(spark, sf_dir, "documents")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).drop("repeats")


def queries() -> dict[str, Query]:
    own = (op1_license_scan, op2_toxicity, op3_embedding_dedup, op4_html_extraction, op5_fingerprints, op6_url_filters, op7_minhash_dedup, op8_mixing, op9_byte_bpe, op10_suffix_dedup, op11_phrase_mining, op12_merkle_manifest, op13_substring_dedup)
    return {f.__name__: f for f in own}


def _url_sql() -> str:
    host = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END"
    path = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(h + p)}, {quoted(v)}, 1, {quoted(h)}, {quoted(p)}, '')" for v, h, p in url_filters.RULES)
    marks = ", ".join(f"({quoted(p)}, {quoted(v)}, 0, '', '', {quoted(p.replace('_', chr(1) + '_').replace('*', '%'))})" for v, p in url_filters.PATTERNS)
    return f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, url, translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {path} AS path FROM pages),
r(rule, verdict, tier, h, p, pattern) AS (VALUES {rules}, {marks}),
m AS (SELECT rid, rule, verdict, tier, row_number() OVER (PARTITION BY rid ORDER BY tier DESC, length(rule) DESC, rule DESC) AS n FROM u, r
  WHERE (tier = 1 AND strpos(coalesce(url, ''), '://') > 0 AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) OR (tier = 0 AND lower(coalesce(url, '')) LIKE pattern ESCAPE chr(1)))
SELECT page_id, host, path, CASE WHEN tier = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) m USING (rid)"""


VECTOR_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.rid <> b.rid WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(a, b) AS (SELECT rid, rid FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM (SELECT v.rid, any_value(v.vec_id) AS vec_id, (SELECT count(*) FROM p WHERE p.a = v.rid) AS n_links, min(t.vec_id) AS component_id FROM v JOIN r ON r.a = v.rid JOIN v t ON t.rid = r.b GROUP BY v.rid)"""

MINHASH_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
e AS (SELECT rid, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT rid, rid FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM (SELECT s.rid, any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.g)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN r ON r.a = s.rid JOIN s t ON t.rid = r.b GROUP BY s.rid)"""

SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rid, i, substr(h, 2 * i + 1, 400) AS s FROM (SELECT rid, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, i AS a, max(i + 200) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING EXCLUDE CURRENT ROW) AS e, i + 200 AS z FROM f),
m AS (SELECT rid, a, z, sum(CAST(e IS NULL OR a > e AS INTEGER)) OVER (PARTITION BY rid ORDER BY a) AS k FROM c),
t AS (SELECT rid, k, min(a) AS a, max(z) AS z FROM m GROUP BY rid, k),
q AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS b FROM t),
o AS (SELECT rid, count(*) AS n, sum(z - a) AS r, max(z) AS last, list(struct_pack(b := b, a := a) ORDER BY a) AS gaps FROM q GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN r IS NULL THEN h ELSE array_to_string(list_transform(gaps, lambda x: substr(h, 2 * x.b + 1, 2 * (x.a - x.b))), '') || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN o USING (rid)"""


PHRASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM g GROUP BY lang, k, p HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, p, string_split(p, ' ') AS w, a FROM f WHERE k > 1),
parts AS MATERIALIZED (SELECT lang, p, w, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT q.lang, q.p, q.a, j, x.a AS l, y.a AS r, 2000000 * CAST(q.a AS HUGEINT) // (x.a + y.a) AS score FROM parts q JOIN f x ON x.lang = q.lang AND x.p = q.x JOIN f y ON y.lang = q.lang AND y.p = q.y),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_ AS MATERIALIZED (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS q FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) s(m) WHERE m < k)),
gone AS (SELECT DISTINCT c.lang, c.p FROM inner_ i JOIN c ON c.lang = i.lang AND c.p = i.q WHERE 100 * i.a >= 80 * c.a),
r AS (SELECT lang, p AS phrase, a, l, r, score FROM low ANTI JOIN gone USING (lang, p))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang) USING (lang) QUALIFY rank <= 2000"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
f AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1),
x AS (SELECT rid, doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.rid, count(*) AS n, count(f.i) AS gone, coalesce(string_agg(x.v, ' ' ORDER BY x.i) FILTER (f.i IS NULL), '') AS t FROM x LEFT JOIN f ON f.rid = x.rid AND f.i = x.i GROUP BY x.rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))"
    # The CRC-32, bit by bit: each byte into the low bits, then eight steps of the reversed polynomial.
    bits = "list_reduce(list_prepend(xor(x, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda x, c: {bits}), CAST(4294967295 AS UBIGINT))"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, {leaf("text")} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
o AS (SELECT rid, doc_id, leaf, tampered, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(lv, g, i, n, node) AS (SELECT 0, g, i, n, leaf FROM o UNION ALL SELECT lv + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, g, i // 3, n),
b AS (SELECT g, lv AS height, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, n, node) AS (SELECT 0, i, n, subroot FROM b UNION ALL SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 3, n),
steps AS (
  SELECT o.rid, t.lv, t.i AS k, t.i < o.i // CAST(pow(3, t.lv) AS BIGINT) AS before, t.node FROM o JOIN t ON t.g = o.g AND t.n > 1 AND t.i // 3 = o.i // CAST(pow(3, t.lv + 1) AS BIGINT) AND t.i <> o.i // CAST(pow(3, t.lv) AS BIGINT)
  UNION ALL SELECT o.rid, b.height + u.lv, u.i, u.i < b.i // CAST(pow(3, u.lv) AS BIGINT), u.node FROM o JOIN b ON b.g = o.g JOIN u ON u.n > 1 AND u.i // 3 = b.i // CAST(pow(3, u.lv + 1) AS BIGINT) AND u.i <> b.i // CAST(pow(3, u.lv) AS BIGINT)),
p AS (SELECT rid, lv, coalesce(string_agg(node, '' ORDER BY k) FILTER (before), '') AS l, coalesce(string_agg(node, '' ORDER BY k) FILTER (NOT before), '') AS r FROM steps GROUP BY rid, lv),
f(rid, lv, height, acc) AS (
  SELECT o.rid, 0, b.height + (SELECT max(lv) FROM u), coalesce(tampered, leaf) FROM o JOIN b ON b.g = o.g
  UNION ALL SELECT f.rid, f.lv + 1, f.height, sha256(coalesce(p.l, '') || f.acc || coalesce(p.r, '')) FROM f LEFT JOIN p ON p.rid = f.rid AND p.lv = f.lv WHERE f.lv < f.height),
q AS (SELECT rid, string_agg(l || r, '' ORDER BY lv) AS proof FROM p GROUP BY rid)
SELECT o.doc_id, o.leaf, b.subroot, z.node AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.acc AS folded_root, f.acc = z.node AS verified
FROM o JOIN b ON b.g = o.g JOIN u z ON z.n = 1 JOIN f ON f.rid = o.rid AND f.lv = f.height LEFT JOIN q ON q.rid = o.rid"""


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL: every pair, every substring. For the small tables that oracles run on."""
    return {"op3_embedding_dedup": VECTOR_SQL, "op6_url_filters": _url_sql(), "op7_minhash_dedup": MINHASH_SQL, "op10_suffix_dedup": SUFFIX_SQL, "op11_phrase_mining": PHRASE_SQL, "op12_merkle_manifest": _merkle_sql(), "op13_substring_dedup": SUBSTRING_SQL}
