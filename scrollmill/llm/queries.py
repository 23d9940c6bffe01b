"""Queries of this package by name: (spark, sf_dir) to DataFrame, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path, settle
from .bpe import round_trip
from .chat import read_back, segments
from .decontaminate import find_contamination
from .embedding_dedup import near_vectors
from .ngram_join import ngram_components
from .license_scan import APART, BASE, DENSE, DRIFT, FEW, HELD, MANY, OWN, SHORT, scan_licenses
from .sharding import document_shards
from .source_divergence import divergence
from .spelling_variants import spelling_variants
from .substring_dedup import near_passages
from .suffix_dedup import repeated_spans
from .token_counts import count_tokens
from .toxicity import score_documents

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two deliveries to a cache of this run: the second joins the counts that the first has stored, and appends to them."""
    docs, path, cache = _read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-counts")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    # Written at once: in one plan, Spark would take the cache before and after the second delivery for the same table.
    first = settle(count_tokens(docs.where(early), path, cache), "counted")
    return first.unionByName(count_tokens(docs.where(~early), path, cache))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(_read(spark, sf_dir))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_read(spark, sf_dir), k=4, num=85, den=100)


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.b, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE f AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM f
), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.9
), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, min(b) AS b FROM r GROUP BY a
), k AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage; texts without one are not listed."""
    return repeated_spans(_read(spark, sf_dir)).drop("row", "first_row")


OP7_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), v AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50)
), f AS (SELECT doc_id, s, first_value(doc_id) OVER o AS fd, first_value(s) OVER o AS fs FROM v WINDOW o AS (PARTITION BY x ORDER BY doc_id, s)
), g AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS gap FROM f WHERE fd <> doc_id OR fs <> s
), h AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g)
SELECT doc_id, min(s)::INTEGER AS "start", (max(s) + 50)::INTEGER AS "end", arg_min(fd, s) AS first_doc_id, arg_min(fs, s)::INTEGER AS first_start FROM h GROUP BY doc_id, span
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each near-duplicate passage; texts without one are not listed."""
    return near_passages(_read(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_read(spark, sf_dir), _read(spark, sf_dir, "benchmark")).drop("spans")


OP9_SQL = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS m, unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2), lambda k: ws[k:k + least(len(ws), 13) - 1])) AS x
  FROM i WHERE len(ws) > 0
), d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), v AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS k, ws FROM d, (SELECT DISTINCT m FROM q) WHERE len(ws) >= m
), o AS (SELECT v.doc_id, v.k, v.m, q.item_id FROM v JOIN q ON q.m = v.m AND q.x = v.ws[v.k:v.k + v.m - 1]
), h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS k FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP10_OWN = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", OP10_OWN), (-7, 1, "assistant", OP10_OWN)], "conv_id long, turn long, role string, text string")
    return read_back(segments(turns.unionByName(own)))


OP10_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{OP10_OWN}' UNION ALL SELECT -7, 1, 'assistant', '{OP10_OWN}'
), e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, regexp_replace(regexp_replace(replace(role || text, '\', '\\'), '<(s>|/s>)', '\\l\1', 'g'), '\[(INST\]|/INST\])', '\\b\1', 'g') AS x FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, sum(length(x) + 20)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') ELSE before || ' ' || role IN ('system user', 'user assistant', 'assistant user') END) AS in_order
FROM e GROUP BY conv_id
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir))


# crc32 by its table of 256 values; words that are near by what is left when one code point is deleted.
OP11_SQL = r"""
WITH RECURSIVE z AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)
), r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), x AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM r
), h AS (SELECT run, k, xor(list_reduce(list_transform(range(1, len(hx) // 2 + 1), lambda j: ('0x' || substr(hx, 2 * j - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM x, z
), w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), d AS (SELECT word, k, left(word, k) || substr(word, k + 2) AS x FROM (SELECT word, unnest(range(length(word))) AS k FROM w)
), p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.k = b.k AND a.x = b.x AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.x = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.x = w.word
), f AS (SELECT a AS word, count(*) AS n_near, max(w.n) AS best FROM p JOIN w ON w.word = b GROUP BY a
), g AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best >= 5 * w.n THEN best END AS form_n FROM w LEFT JOIN f ON f.word = w.word
), e AS (SELECT g.word, g.n, g.n_near, g.form_n, min(o.word) AS form FROM g LEFT JOIN p ON p.a = g.word LEFT JOIN w o ON o.word = p.b AND o.n = g.form_n GROUP BY ALL
), t(word, root) AS (SELECT word, word FROM e UNION ALL SELECT t.word, e.form FROM t JOIN e ON e.word = t.root WHERE e.form IS NOT NULL
), u AS (SELECT t.word, t.root FROM t JOIN e ON e.word = t.root WHERE e.form IS NULL)
SELECT e.word, e.form, u.root, e.n, e.n_near, e.form_n FROM e JOIN u ON u.word = e.word
""".replace("{LOWER}", LOWER_SQL)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_read(spark, sf_dir))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), o AS (SELECT r, lang, source, unnest(ws) AS t FROM d
), k AS (SELECT lang, t, count(*)::HUGEINT AS c FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 30
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c) AS n FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, t, count(*)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, t) GROUP BY ALL
), a AS (SELECT lang, source, t, k.c, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)
), s AS (SELECT lang, source, sum(n) AS total FROM a GROUP BY lang, source
), p AS (SELECT lang, source, t, a.n, 1 + (1000000000 * (a.n + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (c + 5)) // (v.n + 5 * v) AS q FROM a JOIN s USING (lang, source) JOIN v USING (lang)
), f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL
), m AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM m) WHERE part = 'pair' OR rank <= 50
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), l AS (SELECT *, len(w) AS size, CASE WHEN len(w) < {SHORT} THEN {FEW} ELSE {MANY} END AS k FROM (SELECT n, label, base, string_split(x, ' ') AS w FROM (VALUES {", ".join(f"({n}, '{x.label}', {x.base}, '{x.text}')" for n, x in enumerate(BASE + OWN))}) v(n, label, base, x))
), i AS (SELECT n, label, base, size, k, t - 1 AS t, array_to_string(w[t:t + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, size - k + 2)) AS t FROM l)
), v AS (SELECT r, p - 1 AS p, k, array_to_string(ws[p:p + k - 1], ' ') AS x FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (VALUES ({FEW}), ({MANY})) s(k))
), h AS (SELECT r, n, label, base, size, i.k, p - t AS diagonal, list_sort(list_distinct(list(t))) AS places FROM v JOIN i ON i.k = v.k AND i.x = v.x GROUP BY ALL
), b AS (SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h WHERE base AND len(places) = size - k + 1 GROUP BY r
), c AS (SELECT *, sum(new) OVER (PARTITION BY r, n ORDER BY diagonal) AS span FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, n ORDER BY diagonal) <= least(size // {APART}, {DRIFT}) THEN 0 ELSE 1 END AS new FROM h)
), e AS (SELECT r, n, label, size, span, len(list_distinct(flatten(list(list_transform(places, lambda t: range(t, t + k)).flatten())))) AS held, sum(len(list_distinct(list_transform(places, lambda t: range(t, t + k)).flatten()))) AS words,
  max(diagonal + places[-1] + k) - min(diagonal + places[1]) AS width FROM c GROUP BY ALL
), o AS (SELECT r, max(held / size) AS score, list(label) FILTER (CASE WHEN size < {SHORT} THEN held = size ELSE held / size >= {HELD} AND least(words / width, 1) >= {DENSE} END) AS own FROM e GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(string_split(coalesce(base_labels, ''), ','), coalesce(own, [])).list_filter(lambda y: y <> ''))), ',') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN o ON o.r = d.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scan": op13_license_scan,
}
ORACLES: dict[str, str] = {"op3_ngram_jaccard": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op9_decontamination": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_license_scan": OP13_SQL}
