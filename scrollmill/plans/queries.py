"""Queries of the archive by name, and DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import html_to_markdown
from ..operators import archive as A
from ..operators import pages as P
from ..operators import render as R
from ..operators import search as S
from ..operators.stored_index import StoredIndex
from ..sources import store
from ..sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NORM = """array_to_string(list_filter(list_transform(string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"""
_M = "m AS (SELECT conv_id, turn, CASE WHEN role IN ('system', 'tool') THEN 'user' ELSE role END AS role, coalesce(text, '') AS body FROM conversations)"
_W = _M + ", w AS (SELECT conv_id, turn, role, regexp_extract_all(strip_accents(lower(body)), '[\\p{L}\\p{N}]+') AS ws FROM m)"


def _norm(column: str) -> str:
    return _NORM.replace("{0}", column)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("archive_counts", f"WITH {_M} SELECT count(DISTINCT conv_id)::BIGINT AS documents, count(*)::BIGINT AS messages FROM m")
def archive_counts(spark, d):
    m = src.messages(spark, d)
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("messages"))


@query("turn_counts", f"WITH {_M} SELECT conv_id, count(*)::BIGINT AS turn_count, max(turn)::BIGINT AS last_turn FROM m GROUP BY conv_id")
def turn_counts(spark, d):
    return src.messages(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turn_count"), F.max("turn").cast("long").alias("last_turn"))


@query("normalised_messages", f"WITH {_M} SELECT conv_id, turn, role, {_norm('body')} AS body FROM m")
def normalised_messages(spark, d):
    return src.messages(spark, d).withColumn("body", T.normalise(F.col("body")))


_HASH = f"""WITH {_M}, c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256('web' || chr(31) || string_agg(chr(30) || role || chr(31) || {_norm('body')}, '' ORDER BY turn)) AS h FROM m GROUP BY conv_id)"""


@query("body_hash", _HASH + " SELECT conv_id, n_turns, h AS body_hash FROM c")
def body_hash(spark, d):
    return A.body_hashes(src.messages(spark, d))


@query("fingerprint_short16", _HASH + " SELECT conv_id, substr(h, 1, 16) AS fingerprint FROM c")
def fingerprint_short16(spark, d):
    return A.body_hashes(src.messages(spark, d)).select("conv_id", F.substring("body_hash", 1, 16).alias("fingerprint"))


def _fingerprinted(spark, d):
    return src.documents(spark, d).select("doc_id", F.when(T.is_populated(F.col("text")), T.digest(T.normalise(F.col("text")))).otherwise("").alias("fingerprint"))


_FP = f"f AS (SELECT doc_id, sha256({_norm('text')}) AS fingerprint FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '')"


@query("duplicate_groups", f"WITH {_FP} SELECT fingerprint, count(*)::BIGINT AS n, min(doc_id) AS first FROM f GROUP BY fingerprint HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return A.duplicate_groups(_fingerprinted(spark, d), "doc_id", "fingerprint")


@query("duplicate_members", f"WITH {_FP} SELECT fingerprint, doc_id FROM f WHERE fingerprint IN (SELECT fingerprint FROM f GROUP BY fingerprint HAVING count(*) > 1)")
def duplicate_members(spark, d):
    return A.duplicate_members(_fingerprinted(spark, d), "doc_id", "fingerprint")


# -- tags and detection -------------------------------------------------------------------------------------------
# The given texts hold no block syntax, so both sides put some around them by doc_id.
def _formed(spark, d):
    k, t = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    body = F.when(k == 0, F.concat(F.lit("```Python\n"), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit("# "), t)).when(k == 2, F.concat(F.lit("| a | b |\n| - | - |\n"), t))
    body = body.when(k == 3, F.concat(F.lit("![x](y.png) "), t)).when(k == 4, F.concat(t, F.lit("\n* * *\n"))).when(k == 5, F.concat(F.lit("  ~~~ brainfuck\n"), t)).otherwise(t)
    return src.documents(spark, d).select("doc_id", body.alias("body"))


_FORMED = """f AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '```Python' || chr(10) || t || chr(10) || '```' WHEN 1 THEN '# ' || t WHEN 2 THEN '| a | b |' || chr(10) || '| - | - |' || chr(10) || t
  WHEN 3 THEN '![x](y.png) ' || t WHEN 4 THEN t || chr(10) || '* * *' || chr(10) WHEN 5 THEN '  ~~~ brainfuck' || chr(10) || t ELSE t END AS body FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""
_TAGS = f"""WITH {_FORMED}, g AS (SELECT doc_id, list_concat(list_filter(list_transform(regexp_extract_all(body, '{T.FENCE_NAME}', 1), lambda x: lower(x)), lambda x: x IN ({", ".join(repr(x) for x in T.LANGUAGES)})), list_filter([
  CASE WHEN regexp_matches(body, '{T.FENCE}') THEN 'code' END, CASE WHEN contains(body, '$') OR contains(body, chr(92) || '(') THEN 'math' END, CASE WHEN regexp_matches(body, '{T.TABLE_ROW}') THEN 'table' END,
  CASE WHEN contains(body, '![') THEN 'image' END, CASE WHEN length(body) > 20000 THEN 'long' END], lambda x: x IS NOT NULL)) AS tags FROM f)"""


@query("content_tags", _TAGS + " SELECT doc_id, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM g")
def content_tags(spark, d):
    return _formed(spark, d).select("doc_id", F.array_join(T.body_tags(F.col("body")), ",").alias("tags"))


@query("tag_counts", _TAGS + " SELECT tag, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(list_distinct(tags)) AS tag FROM g) GROUP BY tag")
def tag_counts(spark, d):
    return _formed(spark, d).select(F.explode(T.body_tags(F.col("body"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("looks_like_markdown", f"WITH {_FORMED} SELECT doc_id, regexp_matches(body, '{T.MARKDOWN}') AS markdown FROM f")
def looks_like_markdown(spark, d):
    return _formed(spark, d).select("doc_id", T.looks_like_markdown(F.col("body")).alias("markdown"))


# -- names --------------------------------------------------------------------------------------------------------
_TITLE = f"WITH {_M}, u AS (SELECT conv_id, arg_min(body, turn) AS body FROM m WHERE role = 'user' GROUP BY conv_id), t AS (SELECT conv_id, trim(substr(coalesce(list_filter(string_split(body, chr(10)), lambda l: l <> '')[1], ''), 1, 120)) AS title FROM u)"


def _titles(spark, d):
    first = src.messages(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.min_by("body", "turn").alias("body"))
    return first.select("conv_id", T.first_line(F.col("body")).alias("title"))


@query("resolved_title", _TITLE + " SELECT conv_id, title FROM t")
def resolved_title(spark, d):
    return _titles(spark, d)


@query(
    "safe_filename",
    _TITLE + r""", a AS (SELECT conv_id, trim(regexp_replace(regexp_replace(title, '[/:*?"<>|\\]+', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM t
), b AS (SELECT conv_id, regexp_replace(regexp_replace(x, '[ .,_-]+$', ''), '^\.+', '') AS x FROM a)
SELECT conv_id, CASE WHEN length(x) <= 80 THEN x WHEN regexp_matches(substr(x, 1, 80), '^.+ ') THEN regexp_replace(substr(x, 1, 80), ' [^ ]*$', '') ELSE substr(x, 1, 80) END AS name FROM b""",
)
def safe_filename(spark, d):
    return _titles(spark, d).select("conv_id", T.safe_filename(F.col("title")).alias("name"))


@query(
    "collision_filenames",
    "SELECT doc_id, CASE WHEN r = 1 THEN name ELSE name || ' (' || r || ')' END AS final FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM (SELECT doc_id, source || '-' || lang AS name FROM documents))",
)
def collision_filenames(spark, d):
    return A.collision_names(src.documents(spark, d).select("doc_id", F.concat_ws("-", "source", "lang").alias("name")), "name", "doc_id").select("doc_id", "final")


# -- search -------------------------------------------------------------------------------------------------------
def _bm25_sql(words: list[str], tail: str = "") -> str:
    parts = []
    for k, w in enumerate(words):
        tf = f"len(list_filter(ws, lambda x: x = '{w}'))" if " " not in w else f"len(list_filter(range(1, len(ws)), lambda i: ws[i] = '{w.split()[0]}' AND ws[i + 1] = '{w.split()[1]}'))"
        parts.append(f"p{k} AS (SELECT conv_id, turn, {tf} AS tf, len(ws) AS dl FROM w), s{k} AS (SELECT conv_id, turn, -greatest(ln((n - df + 0.5) / (df + 0.5)), CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN 0 ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM p{k}, (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM p{k}) WHERE tf > 0)")
    joins = " ".join(f"JOIN s{k} USING (conv_id, turn)" for k in range(1, len(words)))
    total = " + ".join(f"s{k}.score" for k in range(len(words)))
    return f"WITH {_W}, {', '.join(parts)} SELECT conv_id, turn, round({total}, 9) AS score FROM s0 {joins} {tail}"


_KEYS = ["conv_id", "turn"]


def _index(spark, d) -> StoredIndex:
    """The stored index of the messages as they are now: made by the first search of a table, read by all later ones."""
    index = StoredIndex(spark, f"{store.shared_dir(spark)}/fts-{store.version_of(spark, f'{d}/conversations.parquet')}", "conv_id", "long")
    if index.latest() is None:
        index.refresh(src.messages(spark, d))
    return index


def _hits(spark, d, q, **options):
    return _index(spark, d).search(q, **options)


@query("fts_term", _bm25_sql(["the"]))
def fts_term(spark, d):
    return _hits(spark, d, "the").withColumn("score", F.round("score", 9))


@query("fts_and_terms", _bm25_sql(["the", "that"]))
def fts_and_terms(spark, d):
    return _hits(spark, d, "The that").withColumn("score", F.round("score", 9))


@query("fts_phrase", _bm25_sql(["of the"]))
def fts_phrase(spark, d):
    return _hits(spark, d, "of/the").withColumn("score", F.round("score", 9))


@query("fts_topk", _bm25_sql(["the"], "ORDER BY score, conv_id, turn LIMIT 50"))
def fts_topk(spark, d):
    return S.top(_hits(spark, d, "the").withColumn("score", F.round("score", 9)), _KEYS)


@query("fts_stemmed")
def fts_stemmed(spark, d):
    return _hits(spark, d, "tions the", stemmed=True)


def _top_with_text(spark, d, q):
    return S.top(_hits(spark, d, q, stemmed=True), _KEYS).join(src.messages(spark, d), _KEYS).withColumn("snippet", S.snippet(q)("body")).drop("body")


@query("fts_snippet")
def fts_snippet(spark, d):
    return _top_with_text(spark, d, "the")


@query("search_report")
def search_report(spark, d):
    return S.report(_top_with_text(spark, d, "the"), "the", "conv_id", counts=archive_counts(spark, d), folder="archive")


@query("index_terms", f"WITH {_W} SELECT t AS term, count(*)::BIGINT AS df FROM (SELECT unnest(list_distinct(ws)) AS t FROM w) GROUP BY t")
def index_terms(spark, d):
    """The index's own dictionary: each word and the messages that hold it."""
    return _index(spark, d).read("terms").select("term", "df")


@query("index_statistics", f"WITH {_W} SELECT count(*)::BIGINT AS messages, sum(len(ws))::BIGINT AS words, count(DISTINCT conv_id)::BIGINT AS documents FROM w")
def index_statistics(spark, d):
    """Kept counts of the index, beside its documents."""
    index = _index(spark, d)
    now = index.latest()
    return index.read("documents").agg(F.lit(now.messages).cast("long").alias("messages"), F.lit(now.words).cast("long").alias("words"), F.count(F.lit(1)).alias("documents"))


# -- pages --------------------------------------------------------------------------------------------------------
@query("page_titles", r"SELECT page_id, trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS title FROM pages")
def page_titles(spark, d):
    return src.pages(spark, d).select("page_id", F.trim(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("title"))


@query("page_link_stats", r"SELECT page_id, len(regexp_extract_all(html, '<a[ >]'))::BIGINT AS links, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def page_link_stats(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), 0)).cast("long")
    return src.pages(spark, d).select("page_id", n("<a[ >]").alias("links"), n("<p[ >]").alias("paragraphs"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


@query("html_to_markdown")
def html_to_markdown_pages(spark, d):
    return src.spread(src.pages(spark, d)).select("page_id", html_to_markdown("html").alias("markdown"))


@query("extract_page")
def extract_page_regions(spark, d):
    found = P.extract_pages(src.spread(src.pages(spark, d)).select("page_id", "html"))
    return found.select("page_id", "ok", "title", "score", F.array_join("warnings", "; ").alias("warnings"), "markdown")


# -- merge and index ----------------------------------------------------------------------------------------------
# The incoming version of each conversation follows from its id: the same, longer, shorter, changed, or new.
def _versions(spark, d):
    m = src.messages(spark, d)
    k = F.col("conv_id") % 5
    existing = m.where((k != 4) & ~((k == 1) & (F.col("turn") > 0))).withColumn("intact", F.col("conv_id") % 11 != 0)
    body = F.when((k == 3) & (F.col("turn") == 0), F.concat("body", F.lit(" changed"))).when(k == 0, F.concat(F.lit("  "), "body", F.lit(" \n"))).otherwise(F.col("body"))
    return existing, m.where(~((k == 2) & (F.col("turn") > 0))).withColumn("body", body)


_VERSIONS = _M + f""", e AS (SELECT conv_id, turn, role, {_norm('body')} AS b FROM m WHERE conv_id % 5 <> 4 AND NOT (conv_id % 5 = 1 AND turn > 0)
), i AS (SELECT conv_id, turn, role, {_norm("CASE WHEN conv_id % 5 = 3 AND turn = 0 THEN body || ' changed' ELSE body END")} AS b FROM m WHERE NOT (conv_id % 5 = 2 AND turn > 0)
), ea AS (SELECT conv_id, list(role || chr(31) || b ORDER BY turn) AS x FROM e GROUP BY conv_id), ia AS (SELECT conv_id, list(role || chr(31) || b ORDER BY turn) AS x FROM i GROUP BY conv_id)"""


@query(
    "incremental_decision",
    f"""WITH {_VERSIONS} SELECT ia.conv_id, CASE WHEN ea.x IS NULL THEN 'write_new' WHEN ia.conv_id % 11 = 0 THEN 'write_alongside' WHEN ia.x = ea.x THEN 'unchanged'
  WHEN len(ia.x) > len(ea.x) AND ia.x[1:len(ea.x)] = ea.x THEN 'append' ELSE 'write_alongside' END AS action FROM ia LEFT JOIN ea USING (conv_id)""",
)
def incremental_decision(spark, d):
    return A.decide(*_versions(spark, d))


@query(
    "match_priority",
    f"""WITH {_VERSIONS}, c AS (SELECT ia.conv_id, ea.conv_id AS file, CASE WHEN ia.x = ea.x THEN 0 WHEN len(ea.x) < len(ia.x) AND ia.x[1:len(ea.x)] = ea.x THEN 1
  WHEN len(ea.x) = len(ia.x) AND 2 * len(list_filter(range(1, len(ia.x) + 1), lambda k: ia.x[k] = ea.x[k])) >= len(ia.x) THEN 2 END AS rank FROM ia, ea)
SELECT conv_id, arg_min(file, (rank, file)) AS file, ['exact', 'prefix', 'edited'][min(rank) + 1] AS how FROM c WHERE rank IS NOT NULL GROUP BY conv_id""",
)
def match_priority(spark, d):
    existing, incoming = _versions(spark, d)
    return A.match_existing(existing.withColumnRenamed("conv_id", "file"), incoming)


@query(
    "index_delta",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'removed' WHEN doc_id % 10 = 3 OR doc_id % 10 = 4 THEN 'changed' ELSE 'unchanged' END AS status FROM documents""",
)
def index_delta(spark, d):
    rows = src.documents(spark, d).select("doc_id", F.col("doc_id").cast("double").alias("mtime"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("byte_size"))
    k = F.col("doc_id") % 10
    seen = rows.where(k != 2).select("doc_id", F.when(k == 3, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), F.when(k == 4, F.col("byte_size") + 1).otherwise(F.col("byte_size")).alias("byte_size"))
    return A.index_delta(rows.where(k != 1), seen, "doc_id")


_READ_BACK = f"""b AS (SELECT * FROM m WHERE regexp_replace(body, '\\s+', '', 'g') <> ''
), h AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256('web' || chr(31) || string_agg(chr(30) || role || chr(31) || {_norm('body')}, '' ORDER BY turn)) AS body_hash FROM b GROUP BY conv_id)"""


@query("render_round_trip", f"WITH {_M}, {_READ_BACK} SELECT conv_id, n_turns, body_hash, true AS intact FROM h")
def render_round_trip(spark, d):
    return R.intact(R.render(src.messages(spark, d), "Claude", "2024-01-01"))


@query("frontmatter_fields", _TITLE + ", n AS (SELECT conv_id, count(*) FILTER (regexp_replace(body, '\\s+', '', 'g') <> '') AS k FROM m GROUP BY conv_id) SELECT conv_id, k::VARCHAR AS turns, '2024-01-01' AS day FROM n WHERE k > 0")
def frontmatter_fields(spark, d):
    fields = R.parse_frontmatter(F.col("document"))
    return R.render(src.messages(spark, d), "Claude", "2024-01-01").select("conv_id", fields["turns"].alias("turns"), fields["date"].alias("day"))


@query(
    "daily_notes",
    """WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS key, min(event_id) AS place, arg_max(event_type, event_id) AS title, arg_max(coalesce(props, ''), event_id) AS body FROM events GROUP BY 1, 2)
SELECT day, '# ' || day || chr(10) || chr(10) || string_agg('<!-- section:' || key || ' -->' || chr(10) || '## ' || title || chr(10) || chr(10) || body || chr(10) || '<!-- /section -->', chr(10) || chr(10) ORDER BY place) || chr(10) AS note FROM l GROUP BY day""",
)
def daily_notes(spark, d):
    rows = src.events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("title"), F.coalesce("props", F.lit("")).alias("body"))
    return R.daily_notes(rows)


# -- streams, in their batch form ---------------------------------------------------------------------------------
@query("accumulate_latest", "SELECT user_id, event_type, count(*)::BIGINT AS sightings, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def accumulate_latest(spark, d):
    return A.accumulate_latest(src.events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query(
    "harvest_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""",
)
def harvest_sessions(spark, d):
    s = A.idle_sessions(src.events(spark, d), "user_id", "ts", 6 * 3600)
    return s.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query(
    "confidence_score",
    """WITH g AS (SELECT conv_id, count(*) FILTER (role NOT IN ('user', 'assistant', 'reasoning')) AS odd, count(*) FILTER (coalesce(text, '') = '') AS bare FROM conversations GROUP BY conv_id)
SELECT conv_id, round(1.0::DOUBLE - CASE WHEN odd > 0 THEN 0.2 ELSE 0 END - CASE WHEN bare > 0 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score, odd = 0 AND bare = 0 AS reliable FROM g""",
)
def confidence_score(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "role", F.coalesce("text", F.lit("")).alias("body"))
    return A.extraction_confidence(rows)
