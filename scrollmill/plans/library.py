"""More queries of the archive, and DuckDB SQL with the same result: hits with their documents, passes, selections, harvests, small rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from ..operators import archive as A
from ..operators import elements as E
from ..operators import harvest as H
from ..operators import lines as L
from ..operators import render as R
from ..operators import saving as V
from ..operators import search as S
from ..operators.stored_index import StoredIndex
from ..sources import store
from ..sources import tables as src
from .queries import _FP, _KEYS, _M, _NORM, _READ_BACK, _TAGS, _VERSIONS, _TITLE, _bm25_sql, _fingerprinted, _formed, _hits, _titles, _versions, query

_SAFE_SQL = r"""regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({0}, '[/:*?"<>|\\]+', ' ', 'g'), '\s+', ' ', 'g')), '[ .,_-]+$', ''), '^\.+', '')"""


# -- search: hits with their documents, after a refresh of the index --------------------------------------------------
def _conversations(spark, d):
    """Documents of the archive: path, title, platform."""
    return _titles(spark, d).select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "title", F.lit("Claude").alias("platform"))


@query("search_hits", "WITH " + _TITLE.removeprefix("WITH ") + ", h AS (" + _bm25_sql(["the"], "ORDER BY score, conv_id, turn LIMIT 50") + ") SELECT h.conv_id, h.turn, h.score, m.role, t.conv_id || '.md' AS path, t.title, 'Claude' AS platform FROM h JOIN m USING (conv_id, turn) JOIN t ON t.conv_id = h.conv_id")
def search_hits(spark, d):
    hits = S.top(_hits(spark, d, "the").withColumn("score", F.round("score", 9)), _KEYS)
    return S.with_documents(hits.join(src.messages(spark, d).select(*_KEYS, "role"), _KEYS), _conversations(spark, d), "conv_id").select("conv_id", "turn", "score", "role", "path", "title", "platform")


def _archive(spark, d):
    """An index of messages that is out of date: of each tenth conversation nothing, of another one that is gone, of a third an older text."""
    m = src.messages(spark, d).withColumn("path", F.col("conv_id"))
    k = F.col("conv_id") % 10
    old = m.where(k != 1).withColumn("body", F.when(k == 3, "an older text").otherwise(F.col("body")))
    return old, m.where(k != 2)


@query("refreshed_search", _bm25_sql(["the", "that"]).replace("FROM conversations)", "FROM conversations WHERE conv_id % 10 <> 2)", 1))
def refreshed_search(spark, d):
    """A stored index of the old messages, refreshed with the conversations that differ now, and searched."""
    old, seen = _archive(spark, d)
    index = StoredIndex(spark, f"{store.shared_dir(spark)}/refreshed-{uuid.uuid4().hex}", "path", "long")
    index.refresh(old)
    changed = A.body_hashes(seen).join(A.body_hashes(old), ["conv_id", "body_hash"], "left_anti").select(F.col("conv_id").alias("path"))
    index.refresh(seen.join(changed, "path", "left_semi"), old.select("path").distinct().join(seen.select("path"), "path", "left_anti"))
    return index.search("the that").select(F.col("path").alias("conv_id"), "turn", F.round("score", 9).alias("score"))


_STATES = """o AS (SELECT doc_id, doc_id::DOUBLE AS t, coalesce(octet_length(encode(text)), 0)::BIGINT AS s FROM documents WHERE doc_id % 10 <> 1
), n AS (SELECT doc_id, doc_id::DOUBLE + CASE WHEN doc_id % 10 = 3 THEN 5 ELSE 0 END AS t, coalesce(octet_length(encode(text)), 0) + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS s, text IS NULL AS bad FROM documents WHERE doc_id % 10 <> 2
), j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN abs(o.t - n.t) < 1e-6 AND o.s = n.s THEN 'unchanged' ELSE 'changed' END AS status, coalesce(n.bad, false) AS bad FROM o FULL JOIN n ON o.doc_id = n.doc_id)"""


@query("pass_report", f"WITH {_STATES} SELECT count(*) FILTER (status IN ('added', 'changed') AND NOT bad) AS indexed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status IN ('added', 'changed') AND bad) AS failed, count(*) FILTER (status = 'unchanged' OR status IN ('added', 'changed') AND NOT bad) AS total FROM j")
def pass_report(spark, d):
    rows = src.documents(spark, d).select("doc_id", F.col("text").isNull().alias("unreadable"), F.col("doc_id").cast("double").alias("mtime"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("byte_size"))
    k = F.col("doc_id") % 10
    seen = rows.where(k != 2).withColumn("mtime", F.when(k == 3, F.col("mtime") + 5).otherwise(F.col("mtime"))).withColumn("byte_size", F.when(k == 4, F.col("byte_size") + 1).otherwise(F.col("byte_size")))
    delta = A.index_delta(rows.where(k != 1), seen, "doc_id")
    return A.pass_report(delta, seen.where("unreadable").select("doc_id"), "doc_id")


@query("content_hash", f"WITH {_M} SELECT conv_id, sha256('Claude' || chr(31) || string_agg(chr(30) || role || chr(31) || {_NORM.replace('{0}', 'body')}, '' ORDER BY turn)) AS content_hash FROM m GROUP BY conv_id")
def content_hash(spark, d):
    """The digest under the shown name of the source, as the index stores it."""
    return A.body_hashes(src.messages(spark, d), source="Claude").select("conv_id", F.col("body_hash").alias("content_hash"))


@query("tagged_documents", _TAGS + " SELECT tag, lang, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(list_distinct(tags)) AS tag FROM g) JOIN documents USING (doc_id) GROUP BY tag, lang")
def tagged_documents(spark, d):
    tags = _formed(spark, d).select("doc_id", F.explode(T.body_tags(F.col("body"))).alias("tag"))
    return tags.join(src.documents(spark, d).select("doc_id", "lang"), "doc_id").groupBy("tag", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("paths_in_order", f"WITH {_FP} SELECT fingerprint, doc_id FROM f ORDER BY fingerprint, doc_id")
def paths_in_order(spark, d):
    return _fingerprinted(spark, d).where("fingerprint <> ''").orderBy("fingerprint", "doc_id")


# -- harvests ---------------------------------------------------------------------------------------------------------
_ROLES = {"user": "user", "assistant": "assistant"}


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("body"))


@query("mapped_turns", "SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations WHERE role IN ('user', 'assistant')")
def mapped_turns(spark, d):
    return H.map_roles(_turns(spark, d), _ROLES)[0]


@query("role_warnings", "SELECT conv_id, turn, 'Turn ' || (turn + 1) || ' had an unrecognised role \"' || coalesce(role, 'none') || '\" and was skipped.' AS warning FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')")
def role_warnings(spark, d):
    return H.map_roles(_turns(spark, d), _ROLES)[1]


@query("page_adapters", "SELECT page_id, CASE WHEN h = 'blog.tionsh.example.net' OR h LIKE '%.blog.tionsh.example.net' THEN 'one' WHEN h = 'example.net' OR h LIKE '%.example.net' OR h = 'thther.example.org' OR h LIKE '%.thther.example.org' THEN 'two' END AS adapter FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages)")
def page_adapters(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return src.pages(spark, d).select("page_id", H.adapter_for(host, [("one", ["blog.tionsh.example.net"]), ("two", ["example.net", "thther.example.org"])]).alias("adapter"))


# Heading and paragraphs of an article as turns. A paragraph whose bold text is never closed holds all that follows in the article.
ARTICLE = E.Adapter("article", [], [E.Selector("h1"), E.Selector("p")], {"h1": "user", "p": "assistant"}, container=[E.Selector("article")], by_tag=True)
_PLAIN = r"""replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""
_PAGE_TURNS = r"""a AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS parts FROM pages
), t AS (SELECT page_id, parts, unnest(range(0, len(parts))) AS turn FROM a WHERE regexp_matches(parts[1], '<h1>')
), b AS (SELECT page_id, turn, CASE WHEN turn = 0 THEN regexp_extract(parts[1], '(?s)<h1>(.*)</h1>', 1) WHEN starts_with(parts[turn + 1], '<b>') THEN array_to_string(parts[turn + 1:], '') ELSE string_split(parts[turn + 1], '</p>')[1] END AS x FROM t
), page_turns AS (SELECT page_id, turn::INTEGER AS turn, CASE WHEN turn = 0 THEN 'user' ELSE 'assistant' END AS role, regexp_replace(regexp_replace(""" + _PLAIN.replace("{0}", "x") + r""", '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM b)"""


def _nodes(spark, d):
    """The elements of the pages as they are now: parsed once, by the first query of them. The name tells tables of an earlier parser apart."""
    return store.kept(spark, f"elements-3-{store.version_of(spark, f'{d}/pages.parquet')}", lambda: E.elements(src.spread(src.pages(spark, d))))


@query("page_elements", "SELECT page_id, tag, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script>'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, tag")
def page_elements(spark, d):
    return _nodes(spark, d).where("tag <> '#text' and id > 0").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("page_turns", "WITH " + _PAGE_TURNS + " SELECT * FROM page_turns")
def page_turns(spark, d):
    return E.known_turns(E.read_turns(_nodes(spark, d), ARTICLE)).select("page_id", "turn", "role", "body")


@query("page_turn_confidence", "WITH " + _PAGE_TURNS + ", g AS (SELECT page_id, count(*) AS n FROM page_turns GROUP BY page_id) SELECT pages.page_id, n IS NOT NULL AS ok, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS score, CASE WHEN n IS NULL THEN 'No messages matched. The site layout has probably changed.' ELSE 'Messages carry no stable identifier, so a long conversation may be captured with duplicates.' END AS warnings FROM pages LEFT JOIN g ON g.page_id = pages.page_id")
def page_turn_confidence(spark, d):
    told = E.turn_confidence(src.pages(spark, d), E.read_turns(_nodes(spark, d), ARTICLE))
    return told.select("page_id", "ok", "score", F.array_join("warnings", "; ").alias("warnings"))


@query("recovered_math", "WITH " + _PAGE_TURNS + " SELECT page_id, CASE page_id % 3 WHEN 0 THEN '$x_{' || page_id || '}$ ' WHEN 1 THEN '$$ x_{' || page_id || '} $$ ' ELSE '' END || body AS body FROM page_turns WHERE turn = 0")
def recovered_math(spark, d):
    """A formula before each heading: drawn beside its source, the same standing alone, and only drawn."""
    source = F.concat(F.lit('<math><mi>x</mi><annotation encoding="application/x-tex">x_{'), F.col("page_id").cast("string"), F.lit("}</annotation></math>"))
    k = F.col("page_id") % 3
    drawn = F.concat(F.lit('<span class="katex'), F.when(k == 1, "-display").otherwise(""), F.lit('"><span>'), F.when(k < 2, source).otherwise(""), F.lit('</span><span class="katex-html">x</span></span> '))
    pages = src.pages(spark, d).withColumn("html", F.replace("html", F.lit("<h1>"), F.concat(F.lit("<h1>"), drawn)))
    turns = E.known_turns(E.read_turns(store.settle(E.recover_math(store.settle(E.elements(src.spread(pages)), "elements")), "recovered"), ARTICLE))
    return turns.where("turn = 0").select("page_id", "body")


@query("link_texts", r"SELECT page_id, regexp_extract(x, '^<a href=\"([^\"]*)\"', 1) AS href, regexp_extract(x, '>(.*)</a>$', 1) AS said, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=[^>]*>[^<]*</a>')) AS x FROM pages) GROUP BY ALL")
def link_texts(spark, d):
    """Every text below a link, by the closest link."""
    nodes = _nodes(spark, d)
    links = nodes.where("tag = 'a'")
    said = E.enclosing(nodes.where("tag = '#text'"), links).where("outer is not null").groupBy("page_id", F.col("outer").alias("id")).agg(E._said().alias("said"))
    return links.select("page_id", "id", F.col("attrs")["href"].alias("href")).join(said, ["page_id", "id"]).groupBy("page_id", "href", "said").agg(F.count(F.lit(1)).alias("n"))


_SELECTED = f"""WITH {_M}, p AS (SELECT *, sum(length(body)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM m), r AS (SELECT conv_id, sum(length(body)) // 3 AS a, sum(length(body)) // 2 AS b FROM m GROUP BY conv_id
), s AS (SELECT p.conv_id, turn, role, body FROM p JOIN r ON p.conv_id = r.conv_id AND a < b AND e - length(body) <= b AND e >= a)"""


def _selected(spark, d):
    m = src.messages(spark, d)
    size = F.sum(F.length("body").cast("long"))
    return H.selected_turns(m, m.groupBy("conv_id").agg(F.floor(size / 3).alias("from"), F.floor(size / 2).alias("to")))


@query("selected_turns", _SELECTED + " SELECT conv_id, turn, role FROM s")
def selected_turns(spark, d):
    return _selected(spark, d).select("conv_id", "turn", "role")


@query("selection_confidence", _SELECTED + " SELECT conv_id, count(*)::BIGINT AS n, CASE WHEN bool_and(length(body) > 40) THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS score FROM s GROUP BY conv_id")
def selection_confidence(spark, d):
    """Turns of more than 40 characters stand for those with a key of their own."""
    return H.selection_confidence(_selected(spark, d), F.length("body") > 40)


@query("first_attachments", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE coalesce(event_type, '') <> '' GROUP BY user_id, event_type")
def first_attachments(spark, d):
    return H.first_per_name(src.events(spark, d), "user_id", "event_type", "event_id", ["value"])


@query("folders_in_order", "SELECT user_id, string_agg(event_type, ',' ORDER BY place) AS folders FROM (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def folders_in_order(spark, d):
    return H.distinct_in_order(src.events(spark, d), "user_id", "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("folders"))


@query(
    "windowed_walk",
    f"""WITH {_M}, z AS (SELECT conv_id, max(turn) + 1 AS n FROM m GROUP BY conv_id), w AS (SELECT conv_id, unnest(range(0, ceil(greatest(n - 2, 0) / 1.0)::BIGINT + 1)) AS k FROM z)
SELECT w.conv_id, count(DISTINCT k)::BIGINT AS windows, count(*)::BIGINT AS sightings, count(DISTINCT turn)::BIGINT AS turns FROM w JOIN m ON m.conv_id = w.conv_id AND turn >= k AND turn < k + 2 GROUP BY w.conv_id""",
)
def windowed_walk(spark, d):
    """Windows of two turns: the overlap of neighbouring ones sees every turn, and each counts once."""
    seen = H.windowed_walk(src.messages(spark, d), "conv_id", "turn", 2)
    return seen.groupBy("conv_id").agg(F.count_distinct("window").alias("windows"), F.count(F.lit(1)).alias("sightings"), F.count_distinct("turn").alias("turns"))


_PASSES = """p AS (SELECT user_id, row_number() OVER w AS pass, (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) // 3600000000 AS sec, CASE WHEN value >= 40 THEN 1 ELSE 0 END AS added FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "harvest_verdicts",
    f"""WITH RECURSIVE {_PASSES}, r AS (
  SELECT user_id, pass, sec, added, CASE WHEN added > 0 THEN sec ELSE 0 END AS progress, CASE WHEN added > 0 THEN 0 ELSE 1 END AS barren, CASE WHEN sec > 300 THEN 'maxTimeout' WHEN added = 0 AND sec > 15 THEN 'idleTimeout' END AS stop FROM p WHERE pass = 1
  UNION ALL
  SELECT p.user_id, p.pass, p.sec, p.added, CASE WHEN p.added > 0 THEN p.sec ELSE r.progress END, CASE WHEN p.added > 0 THEN 0 ELSE r.barren + 1 END,
    CASE WHEN p.sec > 300 THEN 'maxTimeout' WHEN p.added = 0 AND p.sec - r.progress > 15 THEN 'idleTimeout' WHEN p.added = 0 AND r.barren + 1 >= 3 THEN 'stabilised' END
  FROM r JOIN p ON p.user_id = r.user_id AND p.pass = r.pass + 1 WHERE r.stop IS NULL)
SELECT user_id, count(*)::BIGINT AS passes, sum(added)::BIGINT AS found, coalesce(max(stop), 'exhausted') AS reason, coalesce(max(stop), 'exhausted') IN ('exhausted', 'stabilised') AS complete FROM r GROUP BY user_id""",
)
def harvest_verdicts(spark, d):
    """Events of a user as passes, an hour of theirs as a second of a harvest; values from 40 on add something."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = src.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.floor((F.unix_micros("ts") - F.unix_micros(F.first("ts").over(by))) / 3_600_000_000)
    return H.verdicts(rows.select("user_id", F.row_number().over(by).alias("pass"), at.alias("at"), F.when(F.col("value") >= 40, 1).otherwise(0).alias("added")), "user_id")


# -- names, stamps and rules of Markdown ------------------------------------------------------------------------------
@query("markdown_titles", "WITH " + "f AS " + _TAGS.split("f AS ", 1)[1].split(", g AS")[0] + r""", l AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g'))), lambda x: x <> '')[1], '') AS x FROM f)
SELECT doc_id, CASE WHEN regexp_extract(x, '^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1) <> '' THEN trim(regexp_extract(x, '^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1)) ELSE x END AS title FROM l""")
def markdown_titles(spark, d):
    return _formed(spark, d).select("doc_id", M.title(F.col("body")).alias("title"))


_LISTED = """f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN t || chr(10) || '=====' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '- three' WHEN 1 THEN '## ' || t || ' ##' || chr(10) || '---' || chr(10) || '===' || chr(10) || t || chr(10) || '  --- ' WHEN 2 THEN chr(10) || '---' || chr(10) || '> ' || t ELSE t END AS body FROM (SELECT doc_id, trim(string_split(coalesce(text, ''), chr(10))[1]) AS t FROM documents))"""
_LINE_TABLE = _LISTED + r""", w AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS line_no FROM f
), o AS (SELECT *, CASE WHEN regexp_matches(line, '^[ \t\r]*$') THEN 'blank' WHEN regexp_matches(line, '^[ \t]{0,3}#{1,6}([ \t]|$)') THEN 'heading' WHEN regexp_matches(line, '^[ \t]{0,3}(=+|-+)[ \t\r]*$') THEN 'underline' WHEN regexp_matches(line, '^[ \t]*([-+*]|[0-9]{1,9}[.)])([ \t]|$)') THEN 'item' WHEN regexp_matches(line, '^[ \t]{0,3}>') THEN 'quote' WHEN regexp_matches(line, '^[ \t]{0,3}\|.*\|') THEN 'row' ELSE 'text' END AS own FROM w
), s AS (SELECT *, lag(own) OVER v AS before, lead(own) OVER v AS after, lead(line) OVER v AS below FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY line_no)
), k AS (SELECT *, CASE WHEN own = 'underline' AND coalesce(before, '') = 'text' THEN 'underline' WHEN own = 'underline' AND regexp_matches(line, '^[ \t]{0,3}-{3,}') THEN 'rule' WHEN own = 'underline' AND regexp_matches(line, '^[ \t]{0,3}-[ \t\r]*$') THEN 'item' WHEN own = 'underline' THEN 'text' WHEN own = 'text' AND coalesce(after, '') = 'underline' THEN 'title' ELSE own END AS kind FROM s)"""


def _listed(spark, d):
    k, t = F.col("doc_id") % 4, F.trim(F.split(F.coalesce("text", F.lit("")), "\n")[0])
    body = F.when(k == 0, F.concat(t, F.lit("\n=====\n- one\n- two\n\n- three"))).when(k == 1, F.concat(F.lit("## "), t, F.lit(" ##\n---\n===\n"), t, F.lit("\n  --- "))).when(k == 2, F.concat(F.lit("\n---\n> "), t)).otherwise(t)
    return src.documents(spark, d).select("doc_id", body.alias("body"))


@query("line_kinds", "WITH " + _LINE_TABLE + " SELECT doc_id, kind, count(*)::BIGINT AS n, count(*) FILTER (own = 'item' AND coalesce(before, '') = 'item') AS tight FROM k GROUP BY doc_id, kind")
def line_kinds(spark, d):
    return L.lines(_listed(spark, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tight")).alias("tight"))


@query("outlines", "WITH " + _LINE_TABLE + r""" SELECT doc_id, line_no::INTEGER AS line_no, (CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^[ \t]*(#+)', 1)) WHEN starts_with(trim(below), '=') THEN 1 ELSE 2 END)::INTEGER AS level,
  CASE WHEN kind = 'heading' THEN regexp_replace(regexp_replace(line, '^[ \t]*#+[ \t]*', ''), '[ \t]*#*[ \t\r]*$', '') ELSE regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') END AS title FROM k WHERE kind IN ('heading', 'title')""")
def outlines(spark, d):
    """Headings of documents, by marks and by underlines."""
    return L.outline(_listed(spark, d))


@query("iso_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' AS stamp FROM events")
def iso_stamps(spark, d):
    rows = src.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", M.iso_day(F.col("ts")).alias("day"), M.iso_stamp(F.col("ts")).alias("stamp"))


@query("typed_names", "WITH a AS (SELECT doc_id, " + _SAFE_SQL.replace("{0}", "trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || CASE WHEN doc_id % 3 = 1 THEN '?' ELSE ': notes.txt' END END)") + r""" AS c, lang || '.md' AS s FROM documents), b AS (SELECT doc_id, CASE WHEN c = '' THEN s ELSE c END AS c FROM a)
SELECT doc_id, CASE WHEN regexp_matches(c, '.\.([^. ]+)$') THEN c ELSE c || '.md' END AS name FROM b""")
def typed_names(spark, d):
    k = F.col("doc_id") % 3
    typed = F.when(k == 0, "").otherwise(F.concat("source", F.when(k == 1, "?").otherwise(": notes.txt")))
    return src.documents(spark, d).select("doc_id", M.typed_name(typed, F.concat("lang", F.lit(".md")), lambda c: T.safe_filename(c, None)).alias("name"))


_LINES = r"""l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '# ' || x WHEN 1 THEN (doc_id % 100) || '. ' || x WHEN 2 THEN '-' WHEN 3 THEN '+' || x ELSE '[' || x || '](a*b\c)' END AS x FROM (SELECT doc_id, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 60) AS x FROM documents))"""


@query("escaped_lines", "WITH " + _LINES + r""", e AS (SELECT doc_id, regexp_replace(x, '([\\`*\[\]<>])', '\\\1', 'g') AS inline, regexp_replace(x, '^([#>~=+-])([ \t]|$)', '\\\1\2') AS x FROM l) SELECT doc_id, inline, regexp_replace(x, '^([0-9]+)([.)])( |$)', '\1\\\2\3') AS start FROM e""")
def escaped_lines(spark, d):
    k, x = F.col("doc_id") % 5, F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 60)
    line = F.when(k == 0, F.concat(F.lit("# "), x)).when(k == 1, F.concat((F.col("doc_id") % 100).cast("string"), F.lit(". "), x)).when(k == 2, "-").when(k == 3, F.concat(F.lit("+"), x)).otherwise(F.concat(F.lit("["), x, F.lit("](a*b\\c)")))
    return src.documents(spark, d).select("doc_id", M.escape_inline(line).alias("inline"), M.escape_line_start(line).alias("start"))


@query("wrapped_math", r"WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 4 = 1 THEN coalesce(text, '') || '$' ELSE coalesce(text, '') END, '^\s+|\s+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN x = '' OR length(x) > 1000 OR contains(x, chr(10) || chr(10)) THEN NULL WHEN doc_id % 2 = 0 THEN '$$ ' || x || ' $$' WHEN NOT contains(x, '$') THEN '$' || x || '$' END AS math FROM t")
def wrapped_math(spark, d):
    k = F.col("doc_id")
    latex = F.concat(F.coalesce("text", F.lit("")), F.when(k % 4 == 1, "$").otherwise(""))
    return src.documents(spark, d).select("doc_id", M.wrapped_math(latex, k % 2 == 0).alias("math"))


@query("believed_names", r"""WITH t AS (SELECT doc_id, regexp_extract(CASE doc_id % 3 WHEN 0 THEN source || '.' || lang || ' 4 KB' WHEN 1 THEN doc_id || '.5 MB' ELSE coalesce(text, '') END, '^\s*(\S+)', 1) AS x FROM documents
), s AS (SELECT doc_id, x, regexp_extract(x, '^([^/\\?#]+)\.([A-Za-z0-9]{1,8})$', 1) AS stem FROM t) SELECT doc_id, CASE WHEN stem <> '' AND NOT regexp_matches(regexp_replace(stem, '[._-]', '', 'g'), '^[0-9]+$') THEN x END AS name FROM s""")
def believed_names(spark, d):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat("source", F.lit("."), "lang", F.lit(" 4 KB"))).when(k == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".5 MB"))).otherwise(F.coalesce("text", F.lit("")))
    return src.documents(spark, d).select("doc_id", M.believed_name(raw).alias("name"))


@query("warning_sentences", """WITH g AS (SELECT conv_id, list_distinct(list(role) FILTER (role NOT IN ('user', 'assistant'))) AS w, count(*) FILTER (coalesce(text, '') = '') AS bare FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(list_sort(w), lambda r: 'unknown role ' || r), '; ') || '.' WHEN bare > 0 THEN 'The page had not finished loading all messages when this was saved (confidence 0.70).' ELSE 'Not every message was captured.' END AS sentence FROM g""")
def warning_sentences(spark, d):
    g = _turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_set(F.when(~F.col("role").isin("user", "assistant"), F.concat(F.lit("unknown role "), "role")))).alias("w"), F.count_if(F.col("body") == "").alias("bare"))
    return g.select("conv_id", M.warning_sentence(F.col("w"), F.when(F.col("bare") > 0, 0.7).otherwise(1.0)).alias("sentence"))


# -- messages ---------------------------------------------------------------------------------------------------------
@query("plain_data_errors", "SELECT conv_id, 'conversation.turns' || repeat('[0]', 8) AS path, 'nested too deeply' AS error FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 12 >= 8")
def plain_data_errors(spark, d):
    """A message for each conversation, nested as deep as its id says."""
    ids = _turns(spark, d).select("conv_id").distinct()
    deep = F.expr("concat('{\"turns\":', repeat('[', cast(conv_id % 12 as int)), '1.5', repeat(']', cast(conv_id % 12 as int)), '}')")
    return V.plain_data_errors(ids.select("conv_id", deep.alias("message")), "conv_id")


@query(
    "decoded_conversations",
    """WITH g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, count(text)::BIGINT AS bodies, list(turn ORDER BY turn) FILTER (text IS NULL) AS bare FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a new source' ELSE 'claude' END AS source, n_turns, n_turns AS plain, least(greatest((conv_id % 4 - 1)::DOUBLE, 0), 1) AS score,
  array_to_string(list_concat(CASE WHEN conv_id % 5 = 0 THEN ['source: missing'] ELSE [] END, list_transform(coalesce(bare, []), lambda t: 'turns[' || t || '].body: missing')), '; ') AS errors FROM g""",
)
def decoded_conversations(spark, d):
    """Conversations written as JSON, some without a source, some of a source that nobody knows, with a score out of range; and read again."""
    k = F.col("conv_id")
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("role", F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("user"))
    g = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("body"))).alias("turns"))
    source = F.when(k % 5 == 1, "a new source").when(k % 5 > 1, "claude")
    confidence = F.struct((k % 4 - 1).cast("double").alias("score"), F.lit(True).alias("complete"), F.lit("dom").alias("strategy"))
    read = V.decode_conversations(g.select("conv_id", F.to_json(F.struct(source.alias("source"), "turns", confidence.alias("confidence"))).alias("message")))
    c = F.col("conversation")
    plain = F.size(F.filter(c["turns"], lambda t: (t["format"] == "markdown") & (F.size(t["toolCalls"]) == 0) & (F.size(t["attachments"]) == 0))).cast("long")
    return read.select("conv_id", c["source"].alias("source"), F.size(c["turns"]).cast("long").alias("n_turns"), plain.alias("plain"), c["confidence"]["score"].alias("score"), F.array_join("errors", "; ").alias("errors"))


@query(
    "applied_decisions",
    f"""WITH {_VERSIONS}, h AS (SELECT conv_id, sha256('web' || chr(31) || string_agg(chr(30) || role || chr(31) || b, '' ORDER BY turn)) AS body_hash FROM i WHERE b <> '' GROUP BY conv_id
), a AS (SELECT ia.conv_id, CASE WHEN ea.x IS NULL THEN 'write_new' WHEN ia.conv_id % 11 = 0 THEN 'write_alongside' WHEN ia.x = ea.x THEN 'unchanged' WHEN len(ia.x) > len(ea.x) AND ia.x[1:len(ea.x)] = ea.x THEN 'append' ELSE 'write_alongside' END AS action FROM ia LEFT JOIN ea USING (conv_id))
SELECT conv_id, action, CASE WHEN action <> 'unchanged' THEN body_hash END AS body_hash FROM a LEFT JOIN h USING (conv_id)""",
)
def applied_decisions(spark, d):
    """What each decision writes, read back from the document: the whole conversation anew, or nothing where it is unchanged."""
    existing, incoming = _versions(spark, d)
    told = R.applied(existing, incoming, "Claude", "2024-01-01")
    read = A.body_hashes(R.split_turns(told.where("document is not null"))).select("conv_id", "body_hash")
    return told.select("conv_id", "action").join(read, "conv_id", "left")


@query(
    "resolved_destinations",
    """WITH p AS (SELECT min(doc_id) AS place, lang AS name, '/notes/' || lang AS path, CASE lang WHEN 'en' THEN 'daily' WHEN 'fr' THEN 'append' ELSE 'else' END AS behaviour FROM documents GROUP BY lang
), r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'unknown' END AS preset, CASE WHEN doc_id % 6 = 5 THEN '/own/' || source END AS destination FROM documents
), f AS (SELECT doc_id, CASE WHEN destination IS NOT NULL THEN destination ELSE coalesce(a.path, o.path) END AS folder, CASE WHEN destination IS NOT NULL THEN 'separate' ELSE replace(coalesce(a.behaviour, o.behaviour), 'else', 'separate') END AS behaviour FROM r LEFT JOIN p a ON a.name = r.preset, (SELECT path, behaviour FROM p ORDER BY place LIMIT 1) o)
SELECT doc_id, folder, behaviour, CASE WHEN folder = '/notes/de' OR starts_with(folder, '/own/') AND folder <> '/own/src0' THEN 'unwritable' END AS error FROM f""",
)
def resolved_destinations(spark, d):
    """Requests with a preset, an unknown one, none, or a path; one preset's folder can't be written, and of the paths only one is there."""
    docs = src.documents(spark, d)
    presets = docs.groupBy(F.col("lang").alias("name")).agg(F.min("doc_id").alias("place")).select("place", "name", F.concat(F.lit("/notes/"), "name").alias("path"), F.when(F.col("name") == "en", "daily").when(F.col("name") == "fr", "append").otherwise("else").alias("behaviour"))
    k = F.col("doc_id")
    requests = docs.select("doc_id", F.when(k % 3 == 0, F.col("lang")).when(k % 3 == 1, "unknown").alias("preset"), F.when(k % 6 == 5, F.concat(F.lit("/own/"), "source")).alias("destination"))
    there = presets.select(F.col("path").alias("folder"), F.lit(True).alias("is_directory"), (F.col("name") != "de").alias("writable")).unionByName(docs.where("source = 'src0'").select(F.lit("/own/src0").alias("folder"), F.lit(True).alias("is_directory"), F.lit(True).alias("writable")).distinct())
    return V.check_destinations(V.resolve_presets(requests, presets, "/default"), there).select("doc_id", "folder", "behaviour", "error")


@query("stripped_notes", "SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN 'Mine.' || chr(10) || '<!-- section:' || (user_id + 1) || ' -->' || chr(10) || '## other' || chr(10) || chr(10) || max(event_type) || chr(10) || '<!-- /section -->' || chr(10) || chr(10) || 'End.' END AS note FROM events GROUP BY user_id")
def stripped_notes(spark, d):
    """A note of each user with a section of theirs, but for each third, and one of another: the own one goes."""
    u = src.events(spark, d).groupBy("user_id").agg(F.max("event_type").alias("title"))
    own = F.when(F.col("user_id") % 3 != 0, R.section(F.col("user_id"), F.col("title"), F.lit("text"))).otherwise("")
    note = F.concat(F.lit("Mine.\n"), R.section(F.col("user_id") + 1, F.lit("other"), F.col("title")), F.lit("\n"), own, F.lit("\nEnd."))
    return R.strip_sections(u.select("user_id", note.alias("note")), u.select("user_id", F.col("user_id").alias("key")), "user_id")


@query("fallback_names", "SELECT event_id, 'clipboard_save_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') AS name FROM events")
def fallback_names(spark, d):
    return src.events(spark, d).select("event_id", M.fallback_name(F.col("ts").cast("timestamp")).alias("name"))


# -- files ------------------------------------------------------------------------------------------------------------
@query("fanned_out", "WITH x AS (SELECT doc_id, lang || '.md' AS name, unnest(['first', 'second', 'third']) AS folder FROM documents) SELECT doc_id, folder, CASE WHEN folder = 'first' OR r = 1 THEN name ELSE replace(name, '.md', '') || ' (' || r || ').md' END AS final FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) + CASE WHEN folder = 'third' AND name IN (SELECT DISTINCT lang || '.md' FROM documents WHERE doc_id % 2 = 0) THEN 1 ELSE 0 END AS r FROM x)")
def fanned_out(spark, d):
    """Each document to three folders; the third holds some of the names already."""
    docs = src.documents(spark, d)
    taken = docs.where(F.col("doc_id") % 2 == 0).select(F.lit("third").alias("folder"), F.concat("lang", F.lit(".md")).alias("name")).distinct()
    return V.fan_out(docs.select("doc_id", F.concat("lang", F.lit(".md")).alias("name")), ["first", "second", "third"], taken, "doc_id").select("doc_id", "folder", "final")


# Some bodies begin like the decoration of a turn.
_TURN = f"""r AS (SELECT *, {_NORM.replace('{0}', "CASE WHEN conv_id % 7 = 0 THEN 'Attachments:' || chr(10) || chr(10) || '- `x`' || chr(10) || body WHEN conv_id % 7 = 1 THEN '<!-- reasoning -->' || chr(10) || body ELSE body END")} AS b FROM m), k AS (SELECT *, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN {_NORM.replace('{0}', 'substr(b, 1, 30)')} ELSE '' END AS why,
  CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'q' || turn END AS asked, CASE WHEN conv_id % 5 = 0 THEN 'file ' || turn || '.pdf' END AS file FROM r WHERE regexp_replace(body, '\\s+', '', 'g') <> '')"""


@query(
    "decorated_round_trip",
    f"""WITH {_M}, {_TURN} SELECT conv_id, count(*)::BIGINT AS n_turns, sha256('web' || chr(31) || string_agg(chr(30) || role || chr(31) || b || CASE WHEN why <> '' THEN chr(31) || 'reasoning:' || why ELSE '' END || CASE WHEN asked IS NOT NULL THEN chr(31) || 'tool:search:' || asked ELSE '' END, '' ORDER BY turn)) AS digest,
  coalesce(string_agg(file || ' ' || (100 * turn + 7), ', ' ORDER BY turn), '') AS files FROM k GROUP BY conv_id""",
)
def decorated_round_trip(spark, d):
    """Turns with reasoning, tool calls and attachments, written as documents and read back from these alone."""
    m = src.messages(spark, d).where(T.is_populated(F.col("body")))
    like = F.when(F.col("conv_id") % 7 == 0, "Attachments:\n\n- `x`\n").when(F.col("conv_id") % 7 == 1, "<!-- reasoning -->\n").otherwise("")
    m = m.withColumn("body", F.regexp_replace(F.concat(like, "body"), r"^\s+|\s+$", ""))
    k, none = F.col("conv_id"), F.array()
    why = F.when((F.col("role") == "assistant") & (k % 2 == 0), T.normalise(F.substring(T.normalise(F.col("body")), 1, 30)))
    call = F.struct(F.lit("search").alias("name"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("input"), F.substring("body", 1, 10).alias("output"))
    calls = F.when((F.col("role") == "user") & (k % 3 == 0), F.array(call)).otherwise(none.cast("array<struct<name:string,input:string,output:string>>"))
    file = F.struct(F.concat(F.lit("file "), F.col("turn").cast("string"), F.lit(".pdf")).alias("name"), F.lit("document").alias("kind"), (F.col("turn") * 100 + 7).cast("long").alias("byteSize"), F.lit(None).cast("string").alias("url"))
    files = F.when(k % 5 == 0, F.array(file)).otherwise(none.cast("array<struct<name:string,kind:string,byteSize:bigint,url:string>>"))
    turn = F.struct("role", "body", why.alias("reasoning"), calls.alias("toolCalls"), files.alias("attachments"))
    heading = F.create_map(*(F.lit(x) for kv in R.HEADINGS.items() for x in kv))
    written = m.select("conv_id", "turn", F.concat(heading[F.col("role")], F.lit("\n\n"), R.render_turn(turn)).alias("x"))
    written = written.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda t: t["x"]), "\n\n").alias("document"))
    read = R.split_turns(written).withColumn("t", R.decode_turn(F.col("body"))).select("conv_id", "turn", "role", "t.*")
    told = read.withColumn("x", T.canonical_turn(F.col("role"), F.col("body"), F.col("reasoning"), F.col("toolCalls")))
    told = told.withColumn("f", F.array_join(F.transform("attachments", lambda a: F.concat(a["name"], F.lit(" "), a["byteSize"].cast("string"))), ", "))
    g = told.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "x", "f"))).alias("t"))
    digest = T.digest(F.concat(F.lit("web\x1f"), F.array_join(F.transform("t", lambda t: t["x"]), "")))
    return g.select("conv_id", "n_turns", digest.alias("digest"), F.array_join(F.filter(F.transform("t", lambda t: t["f"]), lambda f: f != ""), ", ").alias("files"))


@query(
    "note_upserts",
    """WITH u AS (SELECT user_id, max(event_type) AS title, max(value)::VARCHAR AS v FROM events GROUP BY user_id
), n AS (SELECT user_id, title, 'read ' || v || chr(10) || 'and more' AS body, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN user_id WHEN 2 THEN user_id ELSE user_id + 1000000 END AS old_key, CASE user_id % 5 WHEN 1 THEN 'something else' WHEN 4 THEN 'unlike' ELSE 'read ' || v END AS old FROM u
), s AS (SELECT *, '<!-- section:' || user_id || ' -->' || chr(10) || '## ' || title || chr(10) || chr(10) || body || chr(10) || '<!-- /section -->' AS new, 'Mine.' || chr(10) || chr(10) AS head,
  '<!-- section:' || old_key || ' -->' || chr(10) || '## ' || title || chr(10) || chr(10) || CASE WHEN user_id % 5 = 2 THEN '<sub>noon</sub>' || chr(10) || chr(10) || body ELSE old END || chr(10) || '<!-- /section -->' AS held, chr(10) || 'My own end.' AS tail FROM n)
SELECT user_id, CASE user_id % 5 WHEN 1 THEN 'replace' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'replace' ELSE 'insert' END AS action,
  CASE user_id % 5 WHEN 0 THEN '# ' || user_id || chr(10) || chr(10) || new || chr(10) WHEN 1 THEN head || new || tail WHEN 2 THEN head || held || tail WHEN 3 THEN head || new || tail ELSE head || held || tail || chr(10) || chr(10) || new || chr(10) END AS note FROM s""",
)
def note_upserts(spark, d):
    """A note of each user with text of their own: none yet, a section to change, one that differs by its time, one that has grown, one that only has the same heading."""
    u = src.events(spark, d).groupBy("user_id").agg(F.max("event_type").alias("title"), F.max("value").cast("string").alias("v"))
    k, body = F.col("user_id") % 5, F.concat(F.lit("read "), "v", F.lit("\nand more"))
    old = F.when(k == 1, "something else").when(k == 2, F.concat(F.lit("<sub>noon</sub>\n\n"), body)).when(k == 4, "unlike").otherwise(F.concat(F.lit("read "), "v"))
    key = F.when(k.isin(1, 2), F.col("user_id")).otherwise(F.col("user_id") + 1_000_000)
    notes = u.where(k != 0).select("user_id", F.concat(F.lit("Mine.\n\n"), R.section(key, F.col("title"), old), F.lit("\nMy own end.")).alias("note"))
    told = R.upsert_sections(notes, u.select("user_id", F.col("user_id").alias("key"), "title", body.alias("body")), "user_id")
    return told.select("user_id", F.col("actions")[0].alias("action"), "note")


@query(
    "note_with_sections",
    """WITH u AS (SELECT user_id // 10 AS day, user_id AS key, max(event_type) AS title, max(value)::VARCHAR AS v FROM events GROUP BY user_id), f AS (SELECT day, min(key) AS first FROM u GROUP BY day
), s AS (SELECT u.*, key = first AS held, '<!-- section:' || key || ' -->' || chr(10) || '## ' || key || ' ' || title || chr(10) || chr(10) || 'read ' || v || chr(10) || '<!-- /section -->' AS x FROM u JOIN f USING (day))
SELECT day, string_agg(CASE WHEN held THEN 'replace' ELSE 'insert' END, ',' ORDER BY key) AS actions, 'Mine.' || chr(10) || chr(10) || string_agg(CASE WHEN held THEN x || chr(10) || 'My own end.' ELSE x END, chr(10) || chr(10) ORDER BY key) || CASE WHEN count(*) > 1 THEN chr(10) ELSE '' END AS note FROM s GROUP BY day""",
)
def note_with_sections(spark, d):
    """Sections of several users in one note: the first is there already and has changed, the others are put behind it."""
    u = src.events(spark, d).groupBy("user_id").agg(F.max("event_type").alias("title"), F.max("value").cast("string").alias("v"))
    u = u.select(F.floor(F.col("user_id") / 10).alias("day"), F.col("user_id").alias("key"), F.concat(F.col("user_id").cast("string"), F.lit(" "), "title").alias("title"), F.concat(F.lit("read "), "v").alias("body"))
    held = u.groupBy("day").agg(F.min_by(F.struct("key", "title"), "key").alias("h"))
    notes = held.select("day", F.concat(F.lit("Mine.\n\n"), R.section(F.col("h.key"), F.col("h.title"), F.lit("other")), F.lit("\nMy own end.")).alias("note"))
    return R.upsert_sections(notes, u, "day").withColumn("actions", F.array_join("actions", ","))


@query("fts_prefix", _bm25_sql(["@"]).replace("list_filter(ws, lambda x: x = '@')", "list_filter(ws, lambda x: starts_with(x, 'ti'))"))
def fts_prefix(spark, d):
    return _hits(spark, d, "ti*", prefix=True).withColumn("score", F.round("score", 9))


@query(
    "document_metadata",
    _TITLE + """, g AS (SELECT conv_id, count(*) AS n, list_sort(list_distinct(list('unknown role: ' || role) FILTER (role NOT IN ('user', 'assistant')))) AS w, bool_and(coalesce(text, '') <> '') AS ok FROM conversations GROUP BY conv_id)
SELECT g.conv_id, nullif(t.title, '') AS title, 'ChatGPT' AS platform, CASE WHEN conv_id % 2 = 0 THEN 'm: ' || conv_id END AS model, 'https://example.org/a%20b/' || conv_id AS url, '2024-01-01' AS day, n::INTEGER AS turns,
  CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS extraction, NOT ok AS incomplete, array_to_string(coalesce(w, []), '; ') AS warnings FROM g LEFT JOIN t USING (conv_id)""",
)
def document_metadata(spark, d):
    """Frontmatter of every field, written and read back."""
    g = _turns(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(~F.col("role").isin("user", "assistant"), F.concat(F.lit("unknown role: "), "role")))).alias("w"), F.min(F.col("body") != "").alias("ok"))
    g = g.join(_titles(spark, d), "conv_id", "left").withColumn("title", F.coalesce("title", F.lit("")))
    c = F.col("conv_id").cast("string")
    fields = R.all_fields(F.col("title"), "2024-01-01", F.lit("ChatGPT"), F.col("n"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("m: "), c)), F.concat(F.lit("https://example.org/a b/"), c), F.when(F.col("ok"), 1.0).otherwise(0.7), F.col("ok"))
    told = R.metadata(g.select("conv_id", R.frontmatter(fields, F.col("w")).alias("document")), "conv_id")
    return told.withColumn("warnings", F.array_join("warnings", "; "))


@query(
    "saved_files",
    _TITLE + ", n AS (SELECT conv_id, CASE WHEN length(x) <= 80 THEN x WHEN regexp_matches(substr(x, 1, 80), '^.+ ') THEN regexp_replace(substr(x, 1, 80), ' [^ ]*$', '') ELSE substr(x, 1, 80) END AS s FROM (SELECT conv_id, " + _SAFE_SQL.replace("{0}", "title") + """ AS x FROM t)
), """ + _READ_BACK + """, f AS (SELECT conv_id, n_turns, body_hash, CASE WHEN coalesce(s, '') = '' THEN '2024-01-01' ELSE s END AS s FROM h LEFT JOIN n USING (conv_id)
), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY conv_id) AS k FROM f) SELECT conv_id, s || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.md' AS final, n_turns, body_hash, true AS intact FROM r""",
)
def saved_files(spark, d):
    """One Markdown file for each conversation: its free name, and what is read back from its content."""
    documents = R.render(src.messages(spark, d), "Claude", "2024-01-01").withColumn("folder", F.lit("archive"))
    named = documents.withColumn("name", V.file_name(F.col("title"), F.lit("2024-01-01"), F.lit("separate")))
    taken = named.select("folder", "name").limit(0)
    return V.free_names(named, taken, "conv_id").select("conv_id", "final").join(R.intact(documents), "conv_id")
