"""Ranked full-text search at the grain of messages, from postings made by DataFrame operations."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import porter_stem, stem

K1, B = 1.2, 0.75
#: Words with a wanted stem that are looked up by a literal; more are joined.
MOST_WORDS = 1000
WORD = r"[\p{L}\p{N}\p{Co}]+"
_TOKEN = r"[^\W_]+"


def _accented() -> dict[str, str]:
    """Small Latin letters that Unicode takes apart into a letter and marks, and that letter."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and all(unicodedata.combining(m) for m in marks):
            found[c] = first
    return found


_ACCENTED = _accented()


def fold(text: Column) -> Column:
    """Case-folded and without the accents of Latin letters, whether they are part of the letter or marks behind it."""
    plain = F.translate(F.lower(text), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.regexp_replace(plain, r"\p{M}", "")


def folded(text: str) -> str:
    """The same of one text."""
    return "".join(_ACCENTED.get(c, c) for c in text.lower() if not unicodedata.category(c).startswith("M"))


def query_phrases(query: str) -> list[list[str]]:
    """Pieces between blanks, quotes dropped; each is a phrase of its words, and all must match. A star has no effect."""
    pieces = [re.findall(r"[^\W_]+", folded(p)) for p in query.replace('"', " ").split()]
    if not pieces:
        raise ValueError("Enter something to search for.")
    return [p for p in pieces if p]


def postings(messages: DataFrame, keys: list[str], stemmed: bool = False, only: list[str] | None = None) -> DataFrame:
    """(keys, term, tf, positions, dl): one row for each word of each message, or for those in ``only``."""
    if stemmed and only is not None:
        # Words of the corpus that have a wanted stem: few, so the others go before anything is shuffled; a join otherwise.
        vocabulary = messages.select(F.explode(F.regexp_extract_all(fold(F.col("body")), F.lit(WORD), 0)).alias("term")).distinct().withColumn("stem", porter_stem("term")).where(F.col("stem").isin(only))
        found = vocabulary.limit(MOST_WORDS + 1).collect()
        if len(found) <= MOST_WORDS:
            stems = F.create_map(*(F.lit(x) for r in found for x in r)) if found else F.lit(None).cast("map<string,string>")
            term = F.posexplode(F.regexp_extract_all(fold(F.col("body")), F.lit(WORD), 0)).alias("pos", "term")
            words = messages.select(*keys, term, F.size(F.regexp_extract_all("body", F.lit(WORD), 0)).alias("dl")).where(F.col("term").isin([r["term"] for r in found])).withColumn("term", stems[F.col("term")])
            return words.groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    words = messages.select(*keys, F.posexplode(F.regexp_extract_all(fold(F.col("body")), F.lit(WORD), 0)).alias("pos", "term"), F.size(F.regexp_extract_all("body", F.lit(WORD), 0)).alias("dl"))
    if stemmed:
        stems = words.select("term").distinct().withColumn("stem", porter_stem("term"))
        if only is not None:
            stems = stems.where(F.col("stem").isin(only))
        words = words.join(stems, "term").drop("term").withColumnRenamed("stem", "term")
    return words.groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def bm25(messages: DataFrame, query: str, keys: list[str], stemmed: bool = False, prefix: bool = False) -> DataFrame:
    """(keys, score) of messages that have every phrase; lower is better. Statistics are one row, whatever the corpus holds."""
    phrases = query_phrases(query)
    index = postings(messages, keys, stemmed, None if prefix or not stemmed else sorted({stem(w) for p in phrases for w in p}))
    size = messages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.regexp_extract_all("body", F.lit(WORD), 0))).alias("avgdl"))
    return score_phrases(index, size, query, keys, stemmed, prefix)


def score_phrases(index: DataFrame, size: DataFrame, query: str, keys: list[str], stemmed: bool = False, prefix: bool = False) -> DataFrame:
    """(keys, score) from postings index(keys, dl, term, positions) of all words of the query and one row size(n, avgdl)."""
    pieces = [p for p in query.replace('"', " ").split() if re.search(r"[^\W_]", p)]
    phrases = query_phrases(query)
    out: DataFrame | None = None
    for k, phrase in enumerate(phrases):
        words = [stem(w) if stemmed else w for w in phrase]
        met: DataFrame | None = None
        for j, w in enumerate(words):
            last = prefix and j + 1 == len(words) and pieces[k].endswith("*")
            here = index.where(F.col("term").startswith(w) if last else F.col("term") == w)
            here = here.groupBy(*keys, "dl").agg(F.flatten(F.collect_list(F.transform("positions", lambda p: p - j))).alias("at"))
            met = here if met is None else met.join(here.select(*keys, F.col("at").alias("and")), keys).withColumn("at", F.array_intersect("at", "and")).drop("and")
        hits = met.select(*keys, "dl", F.size("at").alias("tf")).where("tf > 0")
        df = hits.agg(F.count(F.lit(1)).alias("df"))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        part = hits.crossJoin(F.broadcast(df.crossJoin(size))).select(*keys, (-gain).alias("score"))  # one row of statistics
        out = part if out is None else out.join(part.withColumnRenamed("score", "more"), keys).select(*keys, (F.col("score") + F.col("more")).alias("score"))
    return index.select(*keys, F.lit(0.0).alias("score")).limit(0) if out is None else out


def top(hits: DataFrame, keys: list[str], limit: int = 50) -> DataFrame:
    return hits.orderBy("score", *keys).limit(limit)


def with_documents(hits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Hits with the columns of their document, of which there is one row a key. The hits, at most a search's limit, are the broadcast side."""
    return documents.join(F.broadcast(hits), key)


def snippet(query: str, width: int = 14):
    """A function of text: up to ``width`` words around the first match, in << >>, with … where it is cut."""
    wanted = {stem(w) for p in query_phrases(query) for w in p}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            found = [(m.start(), m.end(), stem(folded(m[0])) in wanted) for m in re.finditer(_TOKEN, text or "")]
            if not found:
                return text
            hit = next((k for k, f in enumerate(found) if f[2]), 0)
            a = max(0, min(hit - (width - 1) // 2, len(found) - width))
            cut = found[a : a + width]
            out, at = "" if a == 0 else "…", 0 if a == 0 else cut[0][0]
            for s, e, is_hit in cut:
                out += text[at:s] + (f"<<{text[s:e]}>>" if is_hit else text[s:e])
                at = e
            return out + (text[at:] if a + width >= len(found) else "…")

        return texts.map(one)

    return run


def report(hits: DataFrame, query: str, name: str, shown: int = 10, counts: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """The hits (name, role, turn, snippet, score) as one Markdown text; their number is bounded by the search's limit.

    counts(documents, messages) is one row for the footer; folder is named where nothing matches.
    """
    rows = hits.select(F.struct("score", name, "turn").alias("o"), "*")
    all_rows = F.array_sort(F.collect_list(F.struct("o", F.col(name), "role", "turn", "snippet")))
    g = rows.agg(all_rows.alias("h"))
    lines = F.transform(F.slice("h", 1, shown), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". `"), x[name].cast("string"), F.lit("` — "), x["role"], F.lit(", turn "), (x["turn"] + 1).cast("string"), F.lit("\n   "), F.replace(F.replace(x["snippet"], F.lit("<<"), F.lit("**")), F.lit(">>"), F.lit("**"))))
    n = F.size("h")
    head = F.concat(F.lit("**"), n.cast("string"), F.lit("** match"), F.when(n == 1, "").otherwise("es"), F.lit(f" for *{query}*\n\n"))
    tail = F.when(n > shown, F.concat(F.lit("\n_"), (n - shown).cast("string"), F.lit(" more not shown._\n"))).otherwise("")
    none = f"No archived messages match **{query}**." + (f"\n\nIndexed folder: `{folder}`" if folder else "")
    foot = F.lit("")
    if counts is not None:
        g = g.crossJoin(F.broadcast(counts.select("documents", "messages")))  # one row each
        foot = F.concat(F.lit("\n"), F.col("messages").cast("string"), F.lit(" messages across "), F.col("documents").cast("string"), F.lit(" documents indexed."))
    return g.select(F.when(n == 0, F.lit(none)).otherwise(F.concat(head, F.array_join(lines, "\n"), F.lit("\n"), tail, foot)).alias("report"))

