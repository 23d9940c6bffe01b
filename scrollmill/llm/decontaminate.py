"""Benchmark decontamination with an FM-index for each shard of the training documents.

A task reads whole documents into a shard, up to ``SHARD_WORDS`` indexed words. The index holds the words of
the benchmark's vocabulary in runs that are long enough for a test phrase, with a separator between runs: an
occurrence of a phrase is always inside such a run, so nothing is lost, and the index follows what could
match. It is a suffix array's Burrows-Wheeler transform in a wavelet tree with rank tables. All phrases are
searched backwards at once; their occurrences are located by walking to sampled suffix positions and merged
into removal spans.

The benchmark is a set of queries: it goes to the executors in blocks of about ``BLOCK_BYTES`` of text, one block at a
time. With one block no document leaves its task, so nothing is shuffled and a hot document or passage costs its own
length. With more, each block is a pass over the documents that writes what it has found, and what several passes have
found in one document is merged in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import discard, settle, small_batches, tidy

SHARD_WORDS = 2_000_000
BLOCK_BYTES = 32 << 20
SAMPLE = 8


class WaveletTree:
    """Rank and access of symbols, one bit a level; zeros of a level stand before its ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (now >> k) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[i].astype(np.int64)
            i = np.where((c >> (self.bits - 1 - k)) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[.] before position i[.]."""
        return self._down(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i and their rank there."""
        c = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[i].astype(np.int64)
            bit = ones[i + 1] - up
            c = c * 2 + bit
            i = np.where(bit == 1, zeros + up, i - up)
        return c, i - self.first[c]


class FMIndex:
    """Of a sequence of symbols in which 0 separates runs. Sequences begin with a separator."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        breaks = text == 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()))  # each separator differs, so no comparison crosses one
        k = 1
        while True:
            after = np.full(n, 0, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2 if n else 1) + after
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], key[order][1:] != key[order][:-1]]) if n else np.zeros(0)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            k *= 2
            if not n or rank[order[-1]] == n - 1 or k > 2 * n:
                break
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt.astype(np.int64), sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        # The first word of each run is sampled as well, so a walk never passes a separator.
        kept = (order % SAMPLE == 0) | breaks | (bwt == 0)
        self.kept = np.where(kept, order, -1)
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: rows of equally many symbols, none 0. Row numbers of those that occur, and their suffix ranges."""
        row = np.arange(len(phrases))
        lo, hi = np.zeros(len(row), np.int64), np.full(len(row), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[row, j]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            alive = lo < hi
            row, lo, hi = row[alive], lo[alive], hi[alive]
        return row, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, walked, open_ = np.empty(len(at), np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(open_):
            found = self.kept[at]
            done = found >= 0
            out[open_[done]] = found[done] + walked
            open_, at = open_[~done], at[~done]
            c, rank = self.tree.access(at)
            at = self.before[c] + rank
            walked += 1
        return out


class Phrases:
    """The test phrases of a block of the benchmark, by length, over the vocabulary of their words."""

    def __init__(self, items: pa.Table, width: int):
        lists, ids = [], []
        for chunk in T.chunks(items.column("text")):
            w = T.words(chunk, T.ALNUM)
            for r in range(chunk.rows):
                if w.at[r + 1] > w.at[r]:
                    lists.append(w.hash[w.at[r] : w.at[r + 1]])
                    ids.append(items.column("item_id")[chunk.first + r].as_py())
        self.vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        self.names = sorted({str(i) for i in ids})
        number = {n: k for k, n in enumerate(self.names)}
        found: dict[int, dict[bytes, list[int]]] = {}
        for x, i in zip(lists, ids, strict=True):
            s = np.searchsorted(self.vocabulary, x).astype(np.int64) + 1
            m = min(width, len(s))
            for p in np.lib.stride_tricks.sliding_window_view(s, m):
                found.setdefault(m, {}).setdefault(p.tobytes(), []).append(number[str(i)])
        self.by_length = []
        for m, these in sorted(found.items()):
            rows = np.frombuffer(b"".join(these), np.int64).reshape(-1, m)
            owners = [np.unique(x) for x in these.values()]
            known = np.zeros(len(self.vocabulary) + 1, bool)
            known[rows.ravel()] = True
            self.by_length.append((m, rows, np.concatenate([[0], np.cumsum([len(x) for x in owners])]), np.concatenate(owners), known))
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words from 1, 0 for a word that no phrase has."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.gate[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def long_enough(self, symbols: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which words stand in a run, inside one text, that a phrase of some length could fill."""
        keep = np.zeros(len(symbols), bool)
        for m, _, _, _, known in self.by_length:
            inside = known[symbols]
            cut = np.zeros(len(symbols) + 1, bool)
            cut[1:-1] = inside[1:] != inside[:-1]
            cut[edges] = True
            cut[0] = cut[-1] = True
            at = np.flatnonzero(cut)
            size = np.diff(at)
            keep |= np.repeat(inside[at[:-1]] & (size >= m), size)
        return keep


class _Shard:
    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.size = phrases, [], 0
        self.parts: list[tuple] = []

    def add(self, chunk: T.Chunk, ids: pa.Array) -> None:
        w = T.words(chunk, T.ALNUM)
        base = len(self.docs)
        self.docs.extend(zip(ids.slice(chunk.first, chunk.rows).to_pylist(), np.diff(w.at).tolist(), strict=True))
        if not len(w.hash):
            return
        doc = np.repeat(np.arange(chunk.rows), np.diff(w.at))
        symbols = self.phrases.symbols(w.hash)
        kept = np.flatnonzero(self.phrases.long_enough(symbols, w.at))
        if len(kept):
            start = chunk.at[doc[kept]]
            self.parts.append((symbols[kept], doc[kept] + base, kept - w.at[doc[kept]], w.start[kept] - start, w.end[kept] - start))
            self.size += len(kept)

    def results(self) -> Iterator[tuple]:
        """(id, n_words, item names, spans) of each document, in order; a span is the numbers of its first word and of the one behind it, and its bytes."""
        hits: dict[int, dict[int, tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.parts:
            self._look(self.phrases, [np.concatenate(x) for x in zip(*self.parts, strict=True)], hits, items)
        for k, (doc_id, n_words) in enumerate(self.docs):
            yield doc_id, n_words, items.get(k, set()), _joined([(number, number + 1, a, b) for number, (a, b) in hits.get(k, {}).items()])

    @staticmethod
    def _look(p: Phrases, parts: list[np.ndarray], hits: dict, items: dict) -> None:
        symbols, doc, number, start, end = parts
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1] + 1)
        place = np.arange(len(doc)) + np.cumsum(new)  # one separator before each run
        text = np.zeros(len(doc) + int(new.sum()), np.int64)
        text[place] = symbols
        back = np.full(len(text), -1, np.int64)
        back[place] = np.arange(len(doc))
        index = FMIndex(text, len(p.vocabulary) + 1)
        covered = np.zeros(len(text) + 1, np.int64)
        for m, rows, owner_at, owners, _ in p.by_length:
            row, lo, hi = index.search(rows)
            if not len(row):
                continue
            which = np.repeat(row, hi - lo)
            suffix = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
            at = index.locate(suffix)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + m, -1)
            met = np.unique(doc[back[at]].astype(np.int64) * len(rows) + which)
            for d, r in zip((met // len(rows)).tolist(), (met % len(rows)).tolist(), strict=True):
                items.setdefault(d, set()).update(p.names[x] for x in owners[owner_at[r] : owner_at[r + 1]])
        hit = back[np.flatnonzero(np.cumsum(covered)[:-1] > 0)]
        for d, k, a, b in zip(doc[hit].tolist(), number[hit].tolist(), start[hit].tolist(), end[hit].tolist(), strict=True):
            hits.setdefault(d, {})[k] = (a, b)


def _joined(spans: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Spans (first, behind, start, end) that overlap or touch by words are one."""
    out: list[list[int]] = []
    for first, behind, a, b in sorted(spans):
        if out and first <= out[-1][1]:
            if behind > out[-1][1]:
                out[-1][1], out[-1][3] = behind, b
        else:
            out.append([first, behind, a, b])
    return out


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _told(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``OUT`` from (doc_id, n_words, item names, spans)."""
    for at in range(0, len(found), 20_000):
        rows = []
        for d, n, items, spans in found[at : at + 20_000]:
            names, h = sorted(items), sum(s[1] - s[0] for s in spans)
            rows.append((d, n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0 and 20 * h >= n, [{"start": s[2], "end": s[3]} for s in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


_PASS = "row long, n_words long, items array<string>, spans array<array<long>>"


def _of_pass(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PASS``: documents with hits."""
    rows = [(d, n, sorted(items), spans) for d, n, items, spans in found if spans]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "n_words", "items", "spans"])


def _search(shared, width: int, key: str, tell):
    """A pass over (key, text) for one block of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, width)
        shard = _Shard(phrases)
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                shard.add(chunk, batch.column(key))
                if shard.size >= SHARD_WORDS or len(shard.docs) >= 200_000:
                    yield from tell(list(shard.results()))
                    shard = _Shard(phrases)
        if shard.docs:
            yield from tell(list(shard.results()))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passes = batch.column("spans").to_pylist()
        spans = [_joined([tuple(s) for one in p or () for s in one]) for p in passes]
        yield from _told([(d, n, {x for one in i or () for x in one}, s) for d, n, i, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "items")), spans, strict=True)])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.diff(T.words(chunk, T.ALNUM).at) for chunk in T.chunks(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["row", "doc_id", "n_words"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """One row of ``OUT`` for every row of ``docs(doc_id, text, ...)`` against ``benchmark(item_id, text, ...)``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A phrase is ``width`` consecutive words of
    an item, or all of a shorter one. Words inside any occurrence are hit; spans are the UTF-8 byte ranges of
    consecutive hit words. contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    Null, empty and wordless texts have no words and are clean. Items with a null id or text or without words are
    no items; rows with the same item_id are one item with all their phrases. Repeated documents and null doc_ids
    give a row each. Other columns are left out. Empty tables: no rows, or no hits.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = int(-(-total // BLOCK_BYTES)) or 1
    if n == 1:
        return docs.mapInArrow(tidy(_search(context.broadcast(items.toArrow()), width, "doc_id", _told)), OUT)

    keyed = settle(docs.withColumn("row", F.monotonically_increasing_id()), "keyed")
    passes = []
    for k in range(n):
        shared = context.broadcast(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow())
        passes.append(settle(keyed.select("row", "text").mapInArrow(tidy(_search(shared, width, "row", _of_pass)), _PASS), "pass"))
        shared.destroy()
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    found = found.groupBy("row").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    counts = keyed.mapInArrow(tidy(_word_counts), "row long, doc_id long, n_words long")
    out = settle(counts.join(found, "row", "left").select("doc_id", "n_words", "items", "spans").mapInArrow(tidy(_merged), OUT), "merged")
    discard(keyed, *passes)
    return out
