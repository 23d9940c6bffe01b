"""Spelling variants by finite-state composition.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one into the other: if the
vocabulary's acceptor, composed with a transducer that makes exactly one edit and with the acceptor again, accepts the
pair. The composition is enumerated apart for each initial state. As a pair of which the shorter word has m code points
agrees in at least m // 2 of them at its front or at its back, the composition starts where a shared front, or a shared
back, has been read: such a class holds the words of m and m + 1 code points with one front and back. A pair belongs to
exactly one class by the place where its words first differ.

A class of more than ``MOST`` words is cut again in the same way, front or back of what is left between, until one
code point is left there; then it holds at most the alphabet and its square. Classes whose words are longer than
``LONG`` between front and back are cut in any case, and those of one word go, so no task builds a large acceptor.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, settle, small_batches, tidy

#: Least code points and occurrences of a word; how many times as frequent a form must be.
SHORTEST, OFTEN, TIMES = 6, 5, 5
#: One in so many runs of a document, by its hash, loses a code point.
DAMAGED = 199
#: Words of a class at most, more than an alphabet of 90 code points and its square; code points between front and back.
MOST, LONG = 10_000, 64
#: Words that a task counts before it hands them on, and bytes of a text that it cuts into runs at once.
HELD, PIECE = 200_000, 1 << 20
#: Latin-1: a-z and U+00C0 to U+00FF are letters, A-Z become a-z, all else a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    data = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs(doc_id, text, ...)``: words with enough code points and occurrences over all documents.

    Runs of letters are cut from whole texts and only A-Z lower-cased. A run of which ``DAMAGED`` divides the crc32 of
    "doc_id:run" loses the code point at that number modulo its length. Null texts hold none, a null doc_id is read as "".
    """
    small_batches(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            names = pa.array([w.decode("latin-1") for w in counts], pa.string())
            out = pa.RecordBatch.from_arrays([names, pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                found: Counter[bytes] = Counter()
                for part in _runs(text.as_py()):
                    found.update(part)
                seed = crc32(name.as_py().encode() + b":")
                for run, n in found.items():
                    size = len(run)
                    if size < SHORTEST:
                        continue
                    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                    if h % DAMAGED == 0:
                        run = run[: h % size] + run[h % size + 1 :]
                        if size == SHORTEST:
                            continue
                    counts[run] += n
                if len(counts) >= HELD:
                    yield told()
        if counts:
            yield told()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    return read.where("text is not null").mapInArrow(tidy(tally), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words: equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int], list[str]] = {}
        self.start = self._state(words, 0, len(words), 0) if words else None

    def _state(self, words: list[str], lo: int, hi: int, at: int) -> int:
        """The state behind the first ``at`` code points, which words lo to hi share."""
        final = len(words[lo]) == at
        lo += final
        arcs = {}
        while lo < hi:
            c = words[lo][at]
            end = lo + 1 if lo + 1 == hi or words[lo + 1][at] != c else bisect_left(words, True, lo + 1, hi, key=lambda w, c=c: w[at] != c)
            arcs[c] = self._state(words, lo, end, at + 1)
            lo = end
        key = (final, *arcs.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[s] for s in arcs.values()))
        return found

    def shared(self, p: int, q: int) -> list[str]:
        """Words that lead from p and from q to acceptance: what the transducer copies after its edit."""
        key = (p, q) if p <= q else (q, p)
        out = self._shared.get(key)
        if out is None:
            out = [""] if self.final[p] and self.final[q] else []
            a, b = self.arcs[p], self.arcs[q]
            for c in a.keys() & b.keys() if len(a) > 1 and len(b) > 1 else [c for c in a if c in b]:
                out += [c + t for t in self.shared(a[c], b[c])]
            self._shared[key] = out
        return out

    def near(self, most: int) -> Iterator[tuple[str, str]]:
        """Pairs that are accepted when exactly one edit is made, before ``most`` code points are copied; each pair once.

        The edit is at the first place where the two differ. The first word is the longer one, if either is.
        """
        todo = [("", self.start)] if self.start is not None else []
        while todo:
            x, p = todo.pop()
            if self.size[p] < 2 or len(x) >= most:
                continue
            arcs = list(self.arcs[p].items())
            for k, (c, r) in enumerate(arcs):
                for d, s in arcs[:k]:  # c for d
                    for t in self.shared(r, s):
                        yield x + c + t, x + d + t
                if self.final[r] and self.final[p]:  # c, and then the end
                    yield x + c, x
                here = self.arcs[p]
                for d, s in self.arcs[r].items():  # c, and then what follows without it
                    if d != c and d in here:
                        for t in self.shared(s, here[d]):
                            yield x + c + d + t, x + d + t
                todo.append((x + c, r))


def _halved(rows: DataFrame) -> DataFrame:
    """rows(word, n, m, front, back, most) in the two classes below: with more of the front, or, where words differ before that, with more of the back."""
    half = F.floor((F.col("m") - F.col("front") - F.col("back")) / 2).cast("int")
    more = F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("most").alias("most"))
    less = F.struct(F.col("front").alias("front"), (F.col("back") + half).alias("back"), (F.col("front") + half).alias("most"))
    cut = rows.select("word", "n", "m", F.explode(F.array(more, less)).alias("c")).select("word", "n", "m", "c.*")
    told = F.concat_ws(":", *(F.col(c).cast("string") for c in ("m", "front", "back", "most")), F.expr("left(word, front)"), F.expr("right(word, back)"))
    return cut.withColumn("key", F.md5(told))


def _classes(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, word, n, m, front, back, most) of all classes whose pairs are to be told, and the tables that this reads.

    Pairs of a class differ before ``most`` code points are read. Rounds are as many as the logarithm of the longest word's length.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= SHORTEST)
    todo = _halved(rows.select("word", "n", "m", F.lit(0).alias("front"), F.lit(0).alias("back"), (F.col("m") + 1).alias("most")))
    between = F.col("m") - F.col("front") - F.col("back")
    done, used = [], []
    while True:
        # Counted before the shuffle. Large classes are at most one in ``MOST`` of the rows; long words are seldom alike.
        cut = todo.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(between).alias("left")).where((F.col("left") > 1) & ((F.col("k") > MOST) | (F.col("k") > 1) & (F.col("left") > LONG))).select("key")
        used.append(cut := settle(cut, "large"))
        done.append(todo.where(between <= LONG).join(cut, "key", "left_anti"))
        if cut.isEmpty():
            break
        used.append(todo := settle(_halved(todo.join(cut, "key", "left_semi")), "halved"))
    return reduce(DataFrame.unionByName, done), used


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form), written once, of the words of ``words(word, n)`` that have a near one: their number, and the most frequent of them, (n, word); of equals the first in code-point order.

    word is not null and distinct. No rows give none.
    """

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("key", "word", "n", "m", "front", "back", "most")), strict=True)

        out: dict[str, list] = {}
        for _, group in groupby(rows(), lambda r: r[0]):
            group = list(group)
            if len(group) < 2:
                continue
            _, _, _, m, front, back, most = group[0]
            held = {w[front : len(w) - back]: (w, n) for _, w, n, *_ in group}
            shortest = m - front - back
            found: dict[str, list] = {}
            for u, v in Acceptor(sorted(held)).near(most - front):
                if len(v) == shortest:  # two longer words are a pair of the next m
                    for one, other in ((held[u], held[v]), (held[v], held[u])):
                        best = (-other[1], other[0])
                        so_far = found.get(one[0])
                        if so_far is None:
                            found[one[0]] = [1, best]
                        else:
                            so_far[0] += 1
                            so_far[1] = min(so_far[1], best)
            for w, (k, best) in found.items():
                so_far = out.get(w)
                out[w] = [k, best] if so_far is None else [so_far[0] + k, min(so_far[1], best)]
            if len(out) >= HELD:
                yield told(out)
        if out:
            yield told(out)

    def told(out: dict[str, list]) -> pa.RecordBatch:
        columns = [pa.array(list(out), pa.string()), pa.array([k for k, _ in out.values()], pa.int64()), pa.array([b[0] for _, b in out.values()], pa.int64()), pa.array([b[1] for _, b in out.values()], pa.string())]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "k", "minus", "form"])

    small_batches(words.sparkSession)
    classes, used = _classes(words)
    dealt = classes.select("key", "word", "n", "m", "front", "back", "most").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(tidy(compose), "word string, k long, minus long, form string")
    best = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("minus", "form")).alias("b"))
    out = settle(best.select("word", "n_near", F.struct((-F.col("b.minus")).alias("n"), F.col("b.form").alias("word")).alias("form")), "near")
    discard(*used)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): where the forms lead to. Steps double each round, and a form's count grows by ``TIMES`` a step, so rounds are few."""
    known = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not known.where("moved").isEmpty():
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, known = known, settle(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
    return known.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs(doc_id, text, ...)``, see ``count_words``.

    form: the most frequent near word (of equals the first in code-point order), if it is ``TIMES`` times as frequent,
    else null; root: where forms lead to from the word, itself if it has none. Repeated rows count each; null and empty
    texts hold no words; other columns are not read. An empty table gives no rows.
    """
    words = settle(count_words(docs), "vocabulary")
    near = near_words(words)
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form.n") >= TIMES * F.col("n"), F.col("form")).alias("form"))
    roots = _roots(found.where("form is not null").select("word", F.col("form.word").alias("form")))
    return found.join(roots, "word", "left").select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))
