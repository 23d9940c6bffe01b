"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings counts the triples of letters that both have in the same order, each weighed by
``DECAY`` to the number of characters it skips, up to a span of ``SPAN``, and by how rare the triple is in clean
text: letters with others between them, or with dots and blanks put in, still match. Training reads the sentences of labelled documents. Only a few
words of a toxic document are toxic, so its windows are not positive as such: those that begin at words
which mark toxic sentences are at first, and then those that the machine itself picks.

With landmarks L, a window x is the vector K(L, L)^(-1/2) K(L, x), on which a linear machine is fitted. Its
value is a sum over the triples of x, so a trained model is one table of triple weights, and whole texts are
scored by running sums over their characters. A text's score is that of its strongest window, calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import discard, free_name, settle, small_batches, tidy

SPAN, DECAY = 7, 0.8
#: Triples of a window begin at so many characters.
WIDTH = 10
LANDMARKS = 160
#: Labelled documents of either class that are read for training at most, each whole.
TRAIN_DOCS = 1500
#: Windows that the machine is fitted on at most: without and with a mark of toxicity, and clean ones that it took for toxic.
CLEAN, MARKED, HARD = 12_000, 6_000, 4_000
THRESHOLD = 0.3
#: Windows that are taken at once, to keep memory small.
ROWS = 2048

_CODE = np.zeros(256, np.int32)
for _k in range(26):
    _CODE[97 + _k] = _CODE[65 + _k] = _k + 1
_STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_PAD = SPAN + WIDTH
_LETTER, _ENDS = _CODE > 0, np.isin(np.arange(256), list(b".!?\n"))


@dataclass(frozen=True)
class Model:
    """table: weight of each triple of letters, 32 a side; then the value's calibration: 1 / (1 + exp(-(slope * value + shift)))."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """The machine's value of the window at each position."""
        n = len(codes) - SPAN
        v = np.zeros(n + 1, np.float64)
        sums = np.zeros(n, np.float32)
        for a in range(1, SPAN - 1):
            pair = (codes[:n] << 10) + (codes[a : a + n] << 5)
            for b in range(1, SPAN - a):
                sums += self.table[pair + codes[a + b : a + b + n]] * np.float32(DECAY ** (a + b - 2))
        np.cumsum(sums, out=v[1:])
        return v[WIDTH:] - v[:-WIDTH] + self.bias

    def values(self, codes: np.ndarray) -> np.ndarray:
        """As sums, but a window that begins at no word is taken for one without letters."""
        n = len(codes) - SPAN
        opens = codes[: n - WIDTH + 1] > 0
        opens[1:] &= codes[: n - WIDTH] == 0
        return np.where(opens, self.sums(codes), self.bias)

    def best(self, chunk: T.Chunk) -> np.ndarray:
        """The strongest window of each text; of no window, a window without letters."""
        size = np.diff(chunk.at)
        at = chunk.at[:-1] + np.arange(chunk.rows) * _PAD
        codes = np.zeros(len(chunk.data) + chunk.rows * _PAD + _PAD, np.int32)
        codes[np.arange(len(chunk.data)) + np.repeat(np.arange(chunk.rows) * _PAD, size)] = _CODE[chunk.data]
        return np.maximum.reduceat(self.values(codes), at)

    def scores(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def _triples(windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """For each start and step: table places (0 if a character is no letter) and weight, for all windows."""
    for i in range(WIDTH):
        for a, b, weight in _STEPS:
            x, y, z = (windows[:, k].astype(np.int32) for k in (i, i + a, i + a + b))
            yield np.where((x > 0) & (y > 0) & (z > 0), (x << 10) + (y << 5) + z, 0), np.float32(weight)


def _kernel(windows: np.ndarray, features: np.ndarray) -> np.ndarray:
    """K(windows, landmarks) from the landmarks' triple weights, places first."""
    out = np.zeros((len(windows), features.shape[1]), np.float32)
    for a in range(0, len(windows), ROWS):
        for place, weight in _triples(windows[a : a + ROWS]):
            out[a : a + ROWS] += features[place] * weight
    return out


def _machine(z: np.ndarray, y: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Linear machine with squared hinge loss, both classes of equal weight, by Newton steps on the active rows."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    size = z.shape[1] + 1
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-6
    w = np.zeros(size)
    for _ in range(40):
        left, right = ridge.copy(), np.zeros(size)
        for a in range(0, len(z), ROWS):
            x = np.concatenate([z[a : a + ROWS], np.ones((len(z[a : a + ROWS]), 1))], 1)
            active = y[a : a + ROWS] * (x @ w) < 1
            x, yw = x[active], (y * weight)[a : a + ROWS][active]
            left += x.T @ (x * np.abs(yw)[:, None])
            right += x.T @ yw
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w


def _calibrate(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the texts' values, with targets drawn in a little so that it stays finite."""
    n1, n0 = (weight * (y > 0)).sum(), (weight * (y <= 0)).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([value, np.ones(len(value))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(2) * 1e-6, x.T @ (weight * (p - target)))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out() -> Column:
    """Rows that training never sees: crc32 of doc_id as text leaves 2 when divided by 4; not so for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _values(model: Model):
    """(toxic, value of the strongest window) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.best(chunk) for chunk in T.chunks(batch.column("text"), T.CHUNK // 4)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["toxic", "value"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, without held-out rows.

    Reads up to ``TRAIN_DOCS`` documents a class, taken by a hash of doc_id, each whole: the one task that fits the machine is
    bounded by that number of texts. Spark then scores the same whole texts, and their values calibrate the machine. Several labels of a
    document count as toxic if one is. Null labels and ids are left out. Without documents of both classes every score is
    the share of toxic ones.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    met = settle(met, "labelled")
    fitted = met.repartition(1).mapInArrow(tidy(_fitted(share)), "table binary, bias double, slope double, shift double").collect()
    model = Model(np.frombuffer(fitted[0]["table"], np.float32), *fitted[0][1:]) if fitted else _share_only(share)
    if model.slope:
        told = met.select("toxic", "text").mapInArrow(tidy(_values(model)), "toxic int, value double").toArrow()
        y, value = told.column("toxic").to_numpy(), told.column("value").to_numpy()
        weight = np.array([share.get(int(k), 1) / max(1, int((y == k).sum())) for k in y])
        order = np.lexsort((value, y))  # rows come in any order, and sums must not depend on it
        slope, shift = _calibrate(value[order], y[order], (weight * len(y) / weight.sum())[order])
        model = Model(model.table, model.bias, slope, shift)
    discard(met)
    return model


@dataclass
class _Windows:
    """Windows that begin at words of different sentences: their characters, word number and the label of their sentence (1 if it stands in a toxic text)."""

    codes: np.ndarray
    start: np.ndarray
    word: np.ndarray
    toxic: np.ndarray

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.codes, WIDTH + SPAN)[self.start[k]]


def _cut(rows: pa.Table) -> tuple[_Windows, np.ndarray]:
    """The windows of all texts, and for each word the numbers of clean and of toxic sentences that it is in. Equal sentences, as copies have, count once."""
    kinds = rows.column("toxic").to_numpy()
    parts, codes, base, sentences = [], [], 0, 0
    for chunk in T.chunks(rows.column("text")):
        w = T.words(chunk, _LETTER)
        ends = _ENDS[chunk.data].astype(np.int64)
        ends[chunk.at[1:-1][chunk.at[1:-1] < len(ends)]] += 1
        number = np.cumsum(ends)
        owner = np.searchsorted(w.at, np.arange(len(w.start)), "right") - 1
        parts.append((w.start + base, w.hash, number[w.start] + sentences, kinds[chunk.first + owner]))
        codes += [_CODE[chunk.data].astype(np.uint8), np.zeros(_PAD, np.uint8)]
        base += len(chunk.data) + _PAD
        sentences += int(number[-1]) + 1 if len(number) else 1
    start, word, sentence, toxic = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
    if len(start):
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        size = np.diff(np.concatenate([first, [len(sentence)]]))
        place = np.arange(len(start)) - np.repeat(first, size)
        name = np.add.reduceat(T.mix(word ^ T.mix(place.astype(np.uint64))), first)
        _, one, same = np.unique(name, return_index=True, return_inverse=True)
        label = np.zeros(len(one), np.int8)
        np.maximum.at(label, same, toxic[first].astype(np.int8))
        kept = np.zeros(len(first), bool)
        kept[one] = True
        here = np.repeat(kept, size)
        start, word, sentence, toxic = start[here], word[here], np.repeat(same, size)[here], np.repeat(label[same], size)[here]
    word = np.unique(word, return_inverse=True)[1]
    words, size = (int(word.max()) + 1, len(label)) if len(word) else (0, 0)
    there = np.unique(word * max(1, size) + sentence)
    count = np.zeros((words + 1, 2), np.int64)
    if size:
        np.add.at(count, (there // size, label[there % size]), 1)
        count[words] = [int((label == k).sum()) for k in (0, 1)]  # of all sentences
    return _Windows(np.concatenate([*codes, np.zeros(_PAD, np.uint8)]), start, word.astype(np.int32), toxic.astype(np.int8)), count


def _share_only(share: dict[int, int]) -> Model:
    """Every score is the share of toxic documents."""
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    return Model(np.zeros(1 << 15, np.float32), 0.0, 0.0, float(np.log(prior / (1 - prior))))


def _fitted(share: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [b for b in batches if b.num_rows]:
            m = fit(pa.Table.from_batches(rows).sort_by([("doc_id", "ascending"), ("text", "ascending")]), share)
            yield pa.RecordBatch.from_pydict({"table": [m.table.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    return run


def fit(rows: pa.Table, share: dict[int, int]) -> Model:
    """rows: toxic and text, in a fixed order. share: documents of each class in all labels. The model is not calibrated; without both classes its slope is 0."""
    nothing = _share_only(share)
    if len(set(rows.column("toxic").to_pylist())) < 2:
        return nothing
    windows, count = _cut(rows)
    toxic, word = windows.toxic, windows.word
    count, (clean_size, toxic_size) = count[:-1], np.maximum(1, count[-1])
    mark = (count[:, 1] >= max(3, 0.002 * toxic_size)) & ((count[:, 1] + 0.5) / (toxic_size + 1) >= 8 * (count[:, 0] + 0.5) / (clean_size + 1))
    if not mark.any():
        return nothing
    rng = np.random.default_rng(11)
    negative = np.flatnonzero(toxic == 0)
    negative = np.sort(rng.choice(negative, min(len(negative), CLEAN), replace=False))
    positive = np.flatnonzero((toxic == 1) & mark[word])
    positive = np.sort(rng.choice(positive, min(len(positive), MARKED), replace=False))
    if not len(negative):
        return nothing

    # Landmarks: half of them by turns from each marking word, half from clean windows.
    by_word = {int(w): positive[word[positive] == w] for w in np.unique(word[positive])}
    turns = [ks[t] for t in range(LANDMARKS) for _, ks in sorted(by_word.items(), key=lambda x: (-len(x[1]), x[0])) if t < len(ks)][: LANDMARKS // 2]
    marked = windows[np.concatenate([turns, rng.choice(negative, min(len(negative), LANDMARKS // 2), replace=False)])]
    features = np.zeros((1 << 15, len(marked)), np.float32)
    for place, weight in _triples(marked):
        np.add.at(features, (place, np.arange(len(marked))), weight)
    usual = np.zeros(1 << 15)
    for place, weight in _triples(windows[negative]):
        usual += np.bincount(place, minlength=1 << 15) * weight
    rare = (1 / (usual / max(1, len(negative)) + 0.003)).astype(np.float32)
    rare[0] = 0
    features *= (rare / _kernel(marked, features * rare[:, None]).diagonal().mean())[:, None]
    eigen, vectors = np.linalg.eigh(_kernel(marked, features).astype(np.float64))
    keep = eigen > eigen.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(eigen[keep])

    def stretched(x: np.ndarray) -> np.ndarray:
        """The same windows with a character put between letters: at one place, or at each."""
        one, each = np.zeros_like(x), np.zeros_like(x)
        cut = rng.integers(1, 4, len(x))
        for k, c in enumerate(cut):
            one[k] = np.concatenate([x[k, :c], [rng.integers(0, 27)], x[k, c:-1]])
        half = (x.shape[1] + 1) // 2
        each[:, ::2] = x[:, :half]
        return np.concatenate([one, each])

    for turn in range(3):
        plus = windows[positive]
        none = np.zeros((len(negative) // 10 + 1, WIDTH + SPAN), np.uint8)  # windows without letters are clean
        x = np.concatenate([plus, stretched(plus), windows[negative], none])
        y = np.concatenate([np.ones(3 * len(plus)), -np.ones(len(negative) + len(none))])
        w = _machine(_kernel(x, features) @ root.astype(np.float32), y)
        table = np.zeros(1 << 15, np.float32)
        table[:] = features @ (root @ w[:-1]).astype(np.float32)
        table[0] = 0
        model = Model(table, float(w[-1]), 1.0, 0.0)
        if turn == 2:
            break
        value = np.empty(len(windows.start), np.float32)
        step = 1 << 20  # of characters, with what the last windows reach beyond
        for a in range(0, len(windows.codes), step):
            here = slice(*np.searchsorted(windows.start, [a, a + step]))
            value[here] = model.sums(windows.codes[a : a + step + _PAD].astype(np.int32))[windows.start[here] - a]
        picked = np.flatnonzero((toxic == 1) & (value > 0))
        if not len(picked):
            break
        positive = picked[np.argsort(-value[picked], kind="stable")[:MARKED]]
        clean = np.flatnonzero(toxic == 0)
        negative = np.union1d(negative, clean[np.argsort(-value[clean], kind="stable")[:HARD]])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of ``docs`` with score double (0 to 1) and predicted int (1 from ``THRESHOLD`` on), from the whole text alone.

    Null and empty texts have the score of a text without letters. Repeated rows and null doc_ids give a row each. No rows give none.
    """
    small_batches(docs.sparkSession)
    names = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    said = free_name("_text", names)
    rows = docs.select(*names, F.col("text").cast("string").alias(said))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.scores(model.best(chunk)) for chunk in T.chunks(batch.column(said), T.CHUNK // 4)]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != said)
    return rows.mapInArrow(tidy(run), f"{kinds}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, by a model trained on the labelled ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
