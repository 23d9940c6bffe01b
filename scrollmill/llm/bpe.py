"""Byte-pair encoding and decoding of whole texts by tree concatenation.

A text of more than ``LEAF`` characters is halved, and its halves are, until its pieces are not longer; the pieces are
encoded in parallel by whichever tasks they hash to, and joined as a tree. At each join a window of tokens on both
sides is encoded again and doubled until its outermost tokens agree with the two sides. A half is cut at the space
nearest to the middle that the tokenizer splits at in any case. Where there is none, the text is cut into words as the
tokenizer splits it, a longer word is halved anywhere, and merges alone are looked at again at its joins: a byte-pair
encoding is right if and only if each pair of neighbouring tokens is, so what lies outside of the window stands.
Shorter texts are one piece and are encoded where they are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._groups import grouped
from ._store import small_batches, tidy
from ._tokenizers import Encoder, encoder

#: Characters of a piece at most.
LEAF = 8192
#: Bytes of encoded rows in one Arrow batch.
BATCH = 16 << 20


#: A space between two printable ASCII characters: a byte-level splitting pattern ends a word before it, and looks no further back.
_SAFE = re.compile("(?<=[!-~]) (?=[!-~])")


def safe_halves(text: str, leaf: int) -> list[str]:
    """Pieces that end where any such text is split; one longer than ``leaf`` has no such place in its middle half."""
    if len(text) <= leaf:
        return [text]
    middle, reach = len(text) // 2, len(text) // 4
    after = _SAFE.search(text, middle, middle + reach)
    before = None
    for before in _SAFE.finditer(text, max(middle - 200, 0), middle):
        pass
    if before is None and after is None:
        for before in _SAFE.finditer(text, middle - reach, middle):
            pass
    at = min((m.start() for m in (before, after) if m), key=lambda k: abs(k - middle), default=None)
    return [text] if at is None else safe_halves(text[:at], leaf) + safe_halves(text[at:], leaf)


def halves(text: str, leaf: int) -> list[str]:
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


def join(left: np.ndarray, right: np.ndarray, tokens: list[bytes], merge: Callable[[str], np.ndarray]) -> np.ndarray:
    """The encoding of two neighbouring pieces of a word from theirs."""
    width = 4
    while len(left) and len(right):
        a, b = left[-width:], right[:width]
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        try:
            again = merge(b"".join(tokens[i] for i in [*a.tolist(), *b.tolist()]).decode())
        except UnicodeDecodeError:  # a token ends inside a character
            width += 1
            continue
        k = min(2, len(a), len(b), len(again))
        if (whole_left or np.array_equal(again[:k], a[:k])) and (whole_right or np.array_equal(again[-k:], b[-k:])):
            return np.concatenate([left[: len(left) - len(a)], again, right[len(b) :]])
        width *= 2
    return np.concatenate([left, right])


def tree(pieces: list[np.ndarray], tokens: list[bytes], merge: Callable[[str], np.ndarray]) -> np.ndarray:
    if len(pieces) == 1:
        return pieces[0]
    middle = len(pieces) // 2
    return join(tree(pieces[:middle], tokens, merge), tree(pieces[middle:], tokens, merge), tokens, merge)


#: What a piece is: encoded as a text of its own and joined to others of its kind; words, each merged alone; an added token. Others are numbers of long words.
TEXT, WORDS, ADDED = -3, -1, -2


def pieces(text: str, e: Encoder, leaf: int = LEAF) -> Iterator[tuple[int, list[str]]]:
    """(kind, parts) of the pieces of a text, in order."""
    word = at = 0

    def split(run: str) -> Iterator[tuple[int, list[str]]]:
        nonlocal word
        for piece in safe_halves(run, leaf) if run else []:
            if len(piece) <= leaf:
                yield TEXT, [piece]
                continue
            held, size = [], 0
            for _, (a, b) in e.split(piece):
                if b - a > leaf:
                    if held:
                        yield WORDS, held
                    for half in halves(piece[a:b], leaf):
                        yield word, [half]
                    word, held, size = word + 1, [], 0
                else:
                    held.append(piece[a:b])
                    size += b - a
                    if size > leaf:
                        yield WORDS, held
                        held, size = [], 0
            if held:
                yield WORDS, held

    for m in e.special.finditer(text):
        yield from split(text[at : m.start()])
        yield ADDED, [m[0]]
        at = m.end()
    yield from split(text[at:])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text, ...)``: ids are little-endian unsigned 32-bit integers.

    The ids are those of the byte-level file at ``path`` without added special tokens, truncation or padding; special
    strings inside a text become their token. A null or empty text has no ids. Repeated rows and null doc_ids give a row
    each; other columns are left out. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > LEAF

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids, size, at = [], 0, 0
            for k, text in enumerate(batch.column("text")):
                ids.append(e.encode(text.as_py()).tobytes())
                size += len(ids[-1])
                if size > BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                    ids, size, at = [], 0, k + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                found = list(pieces(text, e))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([w for w, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.string()))],
                    ["row", "doc_id", "piece", "word", "parts"],
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids = []
            for word, parts in zip(batch.column("word").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if word == ADDED:
                    ids.append(np.array([e.added[parts[0]]], np.uint32).tobytes())
                else:
                    ids.append(b"".join((e.encode if word == TEXT else e.merge)(p).tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "piece", "word")), pa.array(ids, pa.binary())], ["row", "doc_id", "piece", "word", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for t in grouped(batches, ["row"]):
            out, kind, waiting = [], WORDS, []
            for word, ids in [*zip(t.column("word").to_pylist(), t.column("ids").to_pylist(), strict=True), (WORDS, b"")]:
                if waiting and word != kind:
                    out.append(tree(waiting, e.tokens, e.encode if kind == TEXT else e.merge).tobytes())
                    waiting = []
                if word in (WORDS, ADDED):
                    out.append(ids)
                else:
                    waiting.append(np.frombuffer(ids, np.uint32))
                kind = word
            yield pa.RecordBatch.from_arrays([t.column("doc_id").slice(0, 1).combine_chunks(), pa.array([b"".join(out)], pa.binary())], ["doc_id", "ids"])

    rest = docs.where(long).withColumn("row", F.monotonically_increasing_id())
    rest = rest.mapInArrow(tidy(spread), "row long, doc_id long, piece long, word long, parts array<string>").repartition("row", "piece")
    rest = rest.mapInArrow(tidy(encoded), "row long, doc_id long, piece long, word long, ids binary").repartition("row").sortWithinPartitions("row", "piece")
    return docs.where(~long).mapInArrow(tidy(short), "doc_id long, ids binary").unionByName(rest.mapInArrow(tidy(joined), "doc_id long, ids binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column decoded, as the library's decode(ids, skip_special_tokens=False); null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [None if x is None else e.decode(np.frombuffer(x, np.uint32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "decoded"])

    kept = encoded.drop("decoded")
    columns = kept.columns
    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to."""
    out = decode(encode(docs, path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
