"""Encoders by file: tokenizers for .json, tiktoken for .tiktoken, sentencepiece for .model."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
from importlib.metadata import version
from pathlib import Path

import numpy as np

#: Beyond these characters two libraries may split words by different Unicode tables.
_BEYOND = re.compile("[^\x00-ɏ]")
#: Runs that a splitting pattern may keep whole; longer ones go to the library's own merge queue.
LONG_RUN = 4096


def _has_long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and (max(map(len, text.split()), default=0) >= LONG_RUN or any(c * LONG_RUN in text for c in " \n\t"))


os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism


def fingerprint(path: str) -> str:
    """Digest of a tokenizer's file, library and settings: another version never meets its counts."""
    library = {".json": "tokenizers", ".tiktoken": "tiktoken", ".model": "sentencepiece"}[Path(path).suffix]
    h = hashlib.sha256(f"{library} {version(library)}; no special tokens added, no truncation, no padding\n".encode())
    h.update(Path(path).read_bytes())
    return h.hexdigest()


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tiktoken(ranks: dict[bytes, int]):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """encode(text) gives the ids of a text as unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path = path
        kind = Path(path).suffix
        if kind == ".tiktoken":
            ordinary = _tiktoken(_ranks(path)).encode_ordinary
            self.encode = lambda text: np.array(ordinary(text), np.uint32)
        elif kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: np.array(model.encode(text, num_threads=1), np.uint32)
        else:
            self._json(path)

    def _json(self, path: str) -> None:
        spec = json.loads(Path(path).read_text())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = re.compile("|".join(map(re.escape, self.added)) or "(?!)")

        def slow(text: str) -> np.ndarray:
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

        self.encode = slow
        split = spec.get("pre_tokenizer") or {}
        self.byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer")
        if not self.byte_level:
            return
        # The same merges and splitting pattern in a faster library, for texts on which both split alike.
        letters = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in self.added}
        self.tokens = [b""] * (max(max(ranks.values()), max(self.added.values(), default=0)) + 1)
        for token, n in ranks.items():
            self.tokens[n] = token
        for token, n in self.added.items():
            self.tokens[n] = token.encode()
        quick = _tiktoken(ranks)

        def encode(text: str) -> np.ndarray:
            if _BEYOND.search(text) or special.search(text) or _has_long_run(text):
                return slow(text)
            return np.array(quick.encode_ordinary(text), np.uint32)

        self.encode, self.special = encode, special

    @functools.cached_property
    def _whole(self):
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(self.path)
        whole.no_truncation(), whole.no_padding()
        return whole

    @functools.cached_property
    def _unsplit(self):
        import tokenizers

        unsplit = tokenizers.Tokenizer.from_file(self.path)
        unsplit.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        unsplit.encode_special_tokens = True
        return unsplit

    def split(self, text: str) -> list:
        """Words of a text, as the tokenizer splits it, with their places."""
        return self._whole.pre_tokenizer.pre_tokenize_str(text)

    def merge(self, text: str) -> np.ndarray:
        """Merges only: the text is one word, whatever it holds."""
        return np.array(self._unsplit.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with skip_special_tokens=False; byte-level files only."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in own)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    return Encoder(path)
