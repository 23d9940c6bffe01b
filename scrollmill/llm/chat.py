"""Chat formatting by a finite-state machine over roles.

A template is data: which role may follow which state, and the segments that a turn is written as. Turns of a
conversation are dealt by conversation and sorted; a task passes over them once and keeps the state of one
conversation, never its turns, so a conversation of any length needs the memory of one turn. Control strings
inside a text are escaped, and ``read_back`` undoes it from the written segments alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """moves: (state, role) to state; a role without a move breaks the order and leads to the state ``broken``, from which
    the same moves as from the start go on. opens, closes: control text before and after a turn's text; ``{role}`` is
    the escaped role. loss: roles whose text is learnt."""

    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "told", ("told", "user"): "asked"}
    )
    opens: str = "<s>[INST]{role}[/INST]"
    closes: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escapes: tuple[tuple[str, str], ...] = (("<", "\\l"), ("[", "\\b"))

    def escape(self, text: str) -> str:
        """Backslashes are doubled; the first character of a control string becomes its escape, so none is left."""
        to = dict(self.escapes)
        controls = "|".join(map(re.escape, sorted(self.controls, key=len, reverse=True)))
        return re.sub(controls, lambda m: to[m[0][0]] + m[0][1:], text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        back = {v[1]: k for k, v in self.escapes} | {"\\": "\\"}
        return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S)


DEFAULT = Template()
_SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, in_order boolean"
_TURNS = ["conv_id", "turn", "role", "text"]


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Three rows for each turn of ``turns(conv_id, turn, role, text, ...)``: what opens it, its text, what closes it.

    The order within a conversation is turn, role, text with nulls first; turn_no counts from 0. in_order tells whether
    the machine allowed the turn after those before it. A null text or role is empty; a null conv_id is a conversation of
    its own kind, with a null id. Rows that repeat are turns that repeat. Other columns are left out. No rows give no rows.
    The rows come out sorted inside each partition, a conversation in one of them.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state, number = template.start, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now != (conv,):
                    now, state, number = (conv,), template.start, 0
                following = template.moves.get((state, role))
                ok = following is not None
                state = following or template.moves.get((template.start, role)) or "broken"
                said = (template.opens.replace("{role}", template.escape(role)), template.escape(text), template.closes)
                out += [(conv, number, k, s, k == 1 and role in template.loss, ok) for k, s in enumerate(said)]
                number += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn_no", "segment", "text", "loss", "in_order"])

    return rows.repartition("conv_id").sortWithinPartitions(*_TURNS).mapInArrow(run, _SEGMENTS)


def read_back(written: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a conversation from the segments in their order: what a reader of the formatted text and its mask sees.

    The text is cut at the template's control strings alone; n_turns, turns_sha256 (role, line feed, text, line feed for each
    turn), loss_chars and loss_sha256 (unescaped text under the mask), formatted_chars, in_order (of all turns).
    """
    before, after = map(re.escape, template.opens.split("{role}"))
    turn = re.compile(f"{before}(.*?){after}(.*?){re.escape(template.closes)}", re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: list[tuple] = []

        def done() -> tuple:
            return (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, ordered)

        for batch in batches:
            for conv, text, learnt, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "in_order")), strict=True):
                if now != (conv,):
                    if now is not None:
                        rows.append(done())
                    now, held, n, chars, size, ordered = (conv,), "", 0, 0, 0, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                held += text
                size += len(text)
                ordered &= ok
                if learnt:
                    said = template.unescape(text)
                    chars += len(said)
                    loss.update(said.encode())
                if m := turn.fullmatch(held):
                    turns.update(f"{template.unescape(m[1])}\n{template.unescape(m[2])}\n".encode())
                    n, held = n + 1, ""
            if len(rows) > 5_000:
                yield _told(rows)
                rows = []
        if now is not None:
            rows.append(done())
        if rows:
            yield _told(rows)

    return written.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
