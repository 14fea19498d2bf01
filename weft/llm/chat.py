"""Chat formatting with a grammar round trip.

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>" "\\n" }

A turn is rendered as it stands and parsed again; if the parser does not give back
the same role and text, its control strings get one more backslash (`<|im_end|>` to
`<\\|im_end|>`), which the parser takes away, until they are identical.  Turns are
rendered each for itself: the parser reads one turn after the other, so the text of a
conversation is its turns' texts in order.

`read_back` parses formatted turns in order and hashes what it finds.  It streams over
partitions sorted by conversation and turn and holds one turn at a time, because the
digest of a conversation is one chain that no split can shorten.

Null texts and roles are empty.  Rows with equal turn numbers are ordered by role and
text; a null conversation id is a conversation; repeated rows are turns like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """Turns of a formatted text, unescaped; None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        line = formatted.find("\n", at)
        if line < 0:
            return None
        role, end = formatted[at + len(START) : line], formatted.find("<|im_", line)
        while end >= 0 and not formatted.startswith((START, END), end):
            end = formatted.find("<|im_", end + 1)
        if START in role or END in role or end < 0 or not formatted.startswith(END + "\n", end):
            return None
        turns.append((unescape_role(role), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text), escaped as often as the round trip needs."""
    shown_role, shown = role, text
    for _ in range(3):  # once for the text, once for the role; then it is identical
        out = f"{START}{shown_role}\n{shown}{END}\n"
        if (found := parse(out)) == [(role, text)]:
            at = len(START) + len(shown_role) + 1
            return out, at, at + len(shown)
        if found and len(found) == 1 and found[0][0] == role:
            shown = escape(text)
        else:
            shown, shown_role = escape(text), escape_role(role)
    raise ValueError(f"no round trip for a turn of role {role!r}")


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end: every row of `conversations`.

    loss_start, loss_end: the part of `formatted` under the loss mask, in code points; null unless the role is `loss_role`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [render(r, t) for r, t in zip(roles, texts)]
            spans = [(a, b) if r == loss_role else (None, None) for r, (_, a, b) in zip(roles, made)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([m[0] for m in made], pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
                ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
            )

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from `turns` of format_turns()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((now[0], state["n"], state["all"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"]))

        for batch in batches:
            for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now != (conv,):
                    close()
                    now, state = (conv,), {"n": 0, "all": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, text in parse(formatted):
                    state["n"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    text = unescape(formatted[a:b])
                    state["loss_n"] += len(text)
                    state["loss"].update(text.encode())
                state["chars"] += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    return arrow_map(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
