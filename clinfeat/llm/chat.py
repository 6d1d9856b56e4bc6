"""Chat formatting with a grammar that reads its own output back.

    conversation = turn*        turn = "<s>[INST] " role " [/INST]" text "</s>"

The four control strings may not occur in a role or text. Where one does, or what looks like an escaped one, a backslash goes behind
its first character; reading takes one backslash away. Each turn is rendered plainly, read back by the parser and compared with
its source; if it differs it is escaped and read again, and a turn that still differs is an error, never a silent change.

Turns are rendered and compared where they are read; only the digests of a conversation need its turns in order, and they are
taken as a stream over sorted rows, so a very long conversation is never held.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm.shared import map_batches

OPEN, AFTER_ROLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\])"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL), re.compile(r"([<\[])(\\*)\\" + _CONTROL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1]}{m[2]}\\{m[3]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] + m[2] + m[3], text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns (role, text, start and end of the text in ``formatted``); ValueError where the grammar does not fit."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        middle = formatted.find(AFTER_ROLE, at + len(OPEN))
        start = middle + len(AFTER_ROLE)
        end = formatted.find(CLOSE, start)
        if middle < 0 or end < 0:
            raise ValueError(f"turn without an end at {at}")
        role, text = formatted[at + len(OPEN):middle], formatted[start:end]
        if any(x in part for part in (role, text) for x in ("<s>", "</s>", "[INST]", "[/INST]")):
            raise ValueError(f"control string inside the turn at {at}")
        turns.append((unescape(role), unescape(text), start, end))
        at = end + len(CLOSE)
    return turns


def render(role: str, text: str) -> str:
    """One turn whose parse gives role and text back."""
    for change in (lambda x: x, escape):
        made = OPEN + change(role) + AFTER_ROLE + change(text) + CLOSE
        try:
            if [x[:2] for x in parse(made)] == [(role, text)]:
                return made
        except ValueError:
            pass
    raise ValueError(f"turn cannot be read back: {role!r}")


def _rendered(batch):
    made, starts, ends = [], [], []
    for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
        turn = render(role or "", text or "")
        (_, _, start, end), = parse(turn)
        made.append(turn), starts.append(start), ends.append(end)
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(made, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
        ["conv_id", "turn", "role", "formatted", "text_start", "text_end"],
    )


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, text_start, text_end): the turns of ``conversations`` (conv_id, turn, role, text).

    A conversation's formatted text is its turns' ``formatted`` in the order of ``turn``, then role and text. Characters text_start to
    text_end of an assistant turn are under the loss mask. Null role or text counts as empty. Other columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    return map_batches(rows, _rendered, "conv_id long, turn long, role string, formatted string, text_start long, text_end long")


def _digests(batches):
    state, current, begun = None, None, False
    out: list = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def give():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        out.clear()
        return made

    def close():
        out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
            if not begun or conv != current:
                if begun:
                    close()
                state, current, begun = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv, True
            for role, text, start, end in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    loss = unescape(formatted[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            state[4] += len(formatted)
        if len(out) >= 1000:
            yield give()
    if begun:
        close()
        yield give()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from ``formatted`` by the parser.

    ``turns`` is what formatted_turns gives. Rows with a null conv_id are one conversation; null turns come first; equal rows count as
    often as they occur. No rows give no conversations.
    """
    ordered = turns.select("conv_id", "turn", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
