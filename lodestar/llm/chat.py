"""Chat formatting in budgeted windows.

Conversations are written as marked turns.  Prefix sums over the turns' tokens choose spans of whole turns that fit a
token budget; each window repeats the system turn and a little history before its new turns.  The loss mask covers the
texts of new assistant turns only, so every target counts once.  Control strings inside texts are escaped and can be
read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.pieces import Encoder, encoder
from lodestar.llm.text_arrays import as_bytes

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that mean something in this or other templates; inside texts they get a backslash after the first character.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RESTS = {c: "|".join(re.escape(x[1:]) for x in CONTROL if x[0] == c) for c in ("<", "[")}
_ESCAPE = re.compile("|".join(f"{re.escape(c)}(?=\\\\*(?:{rest}))" for c, rest in _RESTS.items()))
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(c)})\\\\(?=\\\\*(?:{rest}))" for c, rest in _RESTS.items()))

BUDGET = 1024
HISTORY_TURNS = 2

WINDOWS = "conv_id long, window int, text string, n_repeated int, n_tokens int, loss array<struct<start: int, stop: int>>"


def escaped(text: str) -> str:
    """Put a backslash after the first character of each control string, also of one that has backslashes there."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub("", text)


def written(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text begins and ends."""
    head = OPEN + escaped(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    body = escaped(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window, read back."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        out.append((unescaped(role), unescaped(body[: -len(CLOSE)])))
    return out


class Window:
    """Turns of one conversation on their way into windows; holds one window and its history at most."""

    def __init__(self, conversation, budget: int, history: int):
        self.conversation, self.budget, self.history = conversation, budget, history
        self.system, self.before, self.new = None, [], []
        self.number = 0

    def add(self, turn) -> Iterator[tuple]:
        """``turn``: role, written text, begin and end of the text in it, tokens."""
        if self.number == 0 and not self.new and self.system is None and turn[0] == "system":
            self.system = turn
        self.new.append(turn)
        repeated = self.repeated()
        # prefix sums of the new turns: the span ends before the turn that exceeds the budget
        ends = np.cumsum([t[4] for t in self.new]) + sum(t[4] for t in repeated)
        if ends[-1] > self.budget and len(self.new) > 1:
            last = self.new.pop()
            yield self.finish()
            self.new.append(last)

    def repeated(self) -> list:
        """System turn and latest turns before the new ones, as far as half the budget goes."""
        out = []
        if self.number == 0:
            return out
        room = self.budget // 2 - (self.system[4] if self.system else 0)
        for turn in reversed(self.before):
            if turn is self.system or turn[4] > room or len(out) == self.history:
                break
            out.insert(0, turn)
            room -= turn[4]
        return ([self.system] if self.system else []) + out

    def finish(self) -> tuple:
        repeated, text, loss, tokens = self.repeated(), [], [], 0
        at = 0
        for k, (role, body, begin, end, n) in enumerate(repeated + self.new):
            if role == "assistant" and k >= len(repeated):
                loss.append({"start": at + begin, "stop": at + end})
            text.append(body)
            at += len(body)
            tokens += n
        out = (self.conversation, self.number, "".join(text), len(repeated), tokens, loss)
        self.before = (self.before + self.new)[-self.history :] if self.history else []
        self.new, self.number = [], self.number + 1
        return out


def _windows(batches: Iterator[pa.RecordBatch], model, budget: int, history: int) -> Iterator[pa.RecordBatch]:
    counter: Encoder = encoder(f"json {hash(model.value)}", lambda: _tokenizer(model.value))
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(),
             pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    names = ["conv_id", "window", "text", "n_repeated", "n_tokens", "loss"]
    now: Window | None = None
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        shown = [written(role or "", text or "") for role, text in zip(roles, texts, strict=True)]
        _, begins = counter.encode(*as_bytes(pa.array([s[0] for s in shown], pa.large_string())))
        sizes = np.diff(begins).tolist()
        for conversation, role, turn, n in zip(batch.column("conv_id").to_pylist(), roles, shown, sizes, strict=True):
            if now is None or conversation != now.conversation:
                if now is not None:
                    rows.append(now.finish())
                now = Window(conversation, budget, history)
            rows.extend(now.add((role or "", *turn, n)))
            if len(rows) >= 2000:
                yield flush()
    if now is not None:
        rows.append(now.finish())
    yield flush()


def _tokenizer(model: str) -> Tokenizer:
    return Tokenizer.from_str(model)  # control strings count as the tokens they are


def formatted(
    turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY_TURNS
) -> DataFrame:
    """Windows of every conversation (rows ``conv_id``, ``turn``, ``role``, ``text``).

    ``text`` is the window, ``n_repeated`` of its turns were in an earlier one, ``loss`` are the character spans to learn
    from.  ``tokenizer`` is the path of a byte-level tokenizer file that counts the tokens.  A turn longer than the
    budget makes a window of its own; nothing is cut.  Turns are taken by number, those with the same number by role and
    text; null numbers come first, null roles and texts count as empty, rows without ``conv_id`` are one conversation.
    A conversation is formatted by one task, as its windows follow from each other, but in a stream: the task holds one
    window.  Other columns are ignored; an empty table gives no window.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = turns.sparkSession.sparkContext.broadcast(f.read())

    def windows(batches):
        return _windows(batches, model, budget, history)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.drop("turn").mapInArrow(windows, WINDOWS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, rows, state = object(), [], None

    def close():
        if state is not None:
            n, turns, chars, loss, size = state
            rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for conversation, text, repeated, loss in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True
        ):
            if state is None or conversation != now:
                close()
                now, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in turns_of(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in loss:
                target = unescaped(text[span["start"] : span["stop"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
    close()
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows alone: turns, texts under the loss mask, and sizes."""
    rows = windows.select("conv_id", "window", "text", "n_repeated", "loss")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(
        _read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
