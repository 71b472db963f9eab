"""Operator 2, chat formatting in budgeted windows.

Turns of a conversation, in order, become windows of at most BUDGET tokens:

* prefix sums of turn tokens choose the turns of a window, whole turns only, and end
  it on an assistant turn where one is within reach;
* the opening system turn stands in every window;
* up to HISTORY turns before the window, of at most a quarter of the budget, are
  repeated as context; they give way, the oldest first, where the next new turn needs
  the room;
* a window passes the budget only where it must: a turn is never cut, so a new turn
  that does not fit beside the system turn is a window of its own with the system turn
  and no history.  Beside a system turn of more than half the budget the other turns get half
  the budget, and windows are as much longer as that takes;
* the loss mask covers the text of assistant turns that are new in the window, so
  each assistant text is a target once and repeated ones are masked.

Turns are marked ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline.  Control
strings inside a text are escaped by a backslash after their first character; those
that already hold backslashes there get one more, so the way back is exact.

Turns are shuffled by conversation and sorted by Spark (spilling to disk); a Python
worker streams over them and holds one window and its history, so a conversation of
any length needs bounded memory.

Defined results.  Null text and null role count as empty.  Turns are ordered by turn
(null first), then role, then text; repeated rows are turns like any other.  Texts of
any length are whole turns.  A null conversation id is one conversation.  An empty table
gives no windows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

BUDGET = 1024
HISTORY = 2
#: Tokens that the marks of a turn count for.
MARKS = 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"
#: What may not stand in a text unescaped; the marks above and those of other common templates.
_CONTROL = r"(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?SYS>>|/?INST\])"
_ESCAPE = re.compile(rf"([<\[])(?=\\*{_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*{_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


Turn = tuple[str, str, int]  # role, text, tokens


class Windows:
    """Streams one conversation's turns into windows ``(first_turn, n_context, n_new, tokens, text, loss spans)``."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY) -> None:
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.limit = budget
        self.past: list[Turn] = []
        self.open: list[Turn] = []
        self.first = 0

    def _context(self, first: int) -> list[Turn]:
        """The turns that are repeated before a window whose first new turn has ``first`` tokens."""
        head = [self.system] if self.system and self.first else []
        room = min(self.budget // 4, self.limit - first - sum(t[2] for t in head))
        back: list[Turn] = []
        for turn in reversed(self.past):
            room -= turn[2]
            if room < 0:
                break
            back.append(turn)
        return [*head, *reversed(back)]

    def push(self, turn: Turn) -> Iterator[tuple]:
        if not self.first and not self.open and turn[0] == SYSTEM:
            self.system, self.limit = turn, max(self.budget, turn[2] + self.budget // 2)
        self.open.append(turn)
        while len(self.open) > 1 and sum(t[2] for t in self.open) + sum(t[2] for t in self._context(self.open[0][2])) > self.limit:
            yield self._window()

    def flush(self) -> Iterator[tuple]:
        while self.open:
            yield self._window()

    def _window(self) -> tuple:
        context = self._context(self.open[0][2])
        sums = list(accumulate((t[2] for t in self.open), initial=0))
        n = max(1, bisect_right(sums, self.limit - sum(t[2] for t in context)) - 1)
        if n < len(self.open):
            n = next((k for k in range(n, 0, -1) if self.open[k - 1][0] == TARGET), n)
        new, self.open = self.open[:n], self.open[n:]
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate([*context, *new]):
            head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
            if k >= len(context) and role == TARGET:
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(f"{head}{body}{CLOSE}\n")
            at += len(parts[-1])
        first, self.first = self.first, self.first + n
        kept = [t for k, t in enumerate(new) if not (first == 0 and k == 0 and t is self.system)]
        self.past = [*self.past, *kept][-self.history :] if self.history else []
        return first, len(context), n, sums[n] + sum(t[2] for t in context), "".join(parts), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, body = part[: -len(CLOSE) - 1].split("\n", 1)
        out.append((_unescape_role(role), unescape(body)))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FIELDS = ("window", "first_turn", "n_context", "n_new", "tokens", "text", "loss_spans")


def _format(budget: int, history: int, counter: Callable[[], Callable[[str], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, key, made = counter(), None, None, 0
        for batch in batches:
            ids = batch.column(0)
            keys, of, rows = ids.to_pylist(), [], []
            closed: list[tuple] = []
            for k, (conv, role, text) in enumerate(zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                role, text = role or "", text or ""
                if now is None or conv != key:
                    for w in now.flush() if now else ():
                        closed.append((key, made, *w))
                        made += 1
                    now, key, made = Windows(budget, history), conv, 0
                for w in now.push((role, text, count(text) + MARKS)):
                    closed.append((key, made, *w))
                    made += 1
            if closed:
                yield _as_batch(closed, ids.type)
            kind = ids.type
        if now:
            yield _as_batch([(key, made + k, *w) for k, w in enumerate(now.flush())], kind)

    def _as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = (kind, *[pa.int64()] * 5, pa.string(), _SPANS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", *_FIELDS])

    return run


def _words() -> Callable[[str], int]:
    return lambda text: len(text.split())


def vocabulary_counter(path: str) -> Callable[[], Callable[[str], int]]:
    """Counts tokens with the vocabulary file of operator 9."""

    def make() -> Callable[[str], int]:
        from corpusmill.llm.bpe import encoder

        encode = encoder(path).encode
        return lambda text: len(encode(text.encode())) // 4

    return make


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, counter: Callable[[], Callable[[str], int]] = _words) -> DataFrame:
    """Rows ``conv_id, window, first_turn, n_context, n_new, tokens, text, loss_spans``, by conversation and window in each partition.

    ``n_context`` turns at the front of ``text`` are repeated (system and history); ``n_new`` follow.
    ``loss_spans`` are code point ranges of ``text``.
    """
    spark = turns.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = f"conv_id {kind}, window long, first_turn long, n_context long, n_new long, tokens long, text string, loss_spans array<struct<start:bigint,end:bigint>>"
    return dealt.mapInArrow(C.tidied(_format(budget, history, counter)), schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads windows back, in order, with running digests."""
    key, state = None, None

    def row() -> tuple:
        return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    for batch in batches:
        done, kind = [], batch.column(0).type
        for conv, skip, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_context", "text", "loss_spans"))):
            if state is None or conv != key:
                if state:
                    done.append(row())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, body in read_back(text)[skip:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in spans:
                target = unescape(text[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
            state[5] += 1
        if done:
            yield _digest_batch(done, kind)
    if state:
        yield _digest_batch([row()], kind)


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])


def digest_windows(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from :func:`format_conversations`' rows as they come (its order is needed)."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    return windows.mapInArrow(C.tidied(_digest), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
