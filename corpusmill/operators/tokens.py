"""A tokenizer plug: token counts, cuts at token ends, and fitting of context by sums of counted pieces.

A tokenizer says where its tokens end; counts and cuts follow from that.  It is loaded once a task and gets Arrow
batches.  Without a plug the library counts white-space words natively (``functions.text``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import pack
from corpusmill.runtime import ship
from corpusmill.settings import SettingsB


class Tokenizer(Protocol):
    def ends(self, texts: list[str]) -> list[Sequence[int]]:
        """For each text the code points, rising, at which its tokens end."""


class WordTokenizer:
    """Words between ASCII white space: the default counting as a plug."""

    _words = re.compile(r"[^\x20\x09-\x0D]+")

    def ends(self, texts: list[str]) -> list[list[int]]:
        return [[m.end() for m in self._words.finditer(t)] for t in texts]


#: Rows, and bytes of text unless one row has more, that a tokenizer gets at once; only their ends are held.
ROWS, BYTES = 256, 1 << 20


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by ROWS and BYTES of column ``at``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[start : start + ROWS], dtype=np.int64), BYTES, side="right")))
        yield batch.slice(start, n)
        start += n


def _told(df: DataFrame, make: Callable[[], Tokenizer], col: str, *made: tuple[str, pa.DataType, str, Callable[[str, Sequence[int]], object]]) -> DataFrame:
    """Adds columns ``(name, kind, sql, tell)``: what ``tell`` makes of a text and its token ends; null for null."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            at = whole.schema.get_field_index(col)
            for batch in _parts(whole, at):
                texts = batch.column(at).to_pylist()
                found = model.ends([t or "" for t in texts])
                if len(found) != len(texts):
                    raise ValueError(f"the tokenizer told of {len(found)} texts, not {len(texts)}")
                more = [pa.array([None if t is None else tell(t, e) for t, e in zip(texts, found)], kind) for _, kind, _, tell in made]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(m[0] for m in made)])

    shown = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{name}` {sql}" for name, _, sql, _ in made)])
    return df.mapInArrow(run, shown)


def _counted(out: str) -> tuple:
    return out, pa.int64(), "long", lambda _, ends: len(ends)


def count_tokens(df: DataFrame, make: Callable[[], Tokenizer], text_col: str = "text", out: str = "tokens") -> DataFrame:
    return _told(df, make, text_col, _counted(out))


def truncate(df: DataFrame, make: Callable[[], Tokenizer], n: int, text_col: str = "text", out: str = "cut", count: str | None = None) -> DataFrame:
    """Adds the text up to the end of its ``n``-th token, white space as it is; texts of fewer tokens stay whole.

    With ``count`` also the text's tokens, of the same pass.
    """
    cut = (out, pa.string(), "string", lambda text, ends: text if len(ends) <= n else text[: ends[n - 1]] if n else "")
    return _told(df, make, text_col, *([_counted(count)] if count else []), cut)


def fit_counted(df: DataFrame, make: Callable[[], Tokenizer], settings: SettingsB | None = None) -> DataFrame:
    """:func:`pack.fit_context` with a tokenizer: adds ``fit`` (chars, n_hits, tokens, state, fits).

    A tagged chunk is counted once for each length that the fitting can cut it to, so a state's tokens are a sum of
    numbers that are there: the frame of the prompt, the question, and the first chunks at the state's length.  No
    prompt is built.  For tokenizers that never join across a line break the sum is the prompt's exact number.
    """
    s = settings or SettingsB()
    limits = pack.fit_limits()
    frame = "".join(f"{role}:\n{body}\n{gap}" for role, body, gap in (("SYSTEM", s.system_prompt, "\n"), ("USER", "CONTEXT:\n\n\nQUESTION:\n", "")))
    base, gap = (len(e) for e in make().ends([frame, "\n\n"]))
    tags = F.transform(F.slice("hits", 1, s.policy.max_sources), lambda h: F.struct(T.source_tag(h["doc_path"], h["chunk_id"], h["score"]).alias("tag"), F.substring(h["chunk_text"], 1, max(limits)).alias("text")))
    ship(df.sparkSession)
    kept = df.withColumn("_pieces", tags)
    names, at = df.columns, {n: kept.columns.index(n) for n in ("_pieces", "question")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            rows = [r or [] for r in batch.column(at["_pieces"]).to_pylist()]
            questions = batch.column(at["question"]).to_pylist()
            pieces = [f"{h['tag'] or ''}\n{(h['text'] or '')[:n]}" for r in rows for h in r for n in limits]
            told = iter([len(e) for e in model.ends(pieces)])
            counts = [[[next(told) for _ in limits] for _ in r] for r in rows]
            asked = [len(e) for e in model.ends([q or "" for q in questions])]
            columns = [c for i, c in enumerate(batch.columns) if i != at["_pieces"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.list_(pa.list_(pa.int32()))), pa.array(asked, pa.int32())], [*names, "_counts", "_asked"])

    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    counted = kept.mapInArrow(run, f"{shown}, _counts array<array<int>>, _asked int")

    def weigh(state: Column, i: Column) -> Column:
        which = F.array_position(F.array(*[F.lit(n) for n in limits]), state["chars"]).cast("int")
        some = F.slice("_counts", F.lit(1), state["n_hits"])
        tokens = F.aggregate(some, F.lit(base) + F.col("_asked"), lambda a, c: a + F.element_at(c, which)) + F.lit(gap) * F.greatest(F.size(some) - 1, F.lit(0))
        return F.struct(state["chars"].alias("chars"), state["n_hits"].alias("n_hits"), tokens.alias("tokens"), i.alias("state"), (tokens + max(1, s.max_tokens) <= s.n_ctx).alias("fits"))

    return pack.first_fitting(counted, F.transform(pack.fit_states(F.col("hits")), weigh)).drop("_counts", "_asked")
