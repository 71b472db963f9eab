"""Operator 12, periodic runs of words, found with a suffix automaton.

A run is a stretch of words whose words ``q`` apart are equal, ``q`` its smallest period, of at
least MIN_POWER periods and MIN_LENGTH words, that cannot be made longer on either side.

Each text is one row and one call.  In a run some four words (WINDOW) in a row recur three
times or more and such windows cover all of it, so words outside them split the text into
segments that are searched by themselves; most texts have none.  For a segment:

* the suffix automaton of its words is built;
* from the longest states up, the ordered sets of end positions of a state are merged along
  the suffix links, the smaller into the larger, which moves a position a logarithmic number
  of times.  Two positions that become neighbours at a state of length ``m`` end equal stretches of
  exactly ``m`` words, so if they are ``d <= m`` apart they are the end of a square of period ``d``
  that goes on ``m`` words to the left of the first.  States too short for a run are left out;
* the square is the end of a run if the next word breaks the period: its ends are then those of
  the run.  Neighbours that a later merge parts give a multiple of the period for the same
  stretch; the smallest period stays.

Sets are sorted lists, cut into blocks once they are long.  Memory is some 700 bytes for each word
of the longest segment of a text.

Defined results.  Null and empty texts have no words and no runs, and collapse to the empty
text.  A very long text is searched whole.  Rows with equal or null ids are told one by one.
Overlapping runs are all listed.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

MIN_LENGTH, MIN_POWER = 6, 4
#: Words of the windows that cover every run, and the times that each of them occurs in the text.
WINDOW, OFTEN = 4, 3
#: Positions from which a set is kept in blocks, and the size at which a block is halved.
BLOCK = 2048
_STEP = 0x9E3779B97F4A7C15


class Positions:
    """An ordered set in blocks."""

    def __init__(self, items: list[int]) -> None:
        half = BLOCK // 2
        self.blocks = [items[i : i + half] for i in range(0, len(items), half)]
        self.last = [b[-1] for b in self.blocks]
        self.size = len(items)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def insert(self, x: int) -> tuple[int, int]:
        """Put ``x`` in and return its neighbours, -1 where there is none."""
        self.size += 1
        k = bisect_left(self.last, x)
        if k == len(self.blocks):
            before = self.last[-1]
            self.blocks[-1].append(x)
            self.last[-1] = x
            k, pair = k - 1, (before, -1)
        else:
            block = self.blocks[k]
            i = bisect_left(block, x)
            before = block[i - 1] if i else self.last[k - 1] if k else -1
            pair = (before, block[i])
            block.insert(i, x)
        block = self.blocks[k]
        if len(block) >= BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.last[k : k + 1] = [block[half - 1], block[-1]]
        return pair


def suffix_automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state: the length of its longest stretch, its suffix link, and where it ends if it is a whole prefix (else -1)."""
    length, link, end, go = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(codes):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        go.append({})
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                go.append(dict(go[q]))
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return length, link, end


def _merge(a: list | Positions, b: list | Positions) -> tuple[list | Positions, list[tuple[int, int]]]:
    """The union, and pairs of new neighbours, one position from either set."""
    if len(a) < len(b):
        a, b = b, a
    if isinstance(a, list) and len(a) + len(b) >= BLOCK:
        a = Positions(a)
    pairs, last = [], -1
    for x in b:
        if isinstance(a, Positions):
            before, after = a.insert(x)
        else:
            i = bisect_left(a, x)
            before, after = a[i - 1] if i else -1, a[i] if i < len(a) else -1
            a.insert(i, x)
        if before > last:  # else it is of the same set
            pairs.append((before, x))
        if after >= 0:
            pairs.append((x, after))
        last = x
    return a, pairs


def segment_runs(codes: list[int], min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a list, by start and period."""
    n = len(codes)
    length, link, end = suffix_automaton(codes)
    least = min(max(min_length - d, (min_power - 1) * d) for d in range(1, min_length + 1))
    ends: list = [None] * len(length)
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        mine, at = ends[state], end[state]
        own = length[state]
        if mine is None:
            mine, pairs = [at], ()
        elif at >= 0 and own >= least:
            mine, pairs = _merge(mine, [at])
        else:
            pairs = ()
        up = link[state]
        ends[state] = None
        while True:
            for a, b in pairs:
                d = b - a
                if (min_power - 1) * d <= own and d + own >= min_length and (b + 1 == n or codes[b + 1] != codes[b + 1 - d]):
                    key = (a - own + 1, b)
                    if found.get(key, d) >= d:
                        found[key] = d
            if own == length[up] or length[up] < least:
                break
            own = length[up]
            if ends[up] is None:
                ends[up] = mine
                break
            ends[up], pairs = _merge(ends[up], mine)
    return sorted((a, b - a + 1, d) for (a, b), d in found.items())


def _segments(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches of words that windows cover which occur OFTEN times or more; every run lies in one of them."""
    n = len(words) - WINDOW + 1
    if n < OFTEN:
        return []
    value = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    total, weight = np.zeros(n, np.uint64), 1
    for k in range(WINDOW):
        weight = weight * _STEP % (1 << 64)
        total += value[k : k + n] * np.uint64(weight)
    order = np.sort(total)
    often = order[OFTEN - 1 :] == order[: n - OFTEN + 1]
    if not often.any():
        return []
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(total, np.unique(order[: n - OFTEN + 1][often])))
    covered[at] += 1
    covered[at + WINDOW] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered) > 0).astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= MIN_LENGTH]


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text, given as words."""
    out = []
    for a, b in _segments(words):
        codes: dict[bytes, int] = {}
        numbers = [codes.setdefault(w, len(codes)) for w in words[a:b]]
        out += [(a + s, m, q) for s, m, q in segment_runs(numbers)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, m, q in runs:
        gone[start + q] += 1
        gone[start + m] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
    return b" ".join([words[i] for i in kept])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period; words count from 0), collapsed.

    ``rewrite(doc_id, words)`` may change the words before they are searched.
    """
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts, flat, offsets = [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if rewrite:
                    words = rewrite(doc, words)
                runs = text_runs(words)
                counts.append(len(words))
                texts.append(collapse(words, runs).decode())
                flat += runs
                offsets.append(len(flat))
            columns = [pa.array(x, pa.int64()) for x in zip(*flat)] if flat else [pa.array([], pa.int64())] * 3
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(C.tidied(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls if there is none), runs_sha256, collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * _best.length div -_best.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
