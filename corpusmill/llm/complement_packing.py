"""Operator 11, best-fit packing by exact complements.

Each document is encoded with a byte-level BPE vocabulary of the ``tokenizers`` library and
ended with an end id.  Longer ones are cut into full sequences, the first piece taking what
is left over.  Only lengths matter for packing, and there are fewer than ``room`` of them,
so the plan is made from the table of counts by length, whatever the number of documents:

* bit sets index the lengths that are left, their pair sums and their triple sums;
* from the largest length down, a sequence takes the length, pair or triple that fills its
  gap exactly, or the largest length that fits and then looks again.  A combination is taken
  as often as the counts of its lengths allow, which uses up at least one of them;
* lengths for which nothing fills the gap are placed by best fit, largest first, in the
  sequence with the smallest gap that takes them, whole classes of equal sequences at a time.

Where best fit alone needs fewer sequences (some tens of documents, scarce small ones), its plan is taken.

The plan is a few thousand rows.  Pieces are then numbered within their length, in parallel
(a length with very many pieces is dealt into groups by a hash, and the groups' sizes give
each its first number), and a piece's number says its place in the plan.  Only descriptions
of pieces are shuffled, once (``with_ids`` adds the ids themselves).

The encoder keeps a bounded cache of words.  A text is cut before spaces and line breaks at
which the vocabulary's pattern always cuts, so a part has the same ids anywhere.  Parts with
characters beyond U+00FF, long parts and texts with special tokens go to the library.

Defined results.  Null and empty texts are one end id.  A document of ``k * room`` ids is
``k`` pieces.  Rows with equal or null ids are packed one by one, and each numbers its own
pieces.  Ties in length are ordered by id, start, checksum.  An empty table gives no pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import common as C

ROOM = 2048
END_ID = 0
#: Pieces of one length that are numbered together, at least, and the number of such groups at most (besides one a length).
GROUP_ROWS, GROUPS = 1024, 100_000
#: Parts kept in each half of a worker's cache, and the longest part that is kept or left to the fast encoder.
CACHE_ENTRIES, CACHE_BYTES, LONG_BYTES = 300_000, 48, 4096
#: A space or line break that is not followed by a character that surely is no white space.
_ODD = re.compile(rb"[ \n](?![!-~\xc3])")
_CUT = re.compile(rb" (?=[!-~\xc3])")
#: Fixed value: the pattern of the byte-level pre-tokenizer.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder(dict):
    """Ids of whole texts under a byte-level BPE file; as a dictionary, the cache of parts."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("this encoder needs byte-level BPE without a normalizer")
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        byte_of = {chr(b) if b in own else chr(next(rest)): b for b in range(256)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        for n, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if model["vocab"][left + right] != 256 + n:
                raise ValueError("this encoder needs ids in the order of the merges")
        fast = tiktoken.Encoding("parts", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.single = fast.encode_ordinary, fast._encode_single_piece
        self.marks = {m: array("I", self.ordinary(m.decode())).tobytes() for m in (b".", b",", b";", b":", b"!", b"?")}
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(special, key=len, reverse=True))) if special else None

    def _ids(self, text: str) -> bytes:
        if len(text) <= LONG_BYTES and (text.isascii() or max(text) <= "\xff"):
            return array("I", self.ordinary(text)).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: bytes) -> bytes:
        """A part that begins with a line break stands for itself, any other for itself after a space."""
        found = self.old.get(part)
        if found is None:
            text = part.decode()
            word = text[:-1] if part[-1:] in self.marks else text
            if len(part) <= CACHE_BYTES and word.isalpha() and (word.isascii() or max(word) <= "\xff"):  # one piece of the pattern, and a mark
                found = self[word.encode()] + self.marks[part[-1:]] if len(word) < len(text) else array("I", self.single(b" " + part)).tobytes()
            else:
                found = self._ids(text if part[:1] == b"\n" else " " + text)
        if len(part) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.special and b"<" in text and self.special.search(text):
            return array("I", self.library.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        first, *parts = _CUT.split(text) if _ODD.search(text) else text.replace(b"\n", b" \n").split(b" ")
        return self._ids(first.decode()) + b"".join([self[p] for p in parts])


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


class SumIndex:
    """How many pieces of each length are left, and as bit sets the lengths, pair sums and triple sums."""

    def __init__(self, counts: dict[int, int], room: int) -> None:
        self.left, self.room, self.mask = Counter(counts), room, (1 << (room + 1)) - 1
        self._index()

    def _index(self) -> None:
        """Sums of two and three lengths, equal ones included; :meth:`fill` checks the counts."""
        self.lengths = sorted((n for n, c in self.left.items() if c > 0), reverse=True)
        self.one = sum(1 << n for n in self.lengths)
        two = three = 0
        for n in self.lengths:
            two |= self.one << n
        self.two = two & self.mask
        for n in self.lengths:
            three |= self.two << n
        self.three = three & self.mask

    def take(self, pattern: Counter, times: int) -> None:
        ended = False
        for n, k in pattern.items():
            self.left[n] -= k * times
            ended |= not self.left[n]
        if ended:
            self._index()

    def largest(self, at_most: int) -> int:
        """The largest length left, 0 if none is small enough."""
        return max(0, (self.one & ((1 << (at_most + 1)) - 1)).bit_length() - 1)

    def fill(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is ``gap`` and of which enough are left; larger lengths first."""

        def enough(*more: int) -> bool:
            return all(self.left[n] - used[n] >= more.count(n) for n in more)

        if self.one >> gap & 1 and enough(gap):
            return (gap,)
        small = [n for n in self.lengths if n < gap]
        if self.two >> gap & 1:
            for a in small:
                if 2 * a < gap:
                    break
                if self.one >> (gap - a) & 1 and enough(a, gap - a):
                    return a, gap - a
        if self.three >> gap & 1:
            for a in small:
                if 3 * a < gap:
                    break
                if self.two >> (gap - a) & 1:
                    for b in small:
                        c = gap - a - b
                        if b > a or c > b or c < 1:
                            if c > b:
                                break
                            continue
                        if self.one >> c & 1 and enough(a, b, c):
                            return a, b, c
        return None


def exact_patterns(counts: dict[int, int], room: int) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """Combinations that fill a sequence exactly, each with its number of sequences; and the counts of what is left over."""
    index, plan, rest = SumIndex(counts, room), [], {}
    while index.lengths:
        top = index.lengths[0]
        pattern, gap = Counter([top]), room - top
        while gap:
            found = index.fill(gap, pattern)
            if found:
                pattern.update(found)
                gap = 0
                break
            n = index.largest(gap)
            while n and index.left[n] <= pattern[n]:
                n = index.largest(n - 1)
            if not n:
                break
            pattern[n] += 1
            gap -= n
        if gap:
            rest[top] = index.left[top]
            index.take(Counter([top]), index.left[top])
        else:
            times = min(index.left[n] // k for n, k in pattern.items())
            plan.append((pattern, times))
            index.take(pattern, times)
    return plan, rest


def best_fit(counts: dict[int, int], room: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts: ``(lengths, number of sequences)``.

    Equal pieces go to the tightest gap until it takes no more, so sequences with equal
    contents stay one class but for the last one, which may get fewer.
    """
    classes: dict[int, list[list]] = {}  # by gap: [pattern, number]
    for n in sorted(counts, reverse=True):
        left = counts[n]
        for gap in sorted(g for g in classes if g >= n):
            k = gap // n
            while left and classes.get(gap):
                pattern, number = classes[gap].pop()
                some = min(number, left // k)
                parts = [(k, some), (left - k * some, 1 if some < number and left > k * some else 0), (0, number - some - (1 if some < number and left > k * some else 0))]
                for each, of in parts:
                    if of:
                        classes.setdefault(gap - each * n, []).append([pattern + Counter({n: each}), of])
                        left -= each * of
            if not left:
                break
        if left:
            k = room // n
            for each, of in ((k, left // k), (left % k, 1)):
                if each and of:
                    classes.setdefault(room - each * n, []).append([Counter({n: each}), of])
    return [(pattern, of) for same in classes.values() for pattern, of in same]


def plan_sequences(counts: dict[int, int], room: int) -> list[tuple[Counter, int]]:
    """Exact combinations, then best fit; where small lengths are so scarce that best fit alone takes fewer sequences, that."""
    exact, rest = exact_patterns(counts, room)
    return min(exact + best_fit(rest, room), best_fit(counts, room), key=lambda plan: sum(of for _, of in plan))


def _plan_table(counts: dict[int, int], room: int) -> tuple[dict[int, int], dict[str, np.ndarray]]:
    """The first number of each length, and the plan by numbers: where a stretch of pieces begins, how many a sequence takes, its first sequence and offset."""
    base, at = {}, 0
    for n in sorted(counts):
        base[n], at = at, at + counts[n]
    stretches, now, sequence = [], dict(base), 0
    for pattern, of in plan_sequences(counts, room):
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            stretches.append((now[n], k, sequence, offset, n))
            now[n] += k * of
            offset += k * n
        sequence += of
    stretches.sort()
    names = ("begin", "each", "sequence", "offset", "length")
    return base, {name: np.array(col, np.int64) for name, col in zip(names, zip(*stretches) if stretches else [()] * 5)}


def _encode_rows(path: str, end_id: int, with_ids: bool, room: int):
    """The pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, crc = encoder(path).encode, np.array([end_id], "<u4").tobytes(), zlib.crc32
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                begins = [0, *range(total % room or room, total, room)]
                for piece, (a, b) in enumerate(zip(begins, [*begins[1:], total])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, piece, a, b - a, crc(part), part if with_ids else None))
            doc, *rest = zip(*rows) if rows else ((),) * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _place(plan: dict[str, np.ndarray]):
    """Sequence and offset of numbered pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            at = np.searchsorted(plan["begin"], number, "right") - 1
            nth, each = number - plan["begin"][at], plan["each"][at]
            kept = [c for c in batch.schema.names if c != "number"]
            more = [pa.array(plan["sequence"][at] + nth // each), pa.array(plan["offset"][at] + nth % each * plan["length"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end_id: int = END_ID, with_ids: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    Full pieces are sequences with negative numbers, packed ones count from 0.
    """
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(C.tidied(_encode_rows(path, end_id, with_ids, room)), schema)
    pieces = C.materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "complement-pieces")
    full = pieces.filter(F.col("length") == room).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    rests = pieces.filter(F.col("length") < room)
    counts = {r[0]: r[1] for r in rests.groupBy("length").count().collect()}  # fewer than room rows
    base, plan = _plan_table(counts, room)
    together = max(group_rows, sum(counts.values()) // GROUPS)
    lengths = spark.createDataFrame([(n, -(-counts[n] // together), base[n]) for n in counts], "length long, groups long, base long")
    hashed = F.xxhash64("doc_id", "start", "ids_crc32", "row")
    dealt = rests.join(F.broadcast(lengths), "length").withColumn("group", F.pmod(hashed, F.col("groups")))
    sizes = dealt.groupBy("length", "group", "base").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    first = C.materialize(sizes.select("length", "group", (F.col("base") + F.coalesce(before, F.lit(0))).alias("first")), "complement-groups")  # at most GROUPS + room rows
    nth = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "start", "ids_crc32", "row"))
    numbered = dealt.join(F.broadcast(first), ["length", "group"]).withColumn("number", F.col("first") + nth - 1)
    placed = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "number").mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")
    packed = placed.unionByName(full)
    return packed if with_ids else packed.drop("ids")
