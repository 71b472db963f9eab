"""Operator 5, substring dedup by content-defined chunking with a gear hash.

Chunking.  A gear hash rolls over the bytes of a text, with a window of 16 bytes.
A chunk may start at a word start (in runs without white space, at a character),
and does start where the hash of the bytes before it is not larger than at the REACH
possible starts before and the REACH after it.  So boundaries
depend on nearby content alone: an insertion moves only the chunks it touches, and
two documents that share a passage share its chunks but those at its two ends.
Chunks have about seven words.

Dedup.  A document is an id and a text; the digest of the text tells apart those that
share an id.  Rows that repeat a document are combined to one, in each task before any shuffle,
and :func:`cut_spans` joins hot documents by broadcast, so copies of one document are no hot task.

1. Every document's distinct chunk hashes are counted.  Hashes met in two documents
   or more become a bitmap of bounded size, which is broadcast.
   Past FILTER_KEYS of them every document gets the list of its own instead, by a join on the
   hash, so that no more chunks pass than before.
2. Chunks that pass it (but a text's first or last one if it is shorter than all others
   can be, which would match by chance) are digested (128 bits) and grouped by digest.  The first
   document (smallest id, then text digest; null ids last) keeps a chunk; in other
   documents it is a repeat.  Digests that hold a large share of the rows are joined by
   broadcast.  Consecutive repeats of CANDIDATE_WORDS words or more are runs.
3. The chunks at the two ends of a shared passage lie half outside it and do not match.
   So each run is grown word by word: the words beside the kept chunk, CONTEXT of them at
   most, are fetched from the document that keeps it, once for all that ask, and held
   against the words beside the run.

Runs that then have MIN_WORDS words or more are spans to cut: exactly the shared words,
so a shared phrase, or the words between two edits of a near copy, is left.  (Repeats of
several earlier documents that stand side by side are one run.  A run is grown beside the
document that keeps its first or last chunk; where another one shares more words there, or
in a stretch of one word over and over, whose chunks have no content to begin at, a few
words can be missed.)  Only
documents that keep or hold a run's end are shuffled as text.

Defined results.  Null, empty and wordless texts have no chunks and no spans.  Rows
with one id and one text are one document, so repeats inside a document stay, and a null
id is an id like any other.  Texts of any length are taken whole, one at a time; a text
without white space is few words and never a span.  An empty table gives no spans.
Extra columns are carried through by :func:`cut_spans`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.llm import common as C

#: Possible chunk starts on each side that a start must beat.
REACH = 3
#: Words of a passage that is cut.
MIN_WORDS = 51
#: Words of a run of repeated chunks that is looked at, and words looked at on each side of it.
CANDIDATE_WORDS, CONTEXT = 12, 40
#: Bytes without white space after which every character may start a chunk.
LONG_WORD = 64
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 5) for b in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FLAT = bytes(32 if _SPACE[b] else b for b in range(256))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, ``h = (h << 1) + GEAR[byte]`` over the last 16 bytes, modulo 2**32."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def chunk_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which chunks start, the first non-space byte included, and the words in each."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    word = start.copy()
    if len(data) > LONG_WORD:
        at = np.arange(len(data))
        since = at - np.maximum.accumulate(np.where(space, at, -1))
        start |= (since > LONG_WORD) & ((data & 0xC0) != 0x80)
    places = np.flatnonzero(start)
    n = len(places)
    if not n:
        return places, places
    hashes = gear_hash(data)
    value = np.where(places > 0, hashes[places - 1], 0).astype(np.int64)
    padded = np.full(n + 2 * REACH, np.iinfo(np.int64).max)
    padded[REACH : REACH + n] = value
    cut = np.ones(n, bool)
    for d in range(1, REACH + 1):
        cut &= (value <= padded[REACH - d : REACH - d + n]) & (value <= padded[REACH + d : REACH + d + n])
    cut[0] = True
    chosen = np.flatnonzero(cut)
    words = np.add.reduceat(word[places].astype(np.int64), chosen)
    return places[chosen], words


def _chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Starts, words and contents of the chunks; any white space counts as a space, so a new line break moves nothing."""
    text = text.translate(_FLAT)
    starts, words = chunk_starts(text)
    ends = [*starts[1:].tolist(), len(text)]
    return starts, words, [text[a:b].rstrip(b" ") for a, b in zip(starts.tolist(), ends)]


def _hashes(named: bool = False):
    """The distinct chunk hashes of each document, ``named`` by its id and text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            hashes, sizes = [np.zeros(0, np.uint64)], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                own = {digest(c) for c in _chunks(text)[2]} if text else ()
                hashes.append(np.fromiter(own, np.uint64, len(own)))
                sizes.append(len(own))
            told = pa.array(np.concatenate(hashes).view(np.int64))
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([*([c.take(of) for c in batch.columns[:-1]] if named else []), told], [*(["doc_id", "text_hash"] if named else []), "hash"])

    return run


#: Of a chunk: its number, first and last place in code points, words up to it and with it, words after it.
_PLACES = ("ord", "start", "end", "from_word", "to_word", "after")


def _candidates(bits: object | None, log2_bits: int = 0):
    """Chunks whose hash is in the broadcast bitmap or, without one, in the document's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = np.frombuffer(bits.value if bits else b"", np.uint8), np.uint64((1 << log2_bits) - 1)
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                starts, words, chunks = _chunks(text)
                hashes = np.array([short(c) for c in chunks], np.uint64)
                if bits:
                    slot = hashes & mask
                    known = table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
                else:
                    known = np.isin(hashes.view(np.int64), batch.column(3)[doc].values.to_numpy()).astype(np.uint8)
                for end in (0, -1) if len(known) else ():
                    known[end] &= words[end] > REACH
                hit = np.flatnonzero(known)
                if not len(hit):
                    continue
                chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
                ends = np.r_[starts[1:], len(text)]
                first = chars[starts[hit]]
                last = np.where(ends[hit] < len(text), chars[np.minimum(ends[hit], len(text) - 1)], chars[-1] + 1)
                cols[0] += [doc] * len(hit)
                cols[1] += hit.tolist()
                cols[2] += first.tolist()
                cols[3] += last.tolist()
                until = np.cumsum(words)
                cols[4] += (until - words)[hit].tolist()
                cols[5] += until[hit].tolist()
                cols[6] += (until[-1] - until)[hit].tolist()
                cols[7] += [long(chunks[i]) for i in hit.tolist()]
            kinds, of = (*[pa.int64()] * 6, pa.binary()), pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], ["doc_id", "text_hash", *_PLACES, "digest"])

    return run


def _bitmap_bytes(bitmap: DataFrame, log2_bits: int) -> bytes:
    """The bounded bitmap (at most 16 MB) as one array."""
    out = np.zeros(1 << (log2_bits - 3), np.uint8)
    for row in bitmap.toLocalIterator():
        at = row["_block"] << 12
        out[at : at + 4096] = np.frombuffer(row["_bits"], np.uint8)
    return out.tobytes()


def words_before(text: str, at: int, most: int = CONTEXT) -> list[re.Match]:
    """The last words that end before ``at``, as matches in ``text``; looks back only as far as it must."""
    size = 16 * most
    while True:
        low = max(0, at - size)
        found = list(_WORD.finditer(text, low, at))
        if low == 0 or len(found) > most:  # the first word of a part may be cut off
            return found[-most:]
        size *= 2


def words_after(text: str, at: int, most: int = CONTEXT) -> list[re.Match]:
    out = []
    for m in _WORD.finditer(text, at):
        out.append(m)
        if len(out) == most:
            break
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document's list of places asked for: the words before (side 0) or after (side 1)."""
    for batch in batches:
        docs, cols = [], ([], [], [], [])
        for doc, (text, asks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            for ask in asks:
                near = (words_after if ask["side"] else words_before)(text, ask["place"])
                docs.append(doc)
                for col, x in zip(cols, (ask["place"], ask["side"], ask["n"], " ".join([m[0] for m in near]))):
                    col.append(x)
        of = pa.array(docs, pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["kept_id", "kept_hash", "place", "side", "n", "near"])


def grow(text: str, run: dict, near: dict[int, str]) -> tuple[int, int, int]:
    """Start, end and words of a run, grown by the words equal to those ``near`` the kept chunks (by side)."""
    start, end, words = run["start"], run["end"], run["words"]
    if near.get(0) and _SPACE_CHARS.issuperset(text[start - 1 : start]):
        for m, other in zip(reversed(words_before(text, start)), reversed(near[0].split(" "))):
            if m[0] != other:
                break
            start, words = m.start(), words + 1
    if near.get(1) and _SPACE_CHARS.issuperset(text[end - 1 : end]):
        for m, other in zip(words_after(text, end), near[1].split(" ")):
            if m[0] != other:
                break
            end, words = m.end(), words + 1
        if end > run["end"]:  # as chunks do, a span goes up to the next word
            follow = words_after(text, end, 1)
            end = follow[0].start() if follow else len(text)
    return start, end, words


_SPACE_CHARS = frozenset(" \t\n\r\x0b\x0c")
_RUN = ("start", "end", "words", "n_chunks", "kept_doc_ids")


def _grown(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, cols = [], ([], [], [], [], [])
            for doc, (text, asks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                runs: dict[int, tuple[dict, dict]] = {}
                for ask in asks:
                    runs.setdefault(ask["start"], (ask, {}))[1][ask["side"]] = ask["near"]
                for one, near in runs.values():
                    docs.append(doc)
                    for col, x in zip(cols, (*grow(text, one, near), one["n_chunks"], one["kept_doc_ids"])):
                        col.append(x)
            of = pa.array(docs, pa.int64())
            kinds = (*[pa.int64()] * 4, pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "text_hash", *_RUN])

    return run


def _one_row_each(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, text) with one row for each document; the rows of a repeated one are combined before they are shuffled."""
    key = ["doc_id", "text_hash"]
    twice = C.materialize(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "repeated-rows")
    n = twice.count()
    if not n:
        return rows
    bits = C.log2_bits_for(n)
    marked = C.probe(rows, F.xxhash64(*key), C.key_bitmap(twice, F.xxhash64(*key), bits), bits, "_twice")
    once = C.materialize(marked.filter("_twice").groupBy(*key).agg(F.first("text").alias("text")), "one-row-each")
    return marked.filter("NOT _twice").select(*key, "text").unionByName(once)


def _shared_chunks(rows: DataFrame, schema: str, kind: str) -> DataFrame:
    """Chunks whose hash two documents or more have (and, by the filter, a few others)."""
    spark = rows.sparkSession
    met = rows.select("text").mapInArrow(C.tidied(_hashes()), "hash long").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    shared = C.materialize(met, "chunk-hashes")
    n = shared.count()
    if n <= C.FILTER_KEYS:
        bits = C.log2_bits_for(n)
        flags = spark.sparkContext.broadcast(_bitmap_bytes(C.key_bitmap(shared, F.col("hash"), bits), bits))
        return rows.mapInArrow(C.tidied(_candidates(flags, bits)), schema)
    # a filter would clear too little: each document gets the list of its shared hashes, joined by hash
    own = rows.mapInArrow(C.tidied(_hashes(named=True)), f"doc_id {kind}, text_hash long, hash long")
    total = shared.agg(F.sum("n")).first()[0]
    known = C.join_unique(own, shared, ["hash"], "n", total, keep_unmatched=False)
    lists = C.materialize(known.groupBy("doc_id", "text_hash").agg(F.collect_list("hash").alias("known")), "chunk-lists")
    told = C.with_lists(rows, lists, lists.count(), ["doc_id", "text_hash"])
    return told.select("doc_id", "text_hash", "text", "known").mapInArrow(C.tidied(_candidates(None)), schema)


def _runs(rows: DataFrame, kind: str) -> DataFrame:
    """Runs of repeated chunks: doc_id, text_hash, start, end, words, n_chunks, kept_doc_ids, and at each end the kept place (null: none to look at)."""
    schema = f"doc_id {kind}, text_hash long, {', '.join(f'{p} long' for p in _PLACES)}, digest binary"
    found = C.materialize(_shared_chunks(rows, schema, kind), "chunk-candidates")
    doc = (F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    groups = found.groupBy("digest").agg(F.min(F.struct(*doc, "start", "end")).alias("kept"), F.max(F.struct(*doc)).alias("last"), F.count("*").alias("n"))
    several = ~(F.col("kept.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("kept.text_hash") == F.col("last.text_hash")))
    groups = C.materialize(groups.filter(several).select("digest", "n", F.struct(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"), F.col("kept.start").alias("start"), F.col("kept.end").alias("end")).alias("kept")), "chunk-groups")
    repeats = C.join_unique(found, groups, ["digest"], "n", found.count(), keep_unmatched=False)
    repeats = repeats.filter(~(F.col("doc_id").eqNullSafe(F.col("kept.kept_id")) & (F.col("text_hash") == F.col("kept.kept_hash")))).drop("digest", "n")
    order = Window.partitionBy("doc_id", "text_hash").orderBy("ord")
    runs = repeats.withColumn("run", F.col("ord") - F.dense_rank().over(order)).groupBy("doc_id", "text_hash", "run")
    place = lambda side, at: F.struct(F.lit(side).alias("side"), F.col("kept.kept_id").alias("kept_id"), F.col("kept.kept_hash").alias("kept_hash"), F.col(f"kept.{at}").alias("place"))
    made = runs.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to_word") - F.min("from_word")).alias("words"), (F.max("ord") - F.min("ord") + 1).alias("n_chunks"),
        F.sort_array(F.collect_set("kept.kept_id")).alias("kept_doc_ids"), F.min("from_word").alias("before"), F.min("after").alias("after"),
        F.min_by(place(0, "start"), "ord").alias("left"), F.max_by(place(1, "end"), "ord").alias("right"),
    )
    ends = F.array_compact(F.array(F.when(F.col("before") > 0, F.col("left")), F.when(F.col("after") > 0, F.col("right"))))
    return made.filter(F.col("words") >= CANDIDATE_WORDS).select("doc_id", "text_hash", *_RUN, ends.alias("ends"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Spans that repeat an earlier document: doc_id, text_hash, start, end (code points), n_words, n_chunks, kept_doc_ids.

    ``text_hash`` is ``xxhash64`` of the text.
    """
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    kind = docs.schema[id_col].dataType
    name = kind.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = _one_row_each(rows)
    runs = C.materialize(_runs(rows, name), "runs")
    asked = runs.filter(F.size("ends") > 0).select("doc_id", "text_hash", *_RUN, F.explode("ends").alias("e")).select("*", "e.*").drop("e")
    key = ["kept_id", "kept_hash", "place", "side"]
    each = asked.groupBy(*key).agg(F.count("*").alias("n"))
    asks = C.materialize(each.groupBy(F.col("kept_id").alias("doc_id"), F.col("kept_hash").alias("text_hash")).agg(F.collect_list(F.struct("place", "side", "n")).alias("asks")), "asks")
    told = C.with_lists(rows, asks, asks.count(), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "asks")
    near = told.mapInArrow(C.tidied(_contexts), f"kept_id {name}, kept_hash long, place long, side int, n long, near string").dropDuplicates(key)
    near = C.materialize(near, "contexts")
    found = C.join_unique(asked, near, key, "n", asked.count(), keep_unmatched=False)
    lists = C.materialize(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*_RUN, "side", "near")).alias("asks")), "ends")
    open_ = C.with_lists(rows, lists, lists.count(), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "asks")
    schema = f"doc_id {name}, text_hash long, start long, end long, words long, n_chunks long, kept_doc_ids array<{name}>"
    grown = open_.mapInArrow(C.tidied(_grown(to_arrow_type(kind))), schema)
    both = grown.unionByName(runs.filter(F.size("ends") == 0).drop("ends")).filter(F.col("words") >= min_words)
    return both.dropDuplicates(["doc_id", "text_hash", "start", "end"]).withColumnRenamed("words", "n_words")


def cut_text(text: str, spans: list[dict]) -> str:
    """The text without the spans, which are sorted by start."""
    parts, at = [], 0
    for span in spans:
        parts.append(text[at : span["start"]])
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [cut_text(t, s) if t and s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_text"])


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of the texts they were found in; documents of which no word is left are dropped.

    Only documents with a span are shuffled.  All columns stay; ``n_chars`` follows the text if it is there.
    """
    C.ship(docs.sparkSession)
    key = ["_id", "_hash"]
    lists = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    lists = C.materialize(lists, "spans")
    n = lists.count()
    if not n:
        return docs
    rows = docs.select(C.boxed(docs), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    sized = C.row_counts(rows.select(*key), lists, n, key)
    held = C.with_lists(rows, sized, n, key, keep_rest=True, size="copies", total=sized.agg(F.sum("copies")).first()[0])
    hit = held.filter("_spans IS NOT NULL").select("_row", F.col("_row").getField(text_col).alias("_text"), "_spans")
    done = hit.mapInArrow(C.tidied(_cut), T.StructType([hit.schema["_row"], hit.schema["_text"]])).filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    done = done.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
    return C.unboxed(held.filter("_spans IS NULL"), docs.columns).unionByName(done)
