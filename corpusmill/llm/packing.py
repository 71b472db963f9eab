"""Operator 7, packing: first-fit decreasing with a tournament tree of bin capacities.

Each document is encoded (by the ``tokenizers`` library, with the caches of ``bpe``), ended
with an end id, and cut into full sequences and one rest.  A full sequence is finished.
Rests are dealt at random, by a hash of id and checksum, into groups of about GROUP_RESTS;
each group is packed on its own, so tasks stay small and even at any size, and the same
rests meet however the input is split.  Rests that repeat so often that they would fill a
group are dealt one by one.  A group sorts its rests by falling length and puts each into
the first bin with room.  The tournament tree holds the free room of the bins at
its leaves and the larger of two rooms above, so the first fit is one walk from
the root.  With thousands of rests a group, all but its last bins are full: padding
is about 0.02 to 0.2 % of the tokens.

Only descriptions of rests are shuffled (``with_ids`` adds the ids themselves).

Defined results.  Null and empty texts are one end id.  A document of ``k * 2048``
ids is ``k`` pieces; a very long text is many full sequences and one rest.  Rows with
equal or null ids are packed one by one.  Ties in length are ordered by id, then
checksum.  An empty table gives no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C
from corpusmill.llm.bpe import encoder

SEQUENCE = 2048
END_ID = 1
#: Rests of a group, on average.
GROUP_RESTS = 8192


class TournamentTree:
    """Free room of ``n`` bins; the leftmost bin with enough room in O(log n)."""

    def __init__(self, n: int, room: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin that fits, and return the bin."""
        best, i = self.best, 1
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        at = i
        best[i] -= size
        while i > 1:
            i //= 2
            a, b = best[2 * i], best[2 * i + 1]
            larger = a if a >= b else b
            if best[i] == larger:
                break
            best[i] = larger
        return at - self.leaves


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``; ``sizes`` must not rise and not exceed ``room``."""
    tree = TournamentTree(len(sizes), room)
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = tree.place(size)
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def _encode_rows(path: str, end_id: int, with_ids: bool, room: int):
    """The pieces of each document: full sequences and one rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, crc = encoder(path, library=True).encode, np.array([end_id], "<u4").tobytes(), zlib.crc32
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, room):
                    piece = ids[4 * start : 4 * (start + room)]
                    rows.append((doc, start, len(piece) // 4, crc(piece), total, piece if with_ids else None))
            doc, *rest = zip(*rows) if rows else ((),) * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def _pack_group(room: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes, group = table.column("length").to_pylist(), table.column("bucket")[0].as_py()
        bins = first_fit_decreasing(sizes, room)
        of, offset = [0] * len(sizes), [0] * len(sizes)
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                of[i], offset[i] = (group << 32) + k, at
                at += sizes[i]
        table = table.drop_columns("bucket")
        return table.append_column("sequence_id", pa.array(of, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = SEQUENCE, end_id: int = END_ID, group_rests: int = GROUP_RESTS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    Full sequences have negative numbers, packed ones from 0 on.
    """
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(C.tidied(_encode_rows(path, end_id, with_ids, room)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = C.materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == room).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    rests = pieces.filter(F.col("length") < room)
    same = F.xxhash64("doc_id", "start", "ids_crc32")
    often = group_rests // 8
    hot = C.materialize(rests.groupBy(same.alias("_same")).count().filter(F.col("count") > often).select("_same"), "hot-rests")  # at most rests / often
    groups = max(1, -(-rests.count() // group_rests))
    if n := hot.count():
        bits = C.log2_bits_for(n)
        rests = C.probe(rests.withColumn("_same", same), F.col("_same"), C.key_bitmap(hot, F.col("_same"), bits), bits, "_hot")
        alone = F.when(F.col("_hot"), F.col("row")).otherwise(0)
    else:
        alone = F.lit(0).cast("long")
    dealt = rests.withColumn("bucket", F.pmod(F.xxhash64(same, alone), F.lit(groups))).drop("_same", "_hot", "row")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    packed = dealt.groupBy("bucket").applyInArrow(_pack_group(room), schema).unionByName(full)
    return packed if with_ids else packed.drop("ids")


def assemble(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, tokens, ids, and where each document begins."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    seq = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return seq.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("tokens"), joined.alias("ids"), F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"], x["length"])).alias("pieces"))
