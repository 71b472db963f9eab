"""Operator 1, exact dedup: progressive refinement, native expressions only.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.

1. One scan leaves a sketch ``(length, prefix hash)`` per row.  Lengths that
   occur once are finished.
2. Of the rows left, prefixes that occur once (within their length) are finished.
3. Only rows that share length and prefix have their full content hashed and
   are shuffled, as digests; text never is.

The prefix is hashed in the scan that measures the length, for all rows: a second
read of the texts would cost more than it saves.  The survivors of each step are a
bitmap of bounded size (``common.key_bitmap``).  It can only pass too many rows, never
too few; step 3 compares full digests.  Pairs past ``common.FILTER_KEYS`` are more than
such a bitmap can tell apart: then all rows go to step 3, whose cost is one digest and
one narrow shuffled row each.

Groups of any size are combined before the shuffle, and what is decided about a hot
group is broadcast back to its rows (``common.join_unique``).

Defined results.  Null text counts as empty, and all empty texts are one group.
Texts of any length are compared whole.  Of equal texts the row with the most code
points stays, then the smallest ``doc_id`` (null last).  Rows that repeat both id and
text are all returned and counted, one of them is kept; :func:`drop_duplicates` keeps
the one that is smallest as JSON, so a rerun keeps the same.  An empty table gives no
rows.  Extra columns are ignored here and carried through by :func:`drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

#: Code points of the normalised text in the second step's hash.
PREFIX_CHARS = 256


def normalised(col: str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = C.text_of(col)
    for space in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _refine(docs: DataFrame, text_col: str, prefix_chars: int) -> tuple[DataFrame, int] | None:
    """Steps 1 and 2: the bitmap of ``(length, prefix hash)`` pairs with two rows or more, and its bits; None if they are too many."""
    body = docs.select(normalised(text_col).alias("body"))
    sketch = C.materialize(body.select(F.length("body").alias("len"), F.xxhash64(F.left("body", F.lit(prefix_chars))).alias("prefix")), "dedup-sketch")
    lengths = C.materialize(sketch.groupBy("len").count().filter("count > 1").select("len"), "dedup-lengths")
    bits = C.log2_bits_for(lengths.count())  # lengths are few: at most that of the longest text
    left = C.probe(sketch, F.xxhash64("len"), C.key_bitmap(lengths, F.xxhash64("len"), bits), bits, "alive").filter("alive")
    pairs = C.materialize(left.groupBy("len", "prefix").count().filter("count > 1").select("len", "prefix"), "dedup-prefixes")
    n = pairs.count()
    bits = C.log2_bits_for(n)
    return None if n > C.FILTER_KEYS else (C.key_bitmap(pairs, F.xxhash64("len", "prefix"), bits), bits)


def _alive(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """``docs`` with ``_body``, ``_len`` and ``_alive``, true where the full content must be compared."""
    found = _refine(docs, text_col, prefix_chars)
    wide = docs.withColumn("_body", normalised(text_col)).withColumn("_len", F.length("_body"))
    if found is None:
        return wide.withColumn("_alive", F.lit(True))
    return C.probe(wide, F.xxhash64(F.col("_len"), F.xxhash64(F.left("_body", F.lit(prefix_chars)))), *found, "_alive")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, n_chars.

    ``digest`` is the binary SHA-256 of the normalised text; null for rows that
    were finished before step 3, unless ``digest_all`` asks for it.
    """
    rows = _alive(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", prefix_chars)
    sha = F.unhex(F.sha2("_body", 256))
    alive, digest = F.col("_alive").alias("alive"), sha if digest_all else F.when(F.col("_alive"), sha)
    full = rows.select("doc_id", F.length(C.text_of()).alias("n_chars"), F.col("_len").alias("len"), alive, digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    full = C.materialize(full, "dedup-digests")  # with the row's number, which from here on stays
    left = full.filter("alive")
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = left.groupBy("digest", "len").agg(F.count("*").alias("group_size"), F.min(best).alias("best")).filter("group_size > 1")
    groups = C.materialize(groups.select("digest", "len", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "dedup-groups")
    joined = C.join_unique(left, groups, ["digest", "len"], "group_size", left.count())
    alone = F.col("group_size").isNull()
    decided = joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
        "n_chars",
    )
    rest = full.filter("NOT alive").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "n_chars")
    return decided.unionByName(rest)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and one row of each group of equal texts.

    Losers are dropped by ``(id, digest)``, so one id with two texts is safe.  Of
    rows that repeat the winner's id and text, one stays.
    """
    found = exact_duplicates(docs, id_col, text_col)
    decided = C.materialize(found.filter("group_size > 1").groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")), "dedup-decided")
    key = {"doc_id": F.col(id_col), "digest": F.unhex(F.sha2(normalised(text_col), 256))}
    size = decided.agg(F.count(F.when(~F.col("kept") | (F.col("copies") > 1), 1)).alias("gone"), F.count(F.when(F.col("kept") & (F.col("copies") > 1), 1)).alias("again"), F.coalesce(F.sum("copies"), F.lit(0)).alias("total")).first()
    out = C.drop_keys(docs, decided.filter("NOT kept OR copies > 1").select("doc_id", "digest", "copies"), size["gone"], key, size["total"])
    if not size["again"]:
        return out
    wide = docs.select(C.boxed(docs), F.length(C.text_of(text_col)).alias("_chars"), *[e.alias(k) for k, e in key.items()])
    wide = C.with_lists(wide, decided.filter("kept AND copies > 1").select("doc_id", "digest", "copies"), size["again"], ["doc_id", "digest"], False, "copies", size["total"])
    # of different originals with equal normalised text the longest stays; combined before the shuffle
    one = wide.groupBy("doc_id", "digest").agg(F.min_by("_row", F.struct(-F.col("_chars"), F.to_json("_row"))).alias("_row"))
    return out.unionByName(C.unboxed(one, docs.columns))
