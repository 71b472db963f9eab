"""Operator 13, the prefix trie of conversations, by partition refinement.

Texts are read once and give a digest and a length each; only those are shuffled.  Turns are
numbered over tasks, so a conversation of any length is spread.  Conversations with equal turns
throughout are one sequence with a number of copies, found by summed digests (128 bits).

Refinement starts with one class of all sequences.  In each round a class looks at the next turn
of its members and splits by it; a class of one sequence retires, and its tail is one
unary chain.  A class that has gone several turns without a split looks two turns ahead at once, then
four, and so on, and goes back to half as many when its members differ, so a long common
stretch takes a logarithmic number of rounds.  Members are joined to their new class with
hot classes sent by broadcast (``common.join_unique``).  Every round is written to the shared
folder; the driver sees counts only.

The result of a round is a set of chains: a class's smallest member, the turns that the chain
covers, the chain above.  They are folded back from the last round to the first: leaves and
saved tokens of a chain are sums over the chains below it.  Then each chain is spread over its turns.

Digests of members read their ids in order: ids are first joined to blocks of text within ranges, in
parallel, and one pass a group then hashes the blocks as they come, one in memory at a time.

Defined results.  Null role and text are empty.  Turns are ordered by turn, null first; ties by
role, then by the text's digest.  Repeated rows are turns of their own.  Rows with a null
conversation id belong to no conversation and make no node.  Texts and conversations of any length are
taken whole.  An empty table gives no node, not even a root.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import common as C
from corpusmill.operators.compile import number_parts

#: Turns that a class goes one by one without a split before it looks further ahead; the furthest look is 2 ** LOOK turns.
CALM, LOOK = 4, 16
#: Turns of a chain that are summed together; ids whose text is one block.
BLOCK, IDS = 1024, 10_000


def numbered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``key`` (digest of role and text), ``chars``, of rows ``conv_id, turn, role, text``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    read = rows.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn"), role.alias("role"), key.alias("key")).alias("_order"), F.length(text).cast("long").alias("chars"))
    return number_parts(read, "conv_id", "_order").select("conv_id", F.col("part").alias("pos"), F.col("_order.key").alias("key"), "chars")


def _sum_of(key: Column, pos: Column) -> list[Column]:
    """128 bits of a set of turns at their places."""
    return [F.bit_xor(F.xxhash64(key, pos)).alias("x"), F.bit_xor(F.xxhash64(pos, key, F.lit(1))).alias("y")]


def sequences(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences ``c`` (smallest conversation), ``turns``, ``copies``; and the conversations of each: ``c, conv_id, copies``."""
    told = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), *_sum_of(F.col("key"), F.col("pos")))
    none = F.lit(0).cast("long")
    told = C.materialize(conversations.select("conv_id").distinct().join(told, "conv_id", "left").select("conv_id", *[F.coalesce(n, none).alias(n) for n in ("turns", "x", "y")]), "trie-conversations")
    same = C.materialize(told.groupBy("turns", "x", "y").agg(F.min("conv_id").alias("c"), F.count("*").alias("copies")), "trie-sequences")
    members = C.join_unique(told, same.filter("copies > 1"), ["turns", "x", "y"], "copies", told.count(), keep_unmatched=False)
    return same.select("c", "turns", "copies"), members.select("c", "conv_id", "copies")


def _look() -> Column:
    """Turns that a class looks ahead after ``calm`` turns or looks without a split."""
    return F.expr(f"shiftleft(1L, cast(least(greatest(calm - {CALM - 1}, 0), {LOOK}) as int))")


def _read(tables: list[DataFrame]) -> DataFrame:
    """Tables of :func:`common.materialize` with one schema, read by one scan."""
    paths = sorted({f.rpartition("/")[0] for t in tables for f in t.inputFiles()})
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths) if paths else tables[0]


def _refine(turns: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """All chains with their ``round`` (0: the root's); where sequences end above a leaf (``c, node, depth``); the number of rounds.

    A chain is ``c, low, high, up, up_low, n_convs``: nodes of class ``c`` at depths low + 1 to high, below chain ``(up, up_low)``.
    """
    spark, kind = turns.sparkSession, seqs.schema["c"].dataType.simpleString()
    whole = seqs.agg(F.min("c").alias("c"), F.sum("copies").alias("n_convs"), F.count("*").alias("n")).first()
    zero = F.lit(0).cast("long")
    root = spark.createDataFrame([(whole["c"], -1, 0, None, None, whole["n_convs"], 0)], f"c {kind}, low long, high long, up {kind}, up_low long, n_convs long, round int")
    if whole["n"] == 1:
        tail = seqs.filter("turns > 0").select("c", zero.alias("low"), F.col("turns").alias("high"), F.col("c").alias("up"), F.lit(-1).cast("long").alias("up_low"), F.col("copies").alias("n_convs"), F.lit(1).alias("round"))
        return C.materialize(root.unionByName(tail), "trie-chains"), seqs.filter("turns = 0").select("c", F.col("c").alias("node"), zero.alias("depth")), 2
    active = seqs.withColumns({"class": F.lit(whole["c"]).cast(kind), "at": zero, "calm": zero, "low": F.lit(-1).cast("long")})
    span, n, rounds = (0, 1), whole["n"], []
    whole_, split = "parts = 1 AND met = look", "(parts > 1 OR met < look) AND look = 1"
    of = ["class", "at", "met", "x", "y"]
    while n:
        ahead = turns.filter((F.col("pos") > span[0]) & (F.col("pos") <= span[1])).select(F.col("conv_id").alias("_c"), "pos", "key")
        here = active.withColumn("look", _look())
        next_ = here.select(F.col("c").alias("_c"), "at", "look")
        seen = ahead.join(next_, "_c").filter("pos > at AND pos <= at + look").groupBy("_c").agg(F.count("*").alias("met"), *_sum_of(F.col("key"), F.col("pos")))
        here = C.materialize(here.join(seen, here["c"] == seen["_c"], "left").drop("_c").withColumns({k: F.coalesce(k, zero) for k in ("met", "x", "y")}), "trie-ahead")
        parts = here.groupBy(*of, "calm", "low", "look").agg(F.min("c").alias("first"), F.count("*").alias("members"), F.sum("copies").alias("n_convs"), F.max("turns").alias("end"))
        kinds = parts.groupBy("class").agg(F.count("*").alias("parts"))
        parts = C.materialize(parts.join(kinds, "class").withColumn("round", F.lit(len(rounds) + 1)), "trie-parts")
        rounds.append(parts)
        fate = parts.select(*of, "members", "first", F.when(F.expr(whole_), "on").when(F.expr(split), "split").otherwise("back").alias("fate")).filter("fate <> 'split' OR members > 1")
        kept = C.join_unique(here.drop("first"), fate, of, "members", n, keep_unmatched=False)
        on, back = F.col("fate") == "on", F.col("fate") == "back"
        active = C.materialize(
            kept.select(
                "c", "turns", "copies",
                F.when(on | back, F.col("class")).otherwise(F.col("first")).alias("class"),
                F.when(back, F.col("at")).when(on, F.col("at") + F.col("look")).otherwise(F.col("at") + 1).alias("at"),
                F.when(back, F.col("calm") - 1).when(on, F.least(F.col("calm") + 1, F.lit(CALM + LOOK))).otherwise(0).cast("long").alias("calm"),
                F.when(back, F.col("low")).otherwise(F.col("at")).alias("low"),
            ),
            "trie-active",
        )
        n, *span = active.agg(F.count("*"), F.min("at"), F.max(F.col("at") + _look())).first()
    every = _read(rounds)
    high = F.when(F.col("look") > 1, F.col("at") + F.col("look")).when(F.col("members") == 1, F.col("end")).otherwise(F.col("at") + 1)
    made = every.filter(f"({whole_}) OR ({split} AND met = 1)").select(F.col("first").alias("c"), F.col("at").alias("low"), high.alias("high"), F.col("class").alias("up"), F.col("low").alias("up_low"), "n_convs", "round")
    ended = every.filter(f"{split} AND met = 0").select(F.col("first").alias("c"), F.col("class").alias("node"), F.col("at").alias("depth"))
    return C.materialize(root.unionByName(made), "trie-chains"), ended, len(rounds) + 1


def _fold(chains: DataFrame, rounds: int, own: DataFrame) -> DataFrame:
    """``c, low, n_below`` (chains below), ``leaves``, ``below`` (tokens saved below): sums from the last round to the first."""
    done: list[DataFrame] = []
    for r in range(rounds - 1, -1, -1):
        rows = chains.filter(F.col("round") == r).select("c", "low", "up", "up_low")
        if done:
            under = _read(done).filter("up IS NOT NULL").groupBy(F.col("up").alias("c"), F.col("up_low").alias("low")).agg(F.count("*").alias("n_below"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
            rows = rows.join(under, ["c", "low"], "left")
        else:
            rows = rows.withColumns({k: F.lit(None).cast("long") for k in ("n_below", "leaves", "below")})
        rows = rows.join(own, ["c", "low"], "left").withColumns({"n_below": F.coalesce("n_below", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "below": F.coalesce("below", F.lit(0))})
        done.append(C.materialize(rows.withColumn("saved", F.col("below") + F.coalesce("saved", F.lit(0))), "trie-fold"))
    return _read(done).select("c", "low", "n_below", "leaves", "below")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``c, conv_id`` to blocks ``c, first, ids``."""
    now, first, ids = None, None, []

    def block() -> tuple:
        return now, first, ",".join(map(str, ids))

    for batch in batches:
        out = []
        for c, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (c != now or len(ids) >= IDS):
                out.append(block())
                ids = []
            if not ids:
                now, first = c, conv
            ids.append(conv)
        yield _rows(out, batch.column(0).type)
    if ids:
        yield _rows([block()], batch.column(0).type)


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ((),) * 3, (kind, kind, pa.string()))], ["c", "first", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by ``c, first`` to one digest each ``c``."""
    now, state, kind = None, None, None

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ((),) * 2, (kind, pa.string()))], ["c", "ends_sha256"])

    for batch in batches:
        out, kind = [], batch.column(0).type
        for c, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if state is None or c != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = c, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        yield told(out)
    if state:
        yield told([(now, state.hexdigest())])


def _ends(seqs: DataFrame, members: DataFrame) -> DataFrame:
    """``c, ends_sha256``: the digest of the ids of the conversations of each sequence."""
    kind = seqs.schema["c"].dataType.simpleString()
    one = seqs.filter("copies = 1").select("c", F.sha2(F.col("c").cast("string"), 256).alias("ends_sha256"))
    sorted_ = members.select("c", "conv_id").repartitionByRange("c", "conv_id").sortWithinPartitions("c", "conv_id")
    blocks = sorted_.mapInArrow(C.tidied(_join_ids), f"c {kind}, first {kind}, ids string")
    more = blocks.repartition("c").sortWithinPartitions("c", "first").mapInArrow(C.tidied(_hash_ids), f"c {kind}, ends_sha256 string")
    return one.unionByName(more)


def build_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos from 1, key, chars); ``conversations`` has all ids, also of turnless ones.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    C.ship(turns.sparkSession)
    seqs, members = sequences(turns, conversations)
    n_turns, n = seqs.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.count("*")).first()
    if not n:
        return turns.sparkSession.createDataFrame([], f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, depth long, parent_conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    total = turns.count()
    kept = C.join_unique(turns, seqs.select(F.col("c").alias("conv_id"), "turns"), ["conv_id"], "turns", total, keep_unmatched=False).drop("turns")
    turns = C.materialize(kept.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "trie-turns")  # a round reads few files
    found, ended, rounds = _refine(turns, seqs)
    chains = C.materialize(found.join(seqs.select("c", "turns"), "c"), "trie-all-chains")
    at = turns.withColumnRenamed("conv_id", "c").select("c", "pos", "chars")
    nodes = C.join_unique(at, chains, ["c"], "turns", n_turns, keep_unmatched=False).filter("pos > low AND pos <= high")
    root = chains.filter("low = -1").select("c", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("chars"), *chains.columns[1:])
    nodes = C.materialize(nodes.unionByName(root).withColumn("gain", (F.col("n_convs") - 1) * F.col("chars")).withColumn("_block", F.floor(F.col("pos") / BLOCK)), "trie-nodes")
    blocks = C.materialize(nodes.groupBy("c", "low", "_block").agg(F.sum("gain").alias("gain")), "trie-blocks")
    folded = _fold(chains, rounds, C.materialize(blocks.groupBy("c", "low").agg(F.sum("gain").alias("saved")), "trie-own"))
    later = Window.partitionBy("c", "low").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(folded, ["c", "low"]).withColumn("after", F.col("below") + F.coalesce(F.sum("gain").over(later), F.lit(0))).drop("gain", "below")
    down = Window.partitionBy("c", "low", "_block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    told = nodes.withColumn("gain", F.sum("gain").over(down)).join(blocks, ["c", "low", "_block"])
    tails = chains.join(folded.filter("n_below = 0").select("c", "low"), ["c", "low"], "left_semi").filter("high = turns AND low >= 0").select("c", F.col("c").alias("node"), F.col("high").alias("depth"))
    ends = ended.unionByName(tails).join(_ends(seqs, members), "c").select(F.col("node").alias("_n"), F.col("depth").alias("_d"), "ends_sha256")
    last = F.col("pos") == F.col("high")
    rows = told.select(
        F.col("c").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("low") + 1, F.col("up")).otherwise(F.col("c")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_below")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("after") + F.col("gain")).alias("saved_tokens"),
    )
    met = rows.join(ends, (rows["conv_id"] == ends["_n"]) & (rows["depth"] == ends["_d"]), "left").drop("_n", "_d")
    return met.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def grafted(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share first turns: the first ``h`` turns come from the conversation whose id is the next lower
    multiple of ``every``, ``h`` = crc32 of the decimal id modulo ``most + 1``, the others are its own after its first ``h``.

    ``turns`` as of :func:`numbered_turns`; returns the rebuilt turns and all ids.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("long")
    sizes = C.materialize(turns.groupBy("conv_id").agg(F.count("*").alias("_own")).withColumns({"_base": base, "_h": h}), "trie-ids")
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("_base"), "pos", "key", "chars")
    heads = sizes.join(first, "_base").filter("pos <= _h").select("conv_id", "pos", "key", "chars")
    lent = sizes.join(first.groupBy("_base").agg(F.count("*").alias("_n")), "_base", "left").select("conv_id", "_own", F.least(F.col("_h"), F.coalesce("_n", F.lit(0))).alias("_lent"), "_h")
    own = C.join_unique(turns, lent, ["conv_id"], "_own", turns.count(), keep_unmatched=False).filter("pos > _h")
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_lent")).alias("pos"), "key", "chars")
    return C.materialize(heads.unionByName(own), "trie-grafted"), sizes.select("conv_id")
