"""Operator 8, language identification with error-correcting output codes.

Every language has a codeword of plus and minus ones.  For each bit a binary
classifier over hashed byte n-grams (the log ratio of the mean n-gram models of the
languages on either side) tells which side a text is on.  A text's margins are
compared with all codewords by loss-weighted decoding: an exponential loss per bit,
weighted by how often that bit is right for that language, as measured on rows that
were not learned from.  The nearest codeword wins; where the next one is almost as
near, the text is flagged as ambiguous.

Learning reads text and language of labelled rows only, a sample of about
TRAIN_DOCS rows a language drawn by a hash of the id (all rows if there are fewer), of
which one in TRUST_SHARE measures the bits.  Every language of those rows is learned: the first
row drawn never measures, and a bit counts half for a language that none measures.
The n-gram counts stay distributed and are summed by bucket into the bits; the driver
gets the model alone: BUCKETS times bits, and languages times bits, where the bits grow
with the logarithm of the number of languages.  Prediction is one scan over whole texts.

Defined results.  Null texts and texts without a letter are ``und`` with score 0, as
is everything when nothing could be learned.  Rows with a null language or id are
not learned from.  Rows that repeat are predicted alike.  Texts of any length are read
whole, in parts of PART bytes.  Ties go to the first language by name.  An empty table
gives no rows.  Extra columns are ignored by :func:`predict` and carried through by
:func:`keep_identified`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import common as C

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Rows of each language that are learned from, about: the documented bound of the sample.
TRAIN_DOCS = 3000
#: One in so many rows of the sample measures the bits instead of being learned from.
TRUST_SHARE = 5
SMOOTHING = 0.5
#: Bytes of a text whose n-grams are summed together, bytes and numbers (n-grams times bits) looked at together.
PART, BLOCK, NUMBERS = 1 << 15, 1 << 17, 1 << 22
#: Counts that a learning task holds before it passes them on.
COUNTS = 1 << 21
#: Below this lead over the next codeword a text is ambiguous.
LEAD = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # BUCKETS x bits
    scale: np.ndarray  # bits: mean absolute margin
    trust: np.ndarray  # languages x bits: weights of the losses, rows sum to 1


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords, drawn at random; any two differ in a quarter of the bits at least, and every column splits the languages in two."""
    if n < 2:
        return np.ones((n, 1))
    rng, bits = np.random.default_rng(seed), 10 * math.ceil(math.log2(n))
    code = np.empty((n, bits), np.int8)
    have = 0
    while have < n:  # a draw is taken if it is far enough from all before it; the bits are many enough for that to end
        row = rng.choice(np.array([-1, 1], np.int8), bits)
        if not have or (code[:have] != row).sum(1).min() >= bits / 4:
            code[have] = row
            have += 1
    return code[:, np.abs(code.sum(0, dtype=int)) < n].astype(float)  # a bit that all share tells nothing


@dataclass
class Grams:
    """Buckets of some parts of texts: ``ids[start[i]:start[i + 1]]`` are of text ``text[i]``; no part is empty."""

    ids: np.ndarray
    start: np.ndarray
    text: np.ndarray


def gram_blocks(texts: list[str], most: int = BLOCK) -> Iterator[Grams]:
    """Lower-cased byte n-grams of whole texts, one space before and after each, about ``most`` bytes at a time."""
    parts: list[bytes] = []
    owner: list[int] = []
    own: list[int] = []
    size, reach = 0, max(GRAMS) - 1
    for i, text in enumerate(texts):
        data = f" {text.lower()} ".encode(errors="replace")
        for at in range(0, len(data), PART):
            part = data[at : at + PART + reach]
            parts.append(part)
            owner.append(i)
            own.append(min(PART, len(part)))
            size += len(part)
            if size >= most:
                yield from _grams(parts, owner, own)
                parts, owner, own, size = [], [], [], 0
    if parts:
        yield from _grams(parts, owner, own)


def _grams(parts: list[bytes], owner: list[int], own: list[int]) -> Iterator[Grams]:
    """For each n; a part owns the n-grams that start in its first ``own`` bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    have, texts = np.array([len(p) for p in parts]), np.array(owner)
    first, key = np.cumsum(have) - have, data
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            key = (key << np.uint32(8))[: len(data) - n + 1] | data[n - 1 :]
        if n not in GRAMS:
            continue
        mixed = key + np.uint32(n * 97)
        mixed *= _MIX
        mixed ^= mixed >> np.uint32(15)
        mixed &= np.uint32(BUCKETS - 1)
        count = np.maximum(np.minimum(own, have - n + 1), 0)
        skip = np.zeros(len(data) + 1, np.int8)  # what lies past a part's own n-grams
        np.add.at(skip, first + count, 1)
        np.add.at(skip, first + have, -1)
        ids = mixed[np.cumsum(skip[: len(mixed)], dtype=np.int8) == 0]
        some = count > 0
        if some.any():
            yield Grams(ids, np.r_[0, np.cumsum(count[some])], texts[some])


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean log ratio of the n-grams of each text, for each bit."""
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for g in gram_blocks(texts, max(1, min(BLOCK, NUMBERS // (len(GRAMS) * weights.shape[1])))):
        np.add.at(total, g.text, np.add.reduceat(weights.take(g.ids, axis=0), g.start[:-1], axis=0))
        np.add.at(n, g.text, np.diff(g.start))
    return total / np.maximum(n, 1)[:, None]


def decode(found: np.ndarray, model: Model) -> tuple[str, float, bool]:
    """Language, score and ambiguity of a text's margins."""
    pull = np.clip(found / model.scale, -3, 3)
    losses = (model.trust * np.exp(-model.code * pull)).sum(1)
    order = np.argsort(losses, kind="stable")
    likely = np.exp(-4 * (losses - losses[order[0]]))
    lead = losses[order[1]] - losses[order[0]] if len(order) > 1 else math.inf
    return model.languages[order[0]], float(likely[order[0]] / likely.sum()), bool(lead < LEAD)


def _sample(docs: DataFrame, usable: Column, per_language: int) -> DataFrame:
    """``lang``, ``text`` of the rows to learn from, and ``measures``, true for those that measure the bits."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    rates = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("rate"), F.min(draw).alias("first"))
    measures = F.pmod(F.xxhash64("doc_id", F.lit("language trust")), F.lit(TRUST_SHARE)) == 0
    # a row for each language, as the model has, which is broadcast too; the first drawn row of each is always learned from
    kept = rows.join(F.broadcast(rates), "lang").filter((draw < F.col("rate")) | (draw == F.col("first")))
    return kept.select("lang", "text", (measures & (draw > F.col("first"))).alias("measures"))


def _counts(languages: object):
    """Sums ``(lang, bucket, n)`` of a task's rows, ``lang`` as its number; at most about COUNTS are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages.value)}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // BUCKETS), pa.array(keys % BUCKETS), pa.array(sums)], ["lang", "bucket", "n"])

        for batch in batches:
            langs, texts = [number[x] for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for g in gram_blocks(texts):
                of = np.repeat(np.array(langs, np.int64)[g.text], np.diff(g.start))
                new, n = np.unique(of * BUCKETS + g.ids, return_counts=True)
                both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([sums, n]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > COUNTS:
                    yield out()
                    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    return run


def _bit_sums(code: object):
    """For each bucket, the rates of the languages on either side of each bit, summed; rows are ``lang, bucket, rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus = (code.value > 0).astype(np.float64)
        at: dict[int, np.ndarray] = {}
        for batch in batches:
            langs, buckets, rates = (batch.column(i).to_numpy() for i in range(3))
            order = np.argsort(buckets, kind="stable")
            found, first = np.unique(buckets[order], return_index=True)
            step = max(1, NUMBERS // plus.shape[1])
            for low in range(0, len(order), step):
                part = order[low : low + step]
                own, start = np.unique(buckets[part], return_index=True)
                both = np.hstack([plus[langs[part]] * rates[part][:, None], rates[part][:, None]])
                for b, row in zip(own.tolist(), np.add.reduceat(both, start, axis=0)):
                    at[b] = at[b] + row if b in at else row
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([r.tolist() for r in at.values()], pa.list_(pa.float64()))], ["bucket", "sums"])

    return run


def _bits_right(shared: object):
    """For each language of a task's rows: rows, and for each bit the rows it is right for and the sum of its sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, code, weights = shared.value
        number = {x: i for i, x in enumerate(languages)}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            langs, found = [number[x] for x in batch.column(0).to_pylist()], margins(batch.column(1).to_pylist(), weights)
            for lang, row in zip(langs, found):
                own = np.r_[1.0, np.sign(row) == code[lang], np.abs(row)]
                sums[lang] = sums[lang] + own if lang in sums else own
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int64()), pa.array([own.tolist()], pa.list_(pa.float64()))], ["lang", "sums"])

    return run


def learn(docs: DataFrame, usable: Column, per_language: int = TRAIN_DOCS) -> Model | None:
    """The model from rows of ``doc_id, lang, text`` where ``usable``; None if there are none."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    C.ship(spark)
    C.small_batches(spark)
    sample = C.materialize(_sample(docs, usable, per_language), "language-sample")
    learned = sample.filter("NOT measures")
    languages = tuple(sorted(r["lang"] for r in learned.select("lang").distinct().toLocalIterator()))
    if not languages:
        return None
    code = codewords(len(languages))
    sums = learned.select("lang", "text").mapInArrow(C.tidied(_counts(sc.broadcast(languages))), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = C.materialize(sums, "language-counts")
    of = sums.groupBy("lang").agg((F.sum("n") + F.lit(SMOOTHING * BUCKETS)).alias("total"))
    totals = np.full(len(languages), SMOOTHING * BUCKETS)
    for r in of.toLocalIterator():
        totals[r["lang"]] = r["total"]
    rates = sums.join(F.broadcast(of), "lang").select("lang", "bucket", (F.col("n") / F.col("total")).alias("rate"))
    parts = rates.repartition("bucket").mapInArrow(C.tidied(_bit_sums(sc.broadcast(code))), "bucket long, sums array<double>")
    plus = np.zeros((BUCKETS, code.shape[1] + 1))
    for r in parts.toLocalIterator():
        plus[r["bucket"]] += r["sums"]
    base = SMOOTHING / totals  # what smoothing gives every bucket of a language
    every, sides = plus[:, -1:], (code > 0).astype(float)
    up, down = plus[:, :-1] + base @ sides, every - plus[:, :-1] + base @ (1 - sides)
    weights = np.log(up / np.maximum(sides.sum(0), 1)) - np.log(np.maximum(down, 1e-300) / np.maximum((1 - sides).sum(0), 1)) if len(languages) > 1 else np.zeros((BUCKETS, 1))
    shared = sc.broadcast((languages, code, weights))
    tests = sample.filter("measures").select("lang", "text")
    seen = np.zeros((len(languages), 1 + 2 * code.shape[1]))
    for r in tests.mapInArrow(C.tidied(_bits_right(shared)), "lang long, sums array<double>").toLocalIterator():
        seen[r["lang"]] += r["sums"]
    n, right, sizes = seen[:, :1], seen[:, 1 : 1 + code.shape[1]], seen[:, 1 + code.shape[1] :]
    trust = (right + 1) / (n + 2)  # one half where nothing was seen
    scale = sizes.sum(0) / max(1.0, float(n.sum())) if n.sum() else np.ones(code.shape[1])
    return Model(languages, code, weights, np.maximum(scale, 1e-6), trust / trust.sum(1, keepdims=True))


def _predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """``lang_pred, score, ambiguous`` after the first column of ``rows``; the second is the text."""
    spark = rows.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [rows.columns[0], "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
            told = [i for i, t in enumerate(texts) if model is not None and t is not None and _LETTER.search(t)]
            if told:
                for i, found in zip(told, margins([texts[i] for i in told], model.weights)):
                    out[i] = decode(found, model)
            langs, scores, flags = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names)

    fields = [T.StructField(n, k) for n, k in zip(names[1:], (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return rows.mapInArrow(C.tidied(run), T.StructType([rows.schema[0], *fields]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row."""
    return _predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs`` without rows of unknown or ambiguous language; a null ``lang`` becomes the predicted one."""
    told = _predict(docs.select(C.boxed(docs), F.col("text").alias("_text")), learn(docs, ~held_out()))
    told = told.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous") & (F.col("score") >= min_score))
    fill = {"lang": F.coalesce(F.col("_row").getField("lang"), F.col("lang_pred"))}
    return told.select(*[fill.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
