"""Operator 4, quality rules with host-level verdicts.

One scan measures every whole text in Arrow batches and leaves narrow rows.  Rules
are then columns.  For each host (``source``) and rule the failures are summed, with
partial aggregation.  An empirical beta prior, fitted to the hosts' rates by the
method of moments, shrinks each rate: a host with few documents stays near the
corpus rate, one with many keeps its own.  A host is rejected when a shrunk rate
passes HOST_LIMIT, and its verdict is joined back to its documents.  The largest
hosts are joined by broadcast (``common.join_unique``), so a host with a third of
all rows is no hot task.

Defined results.  Null, empty and wordless texts have zero counts and fail the base
rule.  Texts of any length are measured whole, one at a time.  A null host is a host of its own.  Rows that repeat are judged one by one and
all count for their host.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

WINDOW = 8
MIN_WORDS = 20
#: Percent of words in repeated windows above which the base rule fails.
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Shrunk failure rate of a rule above which a host is rejected.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_STRENGTH = (1.0, 10_000.0)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_STEP = 0x9E3779B97F4A7C15


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    value = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width, step, rolled, rest = 1, _STEP, value, window
    total, shift, weight = np.zeros(n, np.uint64), 0, 1
    while rest:  # windows of any width from windows of powers of two
        if rest & 1:
            total += rolled[shift : shift + n] * np.uint64(weight)
            shift, weight = shift + width, weight * step % (1 << 64)
        rest >>= 1
        if rest:
            rolled = rolled[: len(rolled) - width] + rolled[width:] * np.uint64(step)
            width, step = 2 * width, step * step % (1 << 64)
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    if not same.any():
        return 0
    met = np.zeros(n, bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    at = np.flatnonzero(met).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in at)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The METRICS of one text in UTF-8."""
    words = text.split()
    body = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(body) if body.isascii() else len(body.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(METRICS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "host", *METRICS])


def document_rules() -> dict[str, Column]:
    """The rules, true where a document fails; integer arithmetic only."""
    words = F.col("n_words")
    return {
        "base_failed": (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words),
        "many_symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "odd_words": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words),
    }


def _prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Alpha and beta of each rule from one row of sums over the hosts."""
    n, out = F.col("n").cast("double"), {}
    sums = [F.sum(n).alias("n"), F.count("*").alias("hosts")]
    sums += [F.sum(F.col(r)).cast("double").alias(r) for r in rules] + [F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_sq") for r in rules]
    row = hosts.agg(*sums).first()
    for r in rules:
        if not row["n"]:
            out[r] = (0.5, 0.5)
            continue
        mean = row[r] / row["n"]
        spread = mean * (1 - mean)
        between = row[f"{r}_sq"] / row["n"] - mean * mean - spread * row["hosts"] / row["n"]
        strength = spread / between - 1 if between > 0 else PRIOR_STRENGTH[1]
        strength = min(max(strength, PRIOR_STRENGTH[0]), PRIOR_STRENGTH[1])
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, host, METRICS, rules, host_rate (worst shrunk rate), host_ok, kept."""
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in (("doc_id", id_col), ("host", host_col))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    rules = document_rules()
    measured = rows.mapInArrow(C.tidied(_measure_batches), ", ".join([*kinds, *(f"{m} long" for m in METRICS)]))
    measured = C.materialize(measured.withColumns(rules), "quality-metrics")
    hosts = C.materialize(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules]), "quality-hosts")
    prior = _prior(hosts, list(rules))
    rate = F.greatest(*[(F.col(r) + a) / (F.col("n") + a + b) for r, (a, b) in prior.items()])
    verdicts = hosts.select("host", "n", rate.alias("host_rate")).withColumn("host_ok", F.col("host_rate") <= host_limit)
    joined = C.join_unique(measured, verdicts, ["host"], "n", measured.count()).drop("n")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
