"""The training-data pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps; what it
returns is written as Parquet and read again as the next stage's ``docs``.

1. language ID drops texts without a known language, and fills in a missing ``lang``;
2. exact dedup keeps one document of each group of equal texts;
3. SimHash near-dedup keeps one document of each component;
4. substring dedup cuts passages of over 50 words that an earlier document holds;
5. packing returns the pieces of the packed sequences.

All but the last return the columns of ``docs``, whatever their names, extra ones included.

Defined results.  Null and empty texts, and texts without a letter or of ambiguous language,
go in stage 1; if nothing could be learned, all go.  Texts of any length pass whole.
Documents are told apart by id and text from stage 2 on, so null ids and ids with several
texts lose nothing but copies; of rows that repeat a document one stays.  Ties go to the
longest original, then the smallest id (null last).  Stage 4 drops a document of which no
word is left, and sets ``n_chars``.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import common, exact_dedup, language_id, packing, simhash, substring_dedup
from corpusmill.llm.registry import vocabulary_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_spans(docs, substring_dedup.repeated_spans(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's own tables go once its result is written."""
    others = set(common.tables(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        mine = [t for t in common.tables(spark) if t not in others]
        common.release(spark, mine[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
