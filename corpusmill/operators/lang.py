"""Nested language data: durations, key-value corpora, words down to phonemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of a duration.
DURATIONS = {"minute": ("30m", "30 m", "30 minute", "30 minutes")}
WORD = "word string, morphemes array<struct<text:string,syllables:array<struct<text:string,phonemes:array<string>>>>>"


def duration_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, list(f)) for u, f in DURATIONS.items()], "unit string, forms array<string>").select("unit", F.explode("forms").alias("form"))


def duration_units(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text is a known spelling, with its ``unit``; the table of spellings is a constant."""
    table = duration_table(texts.sparkSession)
    return texts.join(F.broadcast(table), texts[text_col] == table["form"]).drop("form")


def explode_pairs(df: DataFrame, map_col: str) -> DataFrame:
    """Every key and value of a map column."""
    return df.select(*[c for c in df.columns if c != map_col], F.explode(map_col).alias("key", "value"))


def unnest_words(words: DataFrame) -> DataFrame:
    """One row per phoneme, with its places in syllable, morpheme and word."""
    m = words.select("word", F.posexplode("morphemes").alias("morpheme_no", "m"))
    s = m.select("word", "morpheme_no", F.col("m.text").alias("morpheme"), F.posexplode("m.syllables").alias("syllable_no", "s"))
    return s.select("word", "morpheme_no", "morpheme", "syllable_no", F.col("s.text").alias("syllable"), F.posexplode("s.phonemes").alias("phoneme_no", "phoneme"))


def space_tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A token is the text between two spaces."""
    return texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(F.split(text_col, " ")).alias("token_no", "token"))


def sentences(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``sentence_no, sentence``: a text up to and with each run of ``. ! ?`` that white space or the end follows."""
    cut = F.filter(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)(?:[^.!?]|[.!?](?![\s.!?]|$))*+[.!?]*"), F.lit(0)), lambda x: F.btrim(x)), lambda x: x != "")
    return texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(cut).alias("sentence_no", "sentence"))


def phrases(sentences_: DataFrame, text_col: str = "sentence") -> DataFrame:
    """``phrase_no, phrase``: more than a word and less than a sentence, the parts between ``, ; :``."""
    cut = F.filter(F.transform(F.split(F.col(text_col), "[,;:]"), lambda x: F.btrim(x)), lambda x: x != "")
    return sentences_.select(*[c for c in sentences_.columns if c != text_col], F.posexplode(cut).alias("phrase_no", "phrase"))


def store_meanings(meanings: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """A language's store of ``meaning`` rows: the union of what is there and what is new, each once."""
    return (meanings if store is None else store.unionByName(meanings)).dropDuplicates()


def quantize(vectors: DataFrame, levels: int = 26, vector_col: str = "embedding") -> DataFrame:
    """Adds ``letters``: each entry of a unit vector as one of ``levels`` letters of equal width, from -1 to 1."""
    at = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) / 2 * levels), F.lit(0)), F.lit(levels - 1))
    return vectors.withColumn("letters", F.array_join(F.transform(vector_col, lambda x: F.char(at(x) + ord("a"))), ""))
