"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat_format, complement_packing, exact_dedup, importance, language_id, license_scan, packing, periodic_runs, prefix_trie, quality_rules, simhash, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, {'a': -chars, 'b': doc_id}) AS keep_id
  FROM n GROUP BY text_sha256)
SELECT n.doc_id, w.keep_id, w.group_size, n.doc_id = w.keep_id AS kept, n.text_sha256
FROM n JOIN w USING (text_sha256)
"""

def vocabulary_path() -> str:
    """The public vocabulary file of operators 7 and 9."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    windows = chat_format.format_conversations(turns.unionByName(more), counter=chat_format.vocabulary_counter(vocabulary_path()))
    return chat_format.digest_windows(windows)


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return importance.resample(_table(spark, sf_dir, "documents"), good)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs.select("doc_id", "lang", "text"), ~language_id.held_out())
    told = language_id.predict(docs, model)
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return complement_packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting of some documents: from word ``a`` on they repeat ``p`` words.  A document without an id stays."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.find_runs(_table(spark, sf_dir, "documents"), rewrite=planted_period))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.build_trie(*prefix_trie.grafted(turns))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], list_transform(range(8), lambda i: i)), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
lent AS (SELECT ids.*, coalesce(n, 0) AS n FROM ids LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1) USING (base)),
r AS (
  SELECT lent.conv_id, t.pos, k, chars FROM lent JOIN t ON t.conv_id = base WHERE t.pos <= h
  UNION ALL
  SELECT conv_id, pos - h + least(h, n), k, chars FROM lent JOIN t USING (conv_id) WHERE pos > h),
c AS (SELECT conv_id, coalesce(list(k ORDER BY pos) FILTER (k IS NOT NULL), []) AS ks, list(chars ORDER BY pos) FILTER (k IS NOT NULL) AS cs FROM ids LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, d AS depth, ks[1:d] AS p, ks[1:d - 1] AS above, CASE WHEN d = 0 THEN 0 ELSE cs[d] END AS chars, len(ks) = d AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM c)),
n AS (
  SELECT depth, p, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS gain,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY depth, p),
kids AS (SELECT depth - 1 AS depth, above AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, p)),
below AS (
  SELECT e AS depth, p[1:e] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(gain)::BIGINT AS saved_tokens
  FROM (SELECT p, n_children, gain, unnest(range(0, depth + 1)) AS e FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (depth, p) LEFT JOIN full_ u ON u.depth = f.depth - 1 AND u.p = f.above
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i+7), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w)-6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i+8)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, count(*) AS n FROM ln GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dl.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(dl.n, 0) AS n_lines
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dl USING (doc_id)),
r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 10 * n_symbols > n_words AS many_symbols,
         10 * n_dup_lines > 3 * n_lines AS dup_lines, word_chars < 3 * n_words OR word_chars > 12 * n_words AS odd_words
  FROM m),
u AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f
  FROM (SELECT source, unnest([{'rule': 1, 'failed': base_failed}, {'rule': 2, 'failed': many_symbols}, {'rule': 3, 'failed': dup_lines}, {'rule': 4, 'failed': odd_words}], recursive := true) FROM r)
  GROUP BY ALL),
s AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f) / sum(n) * (1 - sum(f) / sum(n)) AS spread,
         sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_
  FROM u GROUP BY rule),
p AS (SELECT rule, mean, least(greatest(CASE WHEN between_ > 0 THEN spread / between_ - 1 ELSE 10000.0 END, 1.0), 10000.0) AS strength FROM s),
h AS (SELECT u.source, bool_and((u.f + mean * strength) / (u.n + strength) <= 0.5) AS host_ok FROM u JOIN p USING (rule) GROUP BY u.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_importance": op3_importance,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_complement_packing": op11_complement_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op13_prefix_trie": OP13_SQL,
}
