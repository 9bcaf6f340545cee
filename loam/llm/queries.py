"""The operators over their whole tables, as queries of (spark, folder of tables), and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm import nnls_packing, order_minhash, perspectives, prefix_free_parsing, preference_ranking, pseudonyms, quality_cascade, secret_index, simhash_trie, trie_bpe
from loam.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; LOAM_TOKENIZERS names another folder."""
    folder = os.environ.get("LOAM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.groups(table(spark, sf_dir, "documents"))


def op2_preference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_ranking.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compared_with_next(table(spark, sf_dir, "documents"))


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.packed_pieces(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op5_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.found_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *(count(r.kind) for r in secret_index.BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free_parsing.removal_report(table(spark, sf_dir, "documents"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), pseudonyms.configured_secret(spark))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_cascade.verdicts(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotated(table(spark, sf_dir, "conversations"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash_trie, op2_preference_ranking, op3_order_minhash, op4_nnls_packing, op5_secret_index, op6_prefix_free_parsing, op7_pseudonyms, op8_quality_cascade, op9_perspectives, op10_trie_bpe)
}

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op8_quality_cascade": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS} AS ws FROM d),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dups AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM lines GROUP BY r),
stats AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_upper > n_letters OR 2 * n_dup_lines > n_lines
            OR NOT (2 * n_words <= word_chars AND word_chars <= 25 * n_words)) AS kept
FROM stats""",
    "op9_perspectives": r"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
                  translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS name FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
b AS (SELECT conv_id, perspective, turn, role, text, role = perspective AS mine,
             '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                                    ELSE 'user name=' || name END || chr(10) AS head
      FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM b),
o AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text
                                            ROWS UNBOUNDED PRECEDING) - length(segment))::BIGINT AS start FROM s)
SELECT conv_id, perspective, turn, segment, start,
       CASE WHEN mine THEN (start + length(head))::BIGINT END AS train_start,
       CASE WHEN mine THEN (start + length(segment) - 1)::BIGINT END AS train_end
FROM o""",
}
