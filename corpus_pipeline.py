"""A corpus pipeline: quality rules, near and exact deduplication, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm import nnls_packing, prefix_free_parsing, quality_cascade, secret_index, simhash_trie
from loam.llm.common import drop_staged, leaving, stage, table
from loam.llm.queries import tokenizer_file


#: Near copies: words of a shingle, and the share of shingles that two texts must have in common.
WIDTH, LIKENESS = 5, 0.8


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return leaving(docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), *getattr(docs, "_left", ()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cascade.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_trie.representatives(docs, width=WIDTH, likeness=LIKENESS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(prefix_free_parsing.deduplicated(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secret_index.redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nnls_packing.packed_pieces(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

#: Neither suffix arrays nor packing can be stated in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and reread; a stage's input is removed once its output is written.

    What the last stage reads stays until common.drop_left() of the result, which holds for a null text (empty, rejected by the
    quality rules), null and repeated ids (rows on their own) and an empty table (no rows) as each stage states.
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
            if before is not None:
                drop_staged(before)
            before = docs
    return leaving(docs, before)
