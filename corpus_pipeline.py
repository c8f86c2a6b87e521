"""The corpus pipeline: each stage reads what its predecessor kept, as Parquet.

Every stage but the last returns the columns of documents; the last one encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penforge.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from penforge.llm.common import fresh_path, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more stay; null and empty texts are scored like others, an empty table stays empty."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, of those the one with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, and every row without words."""
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a whole benchmark item stands, a few edits apart at most, go; null texts stay."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each row; a null text is empty."""
    import public_tokenizers as P

    return bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]
#: SQL can't express the classifier, nor edit matching or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
