"""A training-data pipeline of the corpus operators: each stage works on all its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again for the next stage, so a lost executor costs one stage at
most; a stage's folder goes once the next one is written, the last one's when the application ends.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import bpe_trie, decontaminate, language_id, near_dup, queries, secret_scan


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents go whose text is in none of the learned languages: null, without a letter, or
    of n-grams of which the predicted language knows less than a quarter."""
    B.ship(spark)
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return language_id.drop_rejected(docs, language_id.fit(docs, remainder != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of documents linked at a similarity of 0.8 over 5-word shingles, the first stays."""
    B.ship(spark)
    return near_dup.one_of_each(docs, threshold=0.8, words=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with two benchmark items or more go; passages of a single one are cut out."""
    return decontaminate.clean(docs, B.read(spark, sf_dir, "benchmark"), min_items=2)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: findings are replaced in the text."""
    B.ship(spark)
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids and what they decode to, as counts and digests."""
    B.ship(spark)
    return bpe_trie.digests(bpe_trie.encode_decode(docs, queries.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("encoded", encoded),
]

#: Bloom filters, MinHash and trained models are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = B.read(spark, sf_dir, "documents")
    place, before = B.scratch_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            B.remove(spark, before)
        before = f"{place}/{name}"
    return docs
