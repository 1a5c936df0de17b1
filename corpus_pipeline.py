"""From raw documents to token ids: quality, toxicity, near-duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The first four return documents
with all their columns; the last one returns what op10 returns. Rows are known by doc_id: a decision about an id holds for all rows
that share it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import bpe, decontam, ngram_quality, simhash, toxicity
from tidepanel.llm.queries import word_vocabulary
from tidepanel.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is over their language's cut go."""
    return ngram_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches their language's threshold go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark in at least a twentieth of their words go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests with their counts."""
    return bpe.round_trip_digests(docs, word_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("SimHash near-dedup", unique),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", encoded),
]

#: The model-based stages have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next one."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
