"""The contract queries `opN_<name>` over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat_format, chunk_dedup, decontam, flac_media, hilbert, html_extract, importance, merkle, ngram_quality, simhash, token_store, toxicity
from tidepanel.session import table


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items, by winnowed fingerprints. Nulls have no words; repeated rows come once each."""
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def word_vocabulary() -> str:
    """The path of the vocabulary file, which every machine has in the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids and what they decode to, as digests. Null is the empty text; repeated rows come once each."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op4_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read back from the files of wavelet matrices. Null ids come first; null is the empty text."""
    folder = token_store.write_store(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2)
    return token_store.documents_of(token_store.read_store(spark, folder))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a FLAC stream that was written and read back, as digests. Null is the empty text; equal texts have equal rows."""
    return flac_media.media_digests(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that links reach. Null and empty texts have fingerprint 0."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether its language's cut rejects it. Null is the empty text; a null language is a language."""
    scored = ngram_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ngram_quality.judge(scored).select("doc_id", "lang", "n_grams", F.round("perplexity", 6).alias("perplexity"), F.round("cut", 6).alias("cut"), "rejected")


def op7_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt outside the held-out fifth. Empty and null texts have a score too; without labels all scores are 0."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place along the curve, under the law `rows`. Null ids and repeated rows are rows like others."""
    return hilbert.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text. Null html gives the empty text; repeated rows come once each."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op3_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of every conversation, and of -7, whose texts are the template's own marks."""
    hard = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{hard}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_format.round_trip_digests(table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own))


def op11_superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof in the manifest, and whether the row, tampered with under every second id, still leads to the root. Nulls are marked fields; equal rows are neighbours."""
    return merkle.tampering_report(table(spark, sf_dir, "documents"))


def op12_feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score and its rank among the drawn. Null and empty texts have weight 0; rows that share an id have the same noise."""
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and whether it is the one that stays. Null is the empty text; of rows that share the smallest id one stays."""
    return chunk_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_grammar_round_trip": op3_grammar_round_trip,
    "op4_wavelet_matrix": op4_wavelet_matrix,
    "op5_tag_paths": op5_tag_paths,
    "op6_flac": op6_flac,
    "op7_convolution": op7_convolution,
    "op8_hilbert": op8_hilbert,
    "op9_winnowing": op9_winnowing,
    "op10_merge_rounds": op10_merge_rounds,
    "op11_superblocks": op11_superblocks,
    "op12_feature_dictionary": op12_feature_dictionary,
    "op13_chunk_recipes": op13_chunk_recipes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_grammar_round_trip": chat_format.ORACLE_SQL,
    "op9_winnowing": decontam.ORACLE_SQL,
    "op11_superblocks": merkle.oracle_sql(),
    "op12_feature_dictionary": importance.ORACLE_SQL,
    "op13_chunk_recipes": chunk_dedup.ORACLE_SQL,
}
