"""The queries of the operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import decontaminate, jaccard_join, license_scan, line_dedup, packed_ids, personal_data, pieces, prefix_trie, quality_fm, ranked_search, secret_scan, topk_search, toxicity
from frameloom.session import table


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files of this machine are; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), min_chars=1, min_docs=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_out=2, threshold=0.3)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = packed_ids.write_corpus(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return packed_ids.corpus_report(shards)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(table(spark, sf_dir, "documents"), k=5, at_least=(3, 4))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, scale=256)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_out=1, threshold=0.5)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_report(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    every = [op1_line_dedup, op2_toxicity, op3_decontamination, op4_packed_ids, op5_jaccard_join, op6_pieces, op7_topk_search, op8_secret_scan, op9_license_scan, op10_quality_fm, op11_personal_data, op12_ranked_search, op13_prefix_trie]
    return {f.__name__: f for f in every}
