"""A corpus cleaning pipeline: five stages over `documents`, each written as Parquet and read again.

All stages but the last keep the columns of documents. Rows with null ids or empty texts pass like any
other row unless a stage's rule removes them: empty texts score as such in the classifier, have one empty
line, link with nothing, hold no benchmark passage and have no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, jaccard_join, line_dedup, pieces, quality_fm
from frameloom.llm.queries import tokenizer_file
from frameloom.session import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below one half go."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1, threshold=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from all of them; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, min_chars=1, min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.75 or more, the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs, k=5, at_least=(3, 4))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document that is left, with the hash of the decoded ids and whether they give the text back."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), decoded=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark_leaks), ("pieces", coded)]
#: Classifiers, similarity joins and tokenisation have no SQL form; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
