"""Exact top-k search by exhaustive term-at-a-time accumulation.

A stated set of query rows is scored against every other row. Vectors are sparse rows of weighted terms
(a dense vector has its non-zero components as terms). Within a block of candidate rows the terms are
inverted into postings; each term of a block of queries scatters its weighted postings into a dense score
array, after the last term the k best rows of each query are cut out by partition selection, and the cuts
of all blocks are merged. No pair is ever a row: a task sends at most k rows per query.

Queries are taken in blocks of at most `block_queries` rows, so what is sent to the executors has a fixed
bound; with more than one block each block's result is written to the shared folder before the next.

Defined results: rows with a null id, a null vector, or a vector with null or non-finite components take
no part, neither as query nor as candidate; vectors of unequal lengths meet on their common components;
every row is a query or candidate of its own, whatever ids repeat: a query's own row alone is left out of its
candidates, and rows that repeat a query's id and vector each get their result; ties go to the smaller id;
with fewer than k candidates all are returned. Ids are cast to long. Scores are 64-bit: a vector whose scaled
components have a sum of squares of 2**61 or more is an error, and no product of two shorter ones can pass 2**62, in
whole or in part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.frames import arrow_types, record
from frameloom.session import staged

SCALE = 256
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, terms): each component x as floor(scale * x) in double precision; unusable rows dropped."""
    x = F.col(f"`{vector_col}`")
    usable = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v.cast("double") * scale, F.lit(2.0)))
    terms = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    long = F.raise_error(F.concat(F.lit("scores of this vector may not fit 64 bits: "), F.col(f"`{id_col}`").cast("string"))).cast("array<bigint>")
    return df.where(usable).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(square < 2.0**61, terms).otherwise(long).alias("terms"))


def dense(column: pa.Array) -> np.ndarray:
    """(rows, terms) of a list column; short rows are filled with zeros, which add nothing to a product."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all queries and rows, one term at a time over the term's postings."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        column, weights = rows[:, term], queries[:, term]
        posting, asking = np.flatnonzero(column), np.flatnonzero(weights)
        if not len(posting) or not len(asking):
            continue
        if len(posting) == len(rows) and len(asking) == len(queries):
            scores += weights[:, None] * column
        else:
            scores[np.ix_(asking, posting)] += weights[asking, None] * column[posting]
    return scores


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids; ids are ascending."""
    at = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return at[np.lexsort((ids[at], -scores[at]))]


def vector_hash(terms: np.ndarray) -> bytes:
    return np.trim_zeros(terms, "b").tobytes()


def scan(rows: DataFrame, query_ids: np.ndarray, query_terms: np.ndarray, k: int) -> DataFrame:
    """(query, vec_id, score, own): the k + 1 best rows of each query in each partition of rows.

    query: the query's place in the block; own: the row has the query's id and vector.
    """
    schema = "query int, vec_id long, score long, own boolean"
    names, types = ["query", "vec_id", "score", "own"], arrow_types(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in query_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                ids, block = ids[order], dense(part.column(1))[order]
                for q in range(0, len(query_ids), 64):
                    scores = accumulate(query_terms[q : q + 64], block)
                    for i, s in enumerate(scores, q):
                        at_best = select(ids, s, k + 1)
                        here, s = ids[at_best], s[at_best]
                        own = here == query_ids[i]
                        if own.any():
                            mine = vector_hash(query_terms[i])
                            own &= np.array([vector_hash(block[j]) == mine for j in at_best])
                        both = [np.concatenate(x) for x in zip(best[i], (here, s, own))]
                        order = np.lexsort((~both[2], both[0], -both[1]))[: k + 1]
                        best[i] = tuple(x[order] for x in both)
        n = [len(x) for x, _, _ in best]
        if sum(n):
            yield record({"query": np.repeat(np.arange(len(n)), n), "vec_id": np.concatenate([x[0] for x in best]), "score": np.concatenate([x[1] for x in best]), "own": np.concatenate([x[2] for x in best])}, names, types)

    return rows.mapInArrow(run, schema)


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for each query row.

    is_query: a condition on the column `id` that states which rows are queries.
    """
    rows = scaled_vectors(df, id_col, vector_col, scale)
    queries = staged(rows.where(is_query(F.col("id"))).groupBy("id", "terms").agg(F.count("*").alias("copies")), "queries", small=True)
    n_blocks = max(1, -(-queries.count() // (block_queries // 2)))
    results = []
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("id", "terms"), F.lit(n_blocks)) == b) if n_blocks > 1 else queries
        own = block.orderBy("id", "terms").toArrow()
        found = scan(rows, own.column("id").to_numpy(), dense(own.column("terms").combine_chunks()), k)
        results.append(ranked(found, own, k) if n_blocks == 1 else staged(ranked(found, own, k), f"top-{b}"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def ranked(found: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """The k best of all partitions but the query's own row, for each of the rows that are the query."""
    order = [F.desc("score"), "vec_id", F.desc("own")]
    every = Window.partitionBy("query").orderBy(*order)
    first = found.withColumn("at", F.row_number().over(every)).where(F.col("at") <= k + 1)
    # rows of one score and id are alike, so the first own row stands for the one that is left out
    n_own = F.sum(F.col("own").cast("int")).over(every.rowsBetween(Window.unboundedPreceding, 0))
    others = first.withColumn("n_own", n_own).where(~F.col("own") | (F.col("n_own") > 1))
    numbered = others.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
    # as many rows as the block has queries
    about = found.sparkSession.createDataFrame(list(enumerate(zip(*(queries.column(c).to_pylist() for c in ("id", "copies"))))), "query int, about struct<id: long, copies: long>")
    joined = numbered.join(F.broadcast(about), "query").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("about.copies"))))
    return joined.select(F.col("about.id").alias("query_id"), "rank", "vec_id", "score")
