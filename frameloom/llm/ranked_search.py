"""Ranked lexical search: postings in groups of one exact impact, read score by score from the highest.

The impact of a term in a document is what it adds to the document's score, a whole number. Documents stay
where they are: each task takes the documents of its partition in blocks and inverts a block into groups of
postings with one term and one impact, the highest impact first. For a query the groups of all its terms are
read in falling order of impact into an array of scores. What a document can still get is bounded by the next
unread impact of each term it was not yet met under. Reading stops only when these bounds prove that at most
k documents of the block can be among the best k, against both the block's own scores and those of the blocks
before; the scores of the documents that are left are then completed from the block. With no such proof every
group is read. A task sends k rows per query, and these are merged; no posting is ever shuffled.

Two passes read documents: the first counts terms (of all words for lengths, of the queries' words for postings)
and is written to the shared folder; the second reads what was written, with the statistics of all documents.
Queries go out in blocks of at most about `block_items` rows and `block_chars` characters, one block after the
other, so what is sent to executors and held by the driver has a fixed bound.

Scores: terms are maximal runs of ASCII letters and digits and of all other characters outside ASCII, A-Z in
lower case. N counts documents with a term, L all terms, n one document's, df a term's documents, tf its
occurrences in a document. A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); with whole-number division
m = 10 + 90 * n * N // L, and its impact is w * (10**9 * tf // (1000 * tf + 8 * m)), in 64 bits.

Defined results: null and empty texts have no terms, are not counted and are never found; a query without terms
or without a matching document has no rows; each row of documents is a document and each row of queries a query
of its own, whatever ids repeat or are null; equal scores go to the smaller id, null ids last. Other columns are
not read; document ids are cast to long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.frames import arrow_types, keyed_texts, over_batches, record
from frameloom.llm.text import LOWER, NON_ALNUM, chunks, words
from frameloom.session import staged

BLOCK_ITEMS = 2048
BLOCK_CHARS = 4_000_000
#: Postings of a block of documents; a single document is never cut.
BLOCK_POSTINGS = 1 << 20
#: Impacts are below 2**40: a weight is below 45,000 for any 64-bit count, its factor below 10**6.
IMPACT_BITS = 40
IMPACTS = (1 << IMPACT_BITS) - 1
#: The parts that the rows of one query are ranked in before the parts are.
PARTS = 64


def terms_of(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, its terms as binary, bounds): the terms of row first + i are bounds[i]:bounds[i + 1]."""
    for first, data, offsets in chunks(column):
        start, end, bounds = words(data, offsets, NON_ALNUM)
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=at[1:])
        letters = LOWER[data[~NON_ALNUM[data]]]
        yield first, pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)]), bounds


def counted(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; terms are places in the vocabulary, in ascending order."""
    size = max(1, len(vocabulary))

    def count(batch: pa.RecordBatch) -> dict:
        n, lengths, terms, tfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, found, bounds in terms_of(batch.column(1)):
            each = np.diff(bounds)
            place = pc.index_in(found, value_set=vocabulary)
            hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(each)), each)[hit]
            key, tf = np.unique(row * size + place.drop_null().to_numpy(), return_counts=True)
            n.append(each)
            lengths.append(np.bincount(key // size, minlength=len(each)))
            terms.append(key % size)
            tfs.append(tf)
        at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        lists = {k: pa.ListArray.from_arrays(at, pa.array(np.concatenate(v), pa.int32())) for k, v in (("terms", terms), ("tfs", tfs))}
        return {"doc_id": batch.column(0), "n": np.concatenate(n)} | lists

    return over_batches(docs, count, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def statistics(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each term of the vocabulary."""
    whole = counts.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the vocabulary
        df[r["term"]] = r["count"]
    return whole["N"], whole["L"], df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    m = 10 + 90 * n * n_docs // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Block:
    """Some documents, inverted: groups of one term and impact in order of term and falling impact."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.n_docs = len(lengths)
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.terms, self.impact = terms, impact
        doc = np.repeat(np.arange(self.n_docs), lengths)
        key = (terms << IMPACT_BITS) | (IMPACTS - impact)
        order = np.argsort(key, kind="stable")
        order = order[impact[order] > 0]
        key = key[order]
        self.docs = doc[order]
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        self.groups = key[self.starts[:-1]]
        self.bounds = np.searchsorted(self.groups, np.arange(n_terms + 1) << IMPACT_BITS)

    def heads(self, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The next unread impact of each term, or 0."""
        left = at < last
        out = np.zeros(len(at), np.int64)
        out[left] = IMPACTS - (self.groups[at[left]] & IMPACTS)
        return out

    def postings(self, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, impact, place of the term) of the groups between two places of each term."""
        n_groups = to - at
        term = np.repeat(np.arange(len(at)), n_groups)
        group = np.arange(len(term)) + np.repeat(at - np.concatenate([[0], np.cumsum(n_groups)[:-1]]), n_groups)
        size = self.starts[group + 1] - self.starts[group]
        place = np.arange(int(size.sum())) + np.repeat(self.starts[group] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.docs[place], np.repeat(IMPACTS - (self.groups[group] & IMPACTS), size), np.repeat(term, size)

    def complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The whole scores of some documents, from their own terms."""
        return np.array([self.impact[a:b][np.isin(self.terms[a:b], terms, assume_unique=True)].sum() for a, b in zip(self.at[docs], self.at[docs + 1])], np.int64)

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all of this block's best k that reach `least`, a score that k documents elsewhere have; a few more may follow."""
        at, last = self.bounds[terms], self.bounds[terms + 1]
        heads = self.heads(at, last)
        scores = np.zeros(self.n_docs, np.int64)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        while heads.any():
            least = max(least, int(np.partition(scores, self.n_docs - k)[self.n_docs - k])) if self.n_docs >= k else least
            if heads.sum() < least:  # no document that was not met yet can be among the best
                could = scores + heads.sum()
                for docs, term in seen:
                    np.subtract.at(could, docs, heads[term])
                left = np.flatnonzero((could >= least) & (scores > 0))
                if len(left) <= k:
                    return left, self.complete(left, terms)
            # at least the highest group, and all others close to it
            level = int(heads.max()) * 3 // 4
            to = np.clip(np.searchsorted(self.groups, (terms << IMPACT_BITS) | (IMPACTS - level), "right"), at, last)
            docs, impact, term = self.postings(at, to)
            np.add.at(scores, docs, impact)
            seen.append((docs, term))
            at, heads = to, self.heads(to, last)
        found = np.flatnonzero(scores >= max(least, 1))
        if len(found) > k:
            floor = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= floor]
        return found, scores[found]


def best_of(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~known, -scores))[:k]
    return ids[order], known[order], scores[order]


def scan(counts: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): the best k documents of each partition for each query."""
    schema = "query int, doc_id long, score long"
    names, types = ["query", "doc_id", "score"], arrow_types(counts, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [empty] * len(queries)
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            first = 0
            while first < batch.num_rows:
                upto = (ends[first - 1] if first else 0) + BLOCK_POSTINGS
                last = max(first + 1, int(np.searchsorted(ends, upto, "right")))
                part, lengths = batch.slice(first, last - first), sizes[first:last]
                first = last
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                terms, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                n = np.repeat(part.column(1).to_numpy(zero_copy_only=False), lengths)
                block = Block(lengths, terms, impacts(weight[terms], tf, n, n_docs, length), len(weight))
                for q, asked in enumerate(queries):
                    mine = best[q]
                    docs, scores = block.search(asked, k, int(mine[2][-1]) if len(mine[2]) == k else 0)
                    if len(docs):
                        best[q] = best_of(*(np.concatenate(x) for x in zip(mine, (ids[docs], known[docs], scores))), k)
        n = [len(x) for x, _, _ in best]
        if sum(n):
            found = pa.array(np.concatenate([x[0] for x in best]), mask=~np.concatenate([x[1] for x in best]))
            yield record({"query": np.repeat(np.arange(len(n)), n), "doc_id": found, "score": np.concatenate([x[2] for x in best])}, names, types)

    return counts.where(F.size("terms") > 0).mapInArrow(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of all partitions: first within parts of each query's rows, then of the parts."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("at") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def item_terms(texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The terms of each text, once each, as places in the vocabulary of all of them; and that vocabulary."""
    each = [t for _, found, bounds in terms_of(texts) for t in (found[a:b] for a, b in zip(bounds[:-1], bounds[1:]))]
    every = pa.chunked_array(each, pa.large_binary()).combine_chunks() if each else pa.array([], pa.large_binary())
    vocabulary = every.unique()
    return [np.unique(pc.index_in(t, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)) for t in each], vocabulary


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score for each row of items."""
    read = keyed_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    asked = staged(asked.groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items", small=True)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_blocks = 1 if size["n"] <= block_items and size["chars"] <= block_chars else -(-2 * size["n"] // block_items) + -(-2 * size["chars"] // block_chars)
    results = []
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else asked
        own = block.toArrow()
        queries, vocabulary = item_terms(own.column("text").combine_chunks())
        counts = staged(counted(read, vocabulary), f"counts-{b}")
        n_docs, length, df = statistics(counts, len(vocabulary))
        found = ranked(scan(counts, queries, weights(n_docs, df), n_docs, length, k), k)
        about = list(zip(range(len(own)), zip(own.column("item_id").to_pylist(), own.column("copies").to_pylist())))  # the block's items
        named = docs.sparkSession.createDataFrame(about, f"query int, about struct<item_id: {asked.schema['item_id'].dataType.simpleString()}, copies: long>")
        out = found.join(F.broadcast(named), "query").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("about.copies"))))
        out = out.select(F.col("about.item_id").alias("item_id"), "rank", "doc_id", "score")
        results.append(out if n_blocks == 1 else staged(out, f"found-{b}", small=True))
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
