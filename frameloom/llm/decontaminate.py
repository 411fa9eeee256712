"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of `min_match` tokens become a candidate. For each
candidate, Karp-Rabin hashes of unmarked windows are matched at falling window lengths; the longest
matches are marked first, tiles never overlap, and tiling ends when no unmarked match of `min_match`
tokens is left. An item counts as leaked if its tiles cover at least `coverage` of its tokens, in whatever
order its passages stand in the document.

The benchmark is cut into blocks of a bounded number of tokens; one block at a time goes to the tasks as
a sorted table of seed hashes, and every document is read once per block. With more than one block each
block's result is written to the shared folder and its broadcast removed before the next. Nothing of the
corpus is shuffled, and a passage that many documents share is work for each of them alone.

Defined results: tokens are runs of letters and digits in ASCII lower case; null and empty texts have
none; an item with fewer than min_match tokens matches only a document whose tokens are the item's, with
coverage 1 in one tile; items without tokens never match; items with equal texts are all reported, rows that
repeat an item's id and text once; rows that repeat a document id are each reported. Ids keep their types.
Only the ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.frames import keyed_texts, named, numbered, over_batches
from frameloom.llm.text import LOWER, NON_ALNUM, chunks, mix, power_tables, shingle_hashes, span_hashes, words
from frameloom.session import staged

MIN_MATCH = 5
COVERAGE = 0.5
#: Window length at which tiling starts.
FIRST_LENGTH = 20
#: Tokens of the benchmark that go to the tasks at once.
BLOCK_TOKENS = 1_000_000


def tokens(column: pa.Array):
    """(row, token hashes) of each text."""
    for first, data, offsets in chunks(column):
        data = LOWER[data]
        start, end, bounds = words(data, offsets, NON_ALNUM)
        h = span_hashes(data, start, end)
        for i in range(len(offsets) - 1):
            yield first + i, h[bounds[i] : bounds[i + 1]]


def windows(t: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rolling hashes) of the windows of `size` tokens without a marked one."""
    n = len(t) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = power_tables(len(t))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * power)])
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[size:] == marked[:n])
    return at, mix((total[at + size] - total[at]) * inverse[at])


def longest_matches(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, item place, text place) of the matches of at least `size` unmarked tokens, from Karp-Rabin hits."""
    at_item, h_item = windows(item, free_item, size)
    at_text, h_text = windows(text, free_text, size)
    if not len(at_item) or not len(at_text):
        return []
    order = np.argsort(h_item, kind="stable")
    h_item, at_item = h_item[order], at_item[order]
    low, high = np.searchsorted(h_item, h_text), np.searchsorted(h_item, h_text, "right")
    found = []
    reached: dict[int, int] = {}  # per diagonal, the end of the last match
    for k in np.flatnonzero(high > low):
        t = int(at_text[k])
        for p in sorted(at_item[low[k] : high[k]].tolist()):
            if reached.get(t - p, -1) > t or not (text[t : t + size] == item[p : p + size]).all():
                continue
            n = size
            while t + n < len(text) and p + n < len(item) and free_text[t + n] and free_item[p + n] and text[t + n] == item[p + n]:
                n += 1
            found.append((n, p, t))
            reached[t - p] = t + n
    return found


def tile(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (length, item place, text place): longest first, then by item place, then by text place."""
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(FIRST_LENGTH, len(item)))
    while True:
        found = longest_matches(text, item, free_text, free_item, size)
        longest = max(found)[0] if found else 0
        if not found and size == min_match:
            return tiles
        if not found or longest > 2 * size:
            size = longest or max(min_match, size // 2)
            continue
        for n, p, t in sorted(m for m in found if m[0] == longest):
            if free_item[p : p + n].all() and free_text[t : t + n].all():
                free_item[p : p + n] = False
                free_text[t : t + n] = False
                tiles.append((n, p, t))


class Block:
    """Items of one block: their tokens, and the seeds sorted by hash."""

    def __init__(self, rows: list[tuple], min_match: int):
        self.ids = [r[0] for r in rows]
        self.items = [t for _, t in tokens(pa.array([r[1] for r in rows], pa.string()))] if rows else []
        seeds = [shingle_hashes(t, min_match) for t in self.items]
        self.short: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.items):
            if 0 < len(t) < min_match:
                self.short.setdefault(t.tobytes(), []).append(i)
        self.owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        self.place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        every = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner, self.place = every[order], self.owner[order], self.place[order]
        self.first16 = np.zeros(1 << 16, bool)
        self.first16[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def leaks(self, text: np.ndarray, min_match: int, coverage: float) -> list[tuple]:
        """(item, coverage, tiles, longest tile) of the items that the document covers."""
        if len(text) < min_match:
            return [(self.ids[i], 1.0, 1, len(text)) for i in self.short.get(text.tobytes(), ())]
        h = shingle_hashes(text, min_match)
        h = h[self.first16[(h >> np.uint64(48)).astype(np.int64)]] if len(h) else h
        if not len(h) or not len(self.seeds):
            return []
        h = np.unique(h)
        low, high = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        at = np.concatenate([np.arange(low[k], high[k]) for k in hit])
        found = []
        for i in np.unique(self.owner[at]):
            item = self.items[i]
            # tiles consist of seeds, so they cover no more than all shared seeds do
            shared = np.zeros(len(item), bool)
            for p in self.place[at][self.owner[at] == i]:
                shared[p : p + min_match] = True
            if shared.sum() < coverage * len(item):
                continue
            tiles = tile(text, item, min_match)
            covered = sum(n for n, _, _ in tiles) / len(item)
            if covered >= coverage:
                found.append((self.ids[i], covered, len(tiles), max(n for n, _, _ in tiles)))
        return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_tokens: int = BLOCK_TOKENS) -> tuple[int, Iterator[Block]]:
    """(number of blocks, the benchmark in blocks of about block_tokens tokens at most)."""
    items = keyed_texts(benchmark, id_col, text_col).where(F.col("text").isNotNull()).dropDuplicates()
    items = staged(items, "benchmark-items", small=True)
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-chars // (3 * block_tokens)))
    part = lambda b: items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == b).collect()
    return n, (Block(sorted(((r[0], r[1]) for r in part(b)), key=repr), min_match) for b in range(n))


def block_by_block(docs: DataFrame, n: int, each: Iterator[Block], step, name: str) -> Iterator[DataFrame]:
    """step(block) for each block; with more than one, each result is written before the next block is sent."""
    for block in each:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        made = step(shared)
        if n > 1:
            made = staged(made, name)
            shared.destroy()
        yield made


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) of every document and item it covers."""
    n, each = blocks(benchmark, item_id_col, item_text_col, min_match, block_tokens)
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_id_col)))

    def step(shared) -> DataFrame:
        def report(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0).to_pylist()
            out = [(ids[i], *leak) for i, t in tokens(batch.column(1)) for leak in shared.value.leaks(t, min_match, coverage)]
            cols = list(zip(*out)) or [[]] * 5
            return dict(zip(("doc_id", "item_id", "coverage", "n_tiles", "longest_tile"), cols))

        return over_batches(keyed_texts(docs, id_col, text_col), report, f"doc_id {kind}, item_id {item_kind}, coverage double, n_tiles int, longest_tile int")

    parts = list(block_by_block(docs, n, each, step, "leaks"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that cover no item, with all their columns."""
    kept, at = numbered(docs)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    place = docs.columns.index(text_col)
    n, each = blocks(benchmark, item_id_col, item_text_col, min_match, block_tokens)

    def step(shared) -> DataFrame:
        def clean(batch: pa.RecordBatch) -> dict:
            good = np.ones(batch.num_rows, bool)
            for i, t in tokens(batch.column(place)):
                good[i] = not shared.value.leaks(t, min_match, coverage)
            rows = batch.filter(pa.array(good))
            return {f"in_{i}": rows.column(i) for i in range(rows.num_columns)}

        return over_batches(kept, clean, kinds)

    for kept in block_by_block(docs, n, each, step, "clean"):  # each block reads what the ones before it left
        pass
    return named(kept, at)
