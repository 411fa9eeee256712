"""Token ids in a fixed-width binary format, and the encoding of a corpus into it.

A shard file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary
allows. Ids are packed in groups of 64, which fill exactly `bits` 64-bit words, so lane i of every group
sits at the same place and numpy packs or unpacks all groups with one shift per lane. Groups form blocks
of `BLOCK` ids; the block offsets in the header let a reader fetch any range of ids without touching the
rest. Layout, little-endian: magic, bits, ids, documents, blocks (u8 each); offset of each block and of
the end (u8); first id of each document and the end (u8); the packed blocks.

A corpus is range-partitioned by document id, sorted, and encoded partition by partition into shards of a
bounded number of ids. Each shard is a file in the shared folder, written under a name of its own and moved to
its place when it is whole; the index of the shards is a table that Spark's writer commits, so what lost or
repeated tasks leave is in no index. The report and ranges of ids are read from the files by their block
offsets, through Arrow's file systems; locally a shard can be mapped by numpy as well. Only one row per
partition is needed to turn places within a partition into places in the corpus.

Encoding: texts are cut into the library's pre-tokens with numpy, a batch at once, and each distinct
pre-token is encoded by the tokenizers library once per worker. Texts with characters whose kind depends on
the version of Unicode, or with an added token's string, are given to the library whole.

Defined results: a null or empty text has the end id alone; null ids come first; rows that repeat an id
are documents of their own, in order of their text hashes; ids are integers or cast to long. Other columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.frames import arrow_types, keyed_texts, record
from frameloom.llm.text import CHUNK_BYTES, chunks, span_hashes
from frameloom.session import scratch, staged
from frameloom.sources.video_stream import store_of

MAGIC = 0x3144495754584946
GROUP = 64
NATIVE = {8: "<u1", 16: "<u2", 32: "<u4"}
BLOCK = 4096
SHARD_IDS = 1 << 20
#: Blocks that are read at once.
RUN_BLOCKS = 64
#: Distinct pieces, and characters of pieces, that a worker remembers before it starts over.
CACHE_PIECES = 1_200_000
CACHE_POINTS = 1 << 25
#: Slots of the table of pieces, as a power of two; characters of the longest piece that is remembered.
TABLE_BITS = 22
LONG = 256


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Whole groups of `bits` 64-bit words; the last group is filled with zeros."""
    groups = -(-len(ids) // GROUP)
    if bits in NATIVE:  # the same layout as numpy's own little-endian integers
        out = np.zeros(groups * GROUP, NATIVE[bits])
        out[: len(ids)] = ids
        return out.view("<u8")
    lanes = np.zeros((groups, GROUP), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for i in range(GROUP):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(packed: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n ids."""
    if bits in NATIVE:
        return packed.view(NATIVE[bits])[:n].astype(np.uint32)
    groups = packed.reshape(-1, bits)
    out = np.empty((len(groups), GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(GROUP):
        word, shift = divmod(i * bits, 64)
        lane = groups[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | groups[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = lane & mask
    return out.reshape(-1)[:n]


def write_shard(ids: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """A file image; starts: first id of each document, and the number of ids."""
    blocks = -(-len(ids) // BLOCK)
    packed = pack(ids, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (BLOCK // GROUP * bits * 8), packed.nbytes)
    head = np.array([MAGIC, bits, len(ids), len(starts) - 1, blocks], "<u8")
    return b"".join((head.tobytes(), offsets.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), packed.astype("<u8").tobytes()))


class Shard:
    """A reader over a file image (bytes or a memory map)."""

    def __init__(self, image):
        self.image = image
        self.read_head()

    def bytes_at(self, at: int, n: int):
        return memoryview(self.image)[at : at + n]

    def read_head(self) -> None:
        head = np.frombuffer(self.bytes_at(0, 40), "<u8")
        if int(head[0]) != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.bits, self.n_ids, self.n_docs, self.n_blocks = (int(x) for x in head[1:])
        at = 40
        self.offsets = np.frombuffer(self.bytes_at(at, 8 * (self.n_blocks + 1)), "<u8").astype(np.int64)
        self.starts_at = at + 8 * (self.n_blocks + 1)
        self.at = self.starts_at + 8 * (self.n_docs + 1)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self.bytes_at(self.starts_at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first:last; only the blocks that hold them are read."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        packed = np.frombuffer(self.bytes_at(self.at + int(self.offsets[a]), int(self.offsets[b] - self.offsets[a])), "<u8")
        return unpack(packed, min(last, self.n_ids) - a * BLOCK, self.bits)[first - a * BLOCK :]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class StoredShard(Shard):
    """A reader over a file in whatever store its path names; it counts the bytes it has read."""

    def __init__(self, path: str):
        fs, inner = store_of(path)
        self.file, self.read_bytes = fs.open_input_file(inner), 0
        self.read_head()

    def bytes_at(self, at: int, n: int):
        self.file.seek(at)
        self.read_bytes += n
        return self.file.read(n)

    def __enter__(self) -> StoredShard:
        return self

    def __exit__(self, *raised) -> None:
        self.file.close()


#: Kinds of characters to a byte-level pre-tokeniser; FAR ones are left to the library.
SPACES, LETTERS, NUMBERS, OTHERS, FAR = range(5)
# Fixed value: the code points that are white space below U+10000.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What byte-level pre-tokenisation cuts off after an apostrophe.
SHORTENED = ["s", "t", "m", "d", "re", "ve", "ll"]


def char_kinds() -> np.ndarray:
    """The kind of each code point below U+10000.

    Libraries know different versions of Unicode. A code point counts as far unless it has the same kind
    in an early version and in this Python's, and so in those between.
    """
    kinds = np.full(1 << 16, FAR, np.uint8)
    groups = {"L": LETTERS, "N": NUMBERS, "Z": SPACES}
    for c in range(1 << 16):
        now, early = (x.category(chr(c)) for x in (unicodedata, unicodedata.ucd_3_2_0))
        if "C" not in (now[0], early[0]) or now == early == "Cc":
            found = {SPACES if c in WHITE else groups.get(x[0], OTHERS) for x in (now, early)}
            if len(found) == 1 and (found != {SPACES} or c in WHITE):
                kinds[c] = found.pop()
    return kinds


def token_starts(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where byte-level pre-tokens begin; text i is points[bounds[i]:bounds[i + 1]].

    A pre-token is a run of one kind, with the single space before it; of several white-space characters
    in a row the last one is apart if something follows; an apostrophe that begins a pre-token takes one
    of the shortened endings with it.
    """
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = edge[:n]
    white = kinds == SPACES
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    led = np.zeros(n, bool)
    led[1:] = points[:-1] == 32
    start &= first | white | ~led
    last = white & ~edge[1:]
    last[:-1] &= ~white[1:]
    start |= last
    marks = np.flatnonzero(points == 39)
    marks = marks[start[marks]]
    if len(marks):
        stop = bounds[np.searchsorted(bounds, marks, "right")]
        for ending in SHORTENED:
            here = marks + len(ending) < stop
            for k, c in enumerate(ending, 1):
                here[here] &= points[marks[here] + k] == ord(c)
            start[marks[here] + 1] = False
            after = marks[here] + 1 + len(ending)
            start[after[after < stop[here]]] = True
    return np.flatnonzero(start)


def long_cuts(data: np.ndarray) -> np.ndarray:
    """Offsets of parts of about CHUNK_BYTES of one text, cut where a space follows a visible ASCII character.

    A pre-token begins there whatever stands around it, so the parts are encoded by themselves.
    """
    cuts = [0]
    while len(data) - cuts[-1] > 2 * CHUNK_BYTES:
        at = cuts[-1] + CHUNK_BYTES
        while at < len(data):
            part = data[at - 1 : at + CHUNK_BYTES]
            found = np.flatnonzero((part[1:] == 32) & (part[:-1] > 32) & (part[:-1] < 127))
            if len(found):
                break
            at += CHUNK_BYTES
        if at >= len(data):
            break
        cuts.append(at + int(found[0]))
    return np.array([*cuts, len(data)], np.int64)


def byte_letters() -> np.ndarray:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letters = np.arange(256, dtype="<u4")
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


class Encoder:
    """A tokenizers file, with the ids of the pre-tokens seen so far.

    A batch of texts is cut into pre-tokens by numpy passes over its code points. A pre-token is looked up
    by hash in an open table and compared with what is stored there character by character; new ones
    go to the library's model. Texts with far characters or an added token's string, and all texts of a
    tokenizer with other rules, go to the library whole. The memory starts over at a fixed size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.vocabulary = self.tool.get_vocab_size(with_added_tokens=True)
        kind = json.loads(self.tool.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.cuts = bool(kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.letters, self.kinds = byte_letters(), char_kinds()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slots = np.full(1 << TABLE_BITS, -1, np.int32)
        self.n_pieces = self.used = self.used_points = 0
        self.lengths, self.begin = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.sizes, self.points_begin = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.flat, self.points = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint32)

    def room(self, name: str, n: int) -> np.ndarray:
        """The array of that name, doubled until n values fit."""
        x = getattr(self, name)
        while len(x) < n:
            x = np.concatenate([x, np.zeros_like(x)])
        setattr(self, name, x)
        return x

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece stored under each hash, or -1."""
        at = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = self.slots[at]
        more = np.flatnonzero((found >= 0) & (self.keys[at] != h))
        while len(more):
            at = (at[more] + 1) & (len(self.slots) - 1) if len(at) != len(more) else (at + 1) & (len(self.slots) - 1)
            slot = self.slots[at]
            found[more] = slot
            wrong = (slot >= 0) & (self.keys[at] != h[more])
            more, at = more[wrong], at[wrong]
        return found

    def keep(self, h: np.ndarray, pieces: np.ndarray) -> None:
        """Store pieces under distinct hashes that are not in the table."""
        at = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.slots[at[put]] = h[put], pieces[put]
            rest = np.ones(len(h), bool)
            rest[put] = False
            h, pieces, at = h[rest], pieces[rest], (at[rest] + 1) & (len(self.slots) - 1)

    def learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, the spans of points."""
        size = end - start
        upto = np.concatenate([[0], np.cumsum(size)])
        own = points[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)]
        wide = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
        cut = np.concatenate([[0], np.cumsum(wide)])[upto].tolist()
        raw = np.frombuffer(own.tobytes().decode("utf-32-le").encode(), np.uint8)
        text = self.letters[raw].tobytes().decode("utf-32-le")
        tokenize = self.model.tokenize
        gc.disable()  # very many short lists, and no cycles
        try:
            made = [[t.id for t in tokenize(text[a:b])] for a, b in zip(cut, cut[1:])]
        finally:
            gc.enable()
        n = np.fromiter(map(len, made), np.int64, len(made))
        have, total = self.n_pieces, int(n.sum())
        self.n_pieces += len(made)
        for name, values in (("lengths", n), ("begin", self.used + np.cumsum(n) - n), ("sizes", size), ("points_begin", self.used_points + upto[:-1])):
            self.room(name, self.n_pieces)[have : self.n_pieces] = values
        self.room("flat", self.used + total)[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.room("points", self.used_points + len(own))[self.used_points : self.used_points + len(own)] = own
        self.used += total
        self.used_points += len(own)
        return np.arange(have, self.n_pieces)

    def pieces(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece number of every span; the spans follow each other without gaps."""
        h = span_hashes(points, start, end)
        at = self.find(h)
        long = end - start > LONG
        at[long] = -1
        missing = np.flatnonzero((at < 0) & ~long)
        if len(missing):
            fresh, first, own = np.unique(h[missing], return_index=True, return_inverse=True)
            made = self.learn(points, start[missing[first]], end[missing[first]])
            self.keep(fresh, made)
            at[missing] = made[own]
        size = self.sizes[at].astype(np.int64)
        right = (at >= 0) & (size == end - start)
        where = np.flatnonzero(right)
        size = size[where]
        begin = np.cumsum(size) - size
        every = np.arange(int(size.sum()))
        same = self.points[every + np.repeat(self.points_begin[at[where]] - begin, size)] == points[every + np.repeat(start[where] - begin, size)]
        if not same.all():  # two pieces of one hash
            right[where[np.unique(np.searchsorted(begin, np.flatnonzero(~same), "right") - 1)]] = False
        alone = np.flatnonzero(~right)
        if len(alone):
            at[alone] = self.learn(points, start[alone], end[alone])
        return at

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a buffer."""
        if self.n_pieces > CACHE_PIECES or self.used_points > CACHE_POINTS:
            self.clear()
        text = data.tobytes().decode()
        bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = len(bounds) - 1
        hard = np.full(n, not self.cuts)
        for a in self.added:
            at = text.find(a)
            while at >= 0:
                hard[np.searchsorted(bounds, at, "right") - 1] = True
                at = text.find(a, at + 1)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(points):
            return [np.zeros(0, np.uint32)] * n
        kinds = self.kinds[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(kinds == FAR)
        hard[np.searchsorted(bounds, far, "right") - 1] = True
        if hard.all():
            start = np.zeros(0, np.int64)
        else:
            start = token_starts(points, kinds, bounds)
        end = np.append(start[1:], len(points))[: len(start)]
        own = np.searchsorted(start, bounds)
        if hard.any():
            easy = ~np.repeat(hard, np.diff(own))
            start, end = start[easy], end[easy]
            own = np.concatenate([[0], np.cumsum(np.where(hard, 0, np.diff(own)))])
        at = self.pieces(points, start, end)
        size = self.lengths[at].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.arange(upto[-1]) + np.repeat(self.begin[at] - upto[:-1], size)]
        upto = upto[own]
        return [self.whole(text[bounds[i] : bounds[i + 1]]) if hard[i] else flat[upto[i] : upto[i + 1]] for i in range(n)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, number of ids of each)."""
        parts, end = [], np.array([end_id], np.uint32)
        for _, data, offsets in chunks(texts):
            if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES and self.cuts and not any(a.encode() in data.tobytes() for a in self.added):
                cuts = long_cuts(data)
                rows = [np.concatenate([x for a, b in zip(cuts, cuts[1:]) for x in self.encode_rows(data[a:b], np.array([0, b - a]))])]
            else:
                rows = self.encode_rows(data, offsets)
            for ids in rows:
                parts += ids, end
        counts = np.array([len(x) + 1 for x in parts[::2]], np.int64)
        return np.concatenate(parts) if parts else end[:0], counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARDS = "part long, shard long, first long, n_ids long, doc_ids binary, nulls binary, path string"


def put(path: str, image: bytes) -> None:
    """Write a file beside its place and move it there, so that it is there whole or not at all."""
    fs, inner = store_of(path)
    folder, name = inner.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/.{name}") as out:
        out.write(image)
    fs.move(f"{folder}/.{name}", inner)


def write_corpus(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The index of the written shards: part and shard number, first id within the part, ids, documents, and the file's path."""
    root = scratch(docs.sparkSession, "packed-ids-files")
    names, types = [x.split()[0] for x in SHARDS.split(", ")], arrow_types(docs, SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits = bits_for(tool.vocabulary)
        ids, counts, doc_ids = [], [], []
        pending = first = shard = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(counts)
            whole = np.concatenate(ids)
            known = pa.chunked_array(doc_ids)
            path = f"{root}/{part}-{shard}-{uuid.uuid4().hex}.ids"
            put(path, write_shard(whole, np.concatenate([[0], np.cumsum(n)]), bits))
            numbers = known.fill_null(0).to_numpy().astype("<i8").tobytes()
            nulls = np.packbits(known.is_null().to_numpy()).tobytes() if known.null_count else b""
            return record(dict(zip(names, ([x] for x in (part, shard, first, len(whole), numbers, nulls, path)))), names, types)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                got, n = tool.encode(rows.column(1), end_id)
                ids.append(got)
                counts.append(n)
                doc_ids.append(rows.column(0))
                pending += len(got)
                if pending >= shard_ids:
                    yield flush()
                    first, shard, pending = first + pending, shard + 1, 0
                    ids, counts, doc_ids = [], [], []
        if pending:
            yield flush()

    texts = keyed_texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one id are dealt by their texts, and equal rows by where they come from
    placed = texts.withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()})
    ordered = placed.repartitionByRange("doc_id", "hash", "origin").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return staged(ordered.mapInArrow(run, SHARDS), "packed-ids-index")


def with_base(shards: DataFrame) -> DataFrame:
    """The index with `start`, each shard's first id in the corpus."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("first"))  # one row per partition of the written index


def doc_crcs(shard: Shard) -> list[int]:
    """The checksum of each document's ids, read in runs of whole blocks."""
    crcs, run_ids = [0] * shard.n_docs, RUN_BLOCKS * BLOCK
    doc = 0
    for a in range(0, shard.n_ids, run_ids):
        ids = shard.ids(a, min(a + run_ids, shard.n_ids)).astype("<u4")
        while doc < shard.n_docs and shard.starts[doc] < a + len(ids):
            first, last = max(shard.starts[doc], a), min(shard.starts[doc + 1], a + len(ids))
            crcs[doc] = zlib.crc32(ids[first - a : last - a], crcs[doc])
            if shard.starts[doc + 1] > a + len(ids):
                break
            doc += 1
    return crcs


def corpus_report(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens and ids_crc32 of every document."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    schema = ", ".join(f"{n} long" for n in names)
    types = arrow_types(shards, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, nulls, path in zip(*(batch.column(k).to_pylist() for k in range(4))):
                known = np.frombuffer(doc_ids, "<i8")
                missing = np.unpackbits(np.frombuffer(nulls, np.uint8))[: len(known)].astype(bool) if nulls else None
                with StoredShard(path) as shard:
                    yield record({"doc_id": pa.array(known, pa.int64(), mask=missing), "start": start + shard.starts[:-1], "n_tokens": np.diff(shard.starts), "ids_crc32": doc_crcs(shard)}, names, types)

    # the files are what is large, not the index, so its rows are dealt out
    return with_base(shards).select("start", "doc_ids", "nulls", "path").repartition("path").mapInArrow(read, schema)


def id_range(shards: DataFrame, first: int, last: int) -> DataFrame:
    """(start, ids) pieces of the ids first:last of the corpus; of each file only the blocks that hold them are read."""
    schema = "start long, ids array<int>"
    types = arrow_types(shards, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with StoredShard(path) as shard:
                    a, b = max(0, first - start), min(last - start, shard.n_ids)
                    for at in range(a, b, RUN_BLOCKS * BLOCK):
                        ids = shard.ids(at, min(at + RUN_BLOCKS * BLOCK, b)).astype(np.int32)
                        yield record({"start": [start + at], "ids": pa.array([ids], pa.list_(pa.int32()))}, ["start", "ids"], types)

    near = (F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)
    return with_base(shards).where(near).select("start", "path").mapInArrow(read, schema)
