"""Line deduplication across documents, by range-partitioned line hashes.

Each document sends one row per distinct line key (128-bit hash, the positions of the key's lines);
texts are not in these rows. The rows are range-partitioned and sorted by key, document and position, so
one pass over a partition sees each key's documents in order. The pass needs to remember fewer rows than
`min_docs`: a key's lines are held back until enough documents have been seen, and from then on stream
straight out. The range also covers the document, so a key that a third of all documents share is dealt
over many partitions; only the first and last key of a partition can go on in another one, and their
document counts are added up afterwards. What comes back is a compressed bitmap of each document that loses
lines; where texts are wanted, they move once to meet their bitmaps.

Defined results: a null or empty text is one empty line; keys shorter than `min_chars` code points are
never dropped; rows with the same id and the same text count as one document and get the same result;
rows with the same id and different texts are different documents; null ids are allowed. An empty table
gives an empty result. Ids are integers or cast to long. Columns other than the named two are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.frames import arrow_types, keyed_texts, named, numbered, over_batches, record
from frameloom.session import staged

#: What both ends of a line lose before it is compared.
BLANKS = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc_id long, version long, places binary"
MARKS = "kind int, h1 long, h2 long, doc_id long, version long, places binary, docs long"
#: Kinds of marks: lines to drop; lines whose key may go on in another partition; documents of such a key.
DROP, OPEN, COUNT = 0, 1, 2


def line_keys(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """Line key to the positions of its lines, for keys that are long enough."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip(BLANKS).lower()
        if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
            found.setdefault(key, []).append(i)
    return found


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, version, bitmap) of documents that lose lines; version is the hash of the text.

    A key is repeated if at least min_docs documents hold it. All its lines are dropped or, with
    keep_first, all but its first line in the first document by id. See `unpack` for the bitmap.
    """
    min_chars = max(1, min_chars)

    def split(batch: pa.RecordBatch) -> dict:
        h1, h2, ids, versions, places = [], [], [], [], []
        for doc, text, version in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for key, at in line_keys(text, min_chars).items():
                whole = xxhash.xxh3_128_intdigest(key)
                h1.append((whole >> 64) - (1 << 63))
                h2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                ids.append(doc)
                versions.append(version)
                places.append(np.array(at, "<u4").tobytes())
        return {"h1": h1, "h2": h2, "doc_id": ids, "version": versions, "places": places}

    texts = keyed_texts(docs, id_col, text_col).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = over_batches(texts, split, LINES)
    order = ["h1", "h2", "doc_id", "version"]
    sorted_lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    names, types = [x.split()[0] for x in MARKS.split(", ")], arrow_types(docs, MARKS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []  # fewer than min_docs rows
        key, last, count, first_key = None, None, 0, True

        def close(ends_partition: bool) -> None:
            if key is None:
                return
            if first_key or ends_partition:
                out.append((COUNT, *key, None, None, None, count))
                out.extend((OPEN, *key, *row, 0) for row in held)
            held.clear()

        for batch in batches:
            for h1, h2, doc, version, places in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (h1, h2) != key:
                    close(False)
                    first_key = key is None
                    key, last, count = (h1, h2), None, 0
                if (doc, version) == last:
                    continue
                last = (doc, version)
                count += 1
                row = (doc, version, places)
                if count < min_docs:
                    held.append(row)
                    continue
                out.extend((DROP, *key, *x, 0) for x in held)
                held.clear()
                out.append((DROP, *key, *row, 0))
            if len(out) > 10_000:
                yield record(dict(zip(names, zip(*out))), names, types)
                out.clear()
        close(True)
        if out:
            yield record(dict(zip(names, zip(*out))), names, types)

    marks = staged(sorted_lines.mapInArrow(stream, MARKS), "line-marks")
    repeated = marks.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    late = marks.where(F.col("kind") == OPEN).join(repeated, ["h1", "h2"], "left_semi")
    drops = marks.where(F.col("kind") == DROP).unionByName(late)
    if keep_first:
        first = drops.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version")).alias("first"))
        drops = drops.join(first, ["h1", "h2"]).withColumn("kept", F.struct("doc_id", "version") == F.col("first"))
    else:
        drops = drops.withColumn("kept", F.lit(False))
    per_doc = drops.groupBy("doc_id", "version").agg(F.collect_list(F.struct("places", "kept")).alias("drops"))

    def pack(batch: pa.RecordBatch) -> dict:
        maps = []
        for rows in batch.column(2).to_pylist():
            at = np.concatenate([np.frombuffer(r["places"], "<u4")[int(r["kept"]) :] for r in rows]).astype(np.int64)
            bits = np.ones(-(-(int(at.max(initial=-1)) + 1) // 8) * 8, np.uint8)
            bits[at] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        return {"doc_id": batch.column(0), "version": batch.column(1), "bitmap": maps}

    return over_batches(per_doc, pack, "doc_id long, version long, bitmap binary")


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of a document's lines stay; lines past the end of the bitmap do."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """(lines, lines dropped, the lines that stay joined by newlines)."""
    text = text or ""
    if bitmap is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    keep = unpack(bitmap, len(lines))
    return len(lines), int(len(lines) - keep.sum()), "\n".join(x for x, k in zip(lines, keep) if k)


def with_bitmaps(docs: DataFrame, id_col: str, text_col: str, **rule) -> DataFrame:
    """docs with the column _bitmap (null: nothing goes); texts move once, bitmaps are the build side."""
    bitmaps = drop_bitmaps(docs, id_col, text_col, **rule).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("bitmap").alias("_bitmap"))
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_version"))
    return keyed.join(bitmaps.hint("shuffle_hash"), same, "left").drop("_text_hash", "_doc", "_version")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs, each text without its dropped lines; all other columns as they were."""
    clean = F.pandas_udf(lambda t, b: t.combine(b, lambda x, y: x if y is None else kept_text(x, y)[2]), "string")
    rows, at = numbered(docs)
    text = F.col(at[text_col])
    joined = with_bitmaps(rows, at[id_col], at[text_col], **rule)
    return named(joined.withColumn(at[text_col], F.when(F.col("_bitmap").isNull(), text).otherwise(clean(text, F.col("_bitmap")))), at)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays, per row of docs."""

    def report(batch: pa.RecordBatch) -> dict:
        n, dropped, sha = [], [], []
        for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            a, b, kept = kept_text(text, bitmap)
            n.append(a)
            dropped.append(b)
            sha.append(hashlib.sha256(kept.encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_lines": n, "n_dropped": dropped, "kept_sha256": sha}

    joined = with_bitmaps(keyed_texts(docs, id_col, text_col), "doc_id", "text", **rule)
    return over_batches(joined.select("doc_id", "text", "_bitmap"), report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
