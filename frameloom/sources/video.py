"""Video files as rows of frames: any store that Spark reads, any codec that a plug-in decodes.

Files are read by Spark's binary source, so paths may be remote. A decoder is a function from a file's bytes
to an iterator of (height, width, bytes of grey or of blue, green and red); a header reader is one to a dict of rate, frames, height and
width. The ones built in read YUV4MPEG2, an uncompressed public format: a header line of space-separated
fields, then for each frame a line that begins with FRAME and the planes of its picture. Files packed by gzip are read too.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.sources.frames import SCHEMA

# The steps between chroma samples down and across, by the header's colour space; 4:2:0 is the default.
CHROMA = {"C420": (2, 2), "C422": (1, 2), "C444": (1, 1), "Cmono": None}


def y4m_header(content: bytes) -> dict:
    """rate (`25/1`), height, width, steps between chroma samples, bytes of a picture's chroma, and where the frames begin."""
    end = content.index(b"\n")
    fields = content[:end].decode("ascii").split(" ")
    if fields[0] != "YUV4MPEG2":
        raise ValueError("not a YUV4MPEG2 file")
    by = {f[0]: f[1:] for f in fields[1:] if f}
    width, height = int(by["W"]), int(by["H"])
    space = next((c for c in CHROMA if ("C" + by.get("C", "420")).startswith(c)), None)
    if space is None:
        raise ValueError(f"colour space {by['C']} is not known")
    steps = CHROMA[space]
    chroma = 2 * -(-height // steps[0]) * -(-width // steps[1]) if steps else 0
    return {"rate": by.get("F", "0:0").replace(":", "/"), "height": height, "width": width, "steps": steps, "chroma": chroma, "first": end + 1}


def opened(content: bytes) -> BinaryIO:
    """A file's bytes as a stream; gzip, told from its first two bytes, is unpacked as it is read."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def read_whole(file: BinaryIO, size: int) -> bytes:
    """The next bytes, or fewer at the end of the file, even of one whose packing is cut off."""
    try:
        return file.read(size)
    except EOFError:
        return b""


def y4m_pictures(content: bytes) -> Iterator[tuple[dict, memoryview, memoryview]]:
    """(header, luma, chroma) of every whole frame; a file that ends within a frame ends before it."""
    with opened(content) as file:
        head = y4m_header(file.readline())
        size = head["width"] * head["height"]
        while True:
            try:
                mark = file.readline()
            except EOFError:
                return
            body = memoryview(read_whole(file, size + head["chroma"])) if mark.startswith(b"FRAME") and mark.endswith(b"\n") else memoryview(b"")
            if len(body) < size + head["chroma"] or not len(mark):
                return
            yield head, body[:size], body[size:]


def y4m_frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """The luma of every frame."""
    for head, luma, _ in y4m_pictures(content):
        yield head["height"], head["width"], bytes(luma)


# The public 8-bit integer form of BT.601 with luma from 16 to 235, in 256ths; rows are blue, green and red of
# luma and both chroma values, and back.
FROM_CHROMA = ((298, 516, 0), (298, -100, -208), (298, 0, 409))
TO_CHROMA = ((25, 129, 66), (112, -74, -38), (-18, -94, 112))


def mixed(table: tuple[tuple[int, int, int], ...], planes: np.ndarray) -> list[np.ndarray]:
    """Rows of 256ths of three planes (..., 3, height, width) of whole numbers, rounded."""
    return [(sum(k * planes[..., i, :, :] for i, k in enumerate(row) if k) + 128) >> 8 for row in table]


def to_bgr(planes: np.ndarray) -> np.ndarray:
    """(..., height, width, 3) in blue, green and red of whole planes (..., 3, height, width) of luma, blue and red chroma."""
    centred = planes.astype(np.int32) - np.array([16, 128, 128], np.int32)[:, None, None]
    return np.stack([np.clip(x, 0, 255).astype(np.uint8) for x in mixed(FROM_CHROMA, centred)], axis=-1)


def to_ycbcr(bgr: np.ndarray) -> np.ndarray:
    """Planes (3, height, width) of a picture in blue, green and red."""
    planes = np.ascontiguousarray(np.moveaxis(bgr, 2, 0)).astype(np.int32)
    return np.stack([(x + k).astype(np.uint8) for x, k in zip(mixed(TO_CHROMA, planes), (16, 128, 128))])


#: Bytes of pictures that are turned into colours at once.
AT_ONCE = 1 << 18


def y4m_colour_frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Every frame in blue, green and red; a chroma sample holds for all pixels of its block, and mono frames have none."""
    held: list[tuple[memoryview, memoryview]] = []
    head: dict = {}

    def colours() -> Iterator[tuple[int, int, bytes]]:
        n, height, width = len(held), head["height"], head["width"]
        planes = np.full((n, 3, height, width), 128, np.uint8)
        planes[:, 0] = np.frombuffer(b"".join(luma for luma, _ in held), np.uint8).reshape(n, height, width)
        if head["steps"]:
            down, across = head["steps"]
            small = np.frombuffer(b"".join(chroma for _, chroma in held), np.uint8).reshape(n, 2, -(-height // down), -(-width // across))
            planes[:, 1:] = small.repeat(down, axis=2)[:, :, :height].repeat(across, axis=3)[..., :width]
        for picture in to_bgr(planes):
            yield height, width, picture.tobytes()

    for head, luma, chroma in y4m_pictures(content):
        held.append((luma, chroma))
        if len(held) * len(luma) >= AT_ONCE:
            yield from colours()
            held.clear()
    if held:
        yield from colours()


def y4m_probe(content: bytes) -> dict:
    """What the container says: the number of frames follows from the file's length."""
    with opened(content) as file:
        head = y4m_header(file.readline())
        body = 0
        while part := read_whole(file, 1 << 20):
            body += len(part)
    each = len(b"FRAME\n") + head["width"] * head["height"] + head["chroma"]
    return {"rate": head["rate"], "frames": body // each, "height": head["height"], "width": head["width"]}


def video_files(spark: SparkSession, root: str, videos: DataFrame, video: str = "video") -> DataFrame:
    """(video, path, content) of the named videos: below root, or else by base name in root/videos; null if in neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    tail = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + r".*?\Q" + "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/" + r"\E", "")
    known = files.select("path").withColumn("_tail", tail)  # names meet paths, so that contents move once
    wanted = videos.select(F.col(video).alias("video")).distinct().withColumn("_base", F.concat(F.lit("videos/"), F.element_at(F.split("video", "/"), -1)))
    here = wanted.join(known, F.col("video") == F.col("_tail"), "left").select("video", "_base", "path")
    lost = here.where("path IS NULL").select("video", "_base").join(known, F.col("_base") == F.col("_tail"), "left").select("video", "path")
    return here.where("path IS NOT NULL").select("video", "path").unionByName(lost).join(files, "path", "left").select("video", "path", "content")


def decoded(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple[int, int, bytes]]] = y4m_frames) -> DataFrame:
    """(video, frame, height, width, pixels), frames from 0 in decode order; one file is held at a time."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in pdfs:
            for video, content in zip(pdf["video"], pdf["content"]):
                rows: list[tuple] = []
                for k, (height, width, pixels) in enumerate(decoder(content)):
                    rows.append((video, k, height, width, pixels))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.where("content IS NOT NULL").select("video", "content").mapInPandas(run, SCHEMA)


def decoded_counts(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple[int, int, bytes]]] = y4m_frames, probe: Callable[[bytes], dict] = y4m_probe) -> DataFrame:
    """(video, decoded, said, rate, height, width, error): frames that decode against what the container says; no pixels leave the task."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["video", "decoded", "said", "rate", "height", "width", "error"]
        for pdf in pdfs:
            rows = []
            for video, content in zip(pdf["video"], pdf["content"]):
                try:
                    head = probe(content)
                    rows.append((video, sum(1 for _ in decoder(content)), head["frames"], head["rate"], head["height"], head["width"], None))
                except Exception as e:  # whatever a plug-in raises is that file's result
                    rows.append((video, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("video", "content").mapInPandas(run, "video string, decoded long, said long, rate string, height int, width int, error string")


def count_mismatches(counts: DataFrame) -> DataFrame:
    """Videos whose decoded frames are not as many as the container says, or that do not decode."""
    return counts.where(F.col("error").isNotNull() | (F.col("decoded") != F.col("said")))
