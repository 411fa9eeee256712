"""Growing folders of video files as a stream of frames, with an offset for each video.

`write_videos` puts a table of frames into YUV4MPEG2 files, one a video; the data source "video_stream" reads
the frames that have come since. Frames of such a file have one size, so an offset is a number of frames, a range
of them is one read at a place in the file, and a failed micro-batch is repeated from the same ranges.

The source may only plan forward: what it has planned is kept in the folder `progress`, written before Spark sees it, so
a query that restarts from its checkpoint plans from there even though Spark does not tell a source where it was.
Paths are read by Arrow's file systems (local folders, HDFS and object stores alike).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from frameloom.sources.frames import SCHEMA
from frameloom.sources.video import to_bgr, to_ycbcr, y4m_header
from frameloom.streaming.background import by_video, image_of

#: The longest header line that is looked for.
HEAD_BYTES = 4096
MARK = b"FRAME\n"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def encoded(height: int, width: int, pixels: bytes) -> bytes:
    """A frame's mark and planes: luma alone of a grey one, three whole planes of one in blue, green and red."""
    image = image_of(pixels, height, width)
    return MARK + (image.tobytes() if image.ndim == 2 else to_ycbcr(image).tobytes())


def header(height: int, width: int, channels: int, rate: str = "25:1") -> bytes:
    return f"YUV4MPEG2 W{width} H{height} F{rate} {'Cmono' if channels == 1 else 'C444'}\n".encode()


def write_videos(frames: DataFrame, path: str, in_order: bool = False, packed: bool = False) -> None:
    """Write each video of (video, frame, height, width, pixels) to `path`/video.y4m, its frames in order of their number.

    A task streams a video into a file of its own and moves it to its name at the end, over an older one: readers
    see whole files only, and a task that is repeated leaves the same. in_order: each video comes from one task
    and in order already. packed: files are written through gzip; `sources.video` reads them frame by frame, a
    stream, which looks for places in a file, does not.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = store_of(path)
        fs.create_dir(root, recursive=True)
        video, out, part = None, None, None

        def done() -> None:
            if out is not None:
                out.close()
                fs.move(part, f"{root}/{video}.y4m")

        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                if r.video != video:
                    done()
                    video, part = r.video, f"{root}/.{r.video}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part, compression="gzip" if packed else None)
                    out.write(header(r.height, r.width, len(r.pixels) // (r.height * r.width)))
                out.write(encoded(r.height, r.width, r.pixels))
        done()
        yield pd.DataFrame({"video": [] if video is None else [video]})

    ordered = by_video(frames.select("video", "frame", "height", "width", "pixels"), in_order)
    ordered.mapInPandas(run, "video string").write.format("noop").mode("overwrite").save()


class Layout(NamedTuple):
    """Where the frames of a file stand."""

    height: int
    width: int
    channels: int
    first: int
    size: int


def layout_of(head: bytes) -> Layout:
    """Layout of a mono or 4:4:4 file; other colour spaces are for `sources.video.decoded`."""
    h = y4m_header(head)
    pixels = h["height"] * h["width"]
    if h["chroma"] not in (0, 2 * pixels):
        raise ValueError("only mono and 4:4:4 files are streamed")
    return Layout(h["height"], h["width"], 1 if not h["chroma"] else 3, h["first"], len(MARK) + pixels + h["chroma"])


class VideoStream(DataSource):
    """format "video_stream": options path, progress, and frames_per_batch of each video (0: all there are)."""

    @classmethod
    def name(cls) -> str:
        return "video_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> VideoStreamReader:
        return VideoStreamReader(self.options)


#: Frames that a task reads at least, if there are as many, and the most tasks of a micro-batch but for one.
TASK_FRAMES, TASKS = 1024, 128


class Ranges(InputPartition):
    """(video, start, stop): frames `start` to `stop` of each of some videos."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(tuple(ranges))
        self.ranges = ranges


class VideoStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.progress = options["path"], options["progress"]
        self.limit = int(options.get("frames_per_batch", 0))
        self.layouts: dict[str, Layout] = {}  # files grow, their headers stay

    def initialOffset(self) -> dict:
        return {}

    def planned(self) -> dict:
        fs, root = store_of(self.progress)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        last = max((f for f in found if f.base_name.isdigit()), key=lambda f: int(f.base_name), default=None)
        if last is None:
            return {}
        with fs.open_input_stream(last.path) as f:
            return json.loads(f.read())

    def plan(self, offset: dict) -> None:
        """The plans are numbered; the one before is kept as well, in case the newest was cut off."""
        fs, root = store_of(self.progress)
        fs.create_dir(root, recursive=True)
        names = sorted(int(f.base_name) for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.isdigit())
        number = names[-1] + 1 if names else 0
        with fs.open_output_stream(f"{root}/.{number}") as f:
            f.write(json.dumps(offset).encode())
        fs.move(f"{root}/.{number}", f"{root}/{number}")
        for old in names[:-1]:
            fs.delete_file(f"{root}/{old}")

    def latestOffset(self) -> dict:
        fs, root = store_of(self.path)
        at = self.planned()
        upto = dict(at)
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".y4m") and not f.base_name.startswith("."):
                video = f.base_name.removesuffix(".y4m")
                if video not in self.layouts:
                    with fs.open_input_file(f.path) as whole:
                        self.layouts[video] = layout_of(whole.read(HEAD_BYTES))
                there = self.layouts[video]
                have = max(0, (f.size - there.first) // there.size)
                start = at.get(video, 0)
                upto[video] = max(start, min(have, start + self.limit) if self.limit else have)
        upto = {v: n for v, n in sorted(upto.items()) if n}
        if upto != at:
            self.plan(upto)
        return upto

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of many videos share a task: the number of tasks does not grow with the videos."""
        new = [(v, start.get(v, 0), n) for v, n in end.items() if n > start.get(v, 0)]
        each = max(TASK_FRAMES, sum(n - a for _, a, n in new) // TASKS)
        parts, room = [], 0
        for r in new:
            if room <= 0:
                parts.append([])
                room = each
            parts[-1].append(r)
            room -= r[2] - r[1]
        return [Ranges(p) for p in parts]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for video, start, stop in partition.ranges:
            yield from self.frames(video, start, stop)

    def frames(self, video: str, start: int, stop: int) -> Iterator[tuple]:
        fs, root = store_of(self.path)
        with fs.open_input_file(f"{root}/{video}.y4m") as whole:
            there = layout_of(whole.read(HEAD_BYTES))
            whole.seek(there.first + start * there.size)
            for k in range(start, stop):
                body = whole.read(there.size)[len(MARK) :]
                if there.channels == 3:
                    planes = np.frombuffer(body, np.uint8).reshape(3, there.height, there.width)
                    body = to_bgr(planes).tobytes()
                yield video, k, there.height, there.width, body

    def commit(self, end: dict) -> None:
        pass
