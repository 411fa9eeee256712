"""Streams of frames with state per video: the background pass and the clips around proposals.

Frames of a video arrive in order across micro-batches, in any order within one; how the input is cut into
micro-batches changes nothing, so both equal their batch forms. A frame that is not later than one already seen
is a repetition of a source that replays and is passed over. State is typed columns in a RocksDB store, written
with every micro-batch, so a query that restarts from its checkpoint goes on in the middle of a video.

A video without new frames for `idle_ms` loses its state by a timer, so state does not grow with all videos
ever seen; a frame that comes later starts it afresh. With None state is kept and no timer is set.

A micro-batch's frames of one video are held by one task; the source's rate limits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frameloom.session import scratch, staged
from frameloom.streaming.background import FOREGROUND, SampleModel, crop, found_in, image_of
from frameloom.streaming.tubelets import CLIPS, wanted_by
from frameloom.streaming.windows import IDLE_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PerVideo(StatefulProcessor):
    """Order, repetitions and idle timers of a video; what is made of its frames is left to `advance`."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "frame long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.next.get()[0] if self.next.exists() else None
        new = pd.concat(list(rows)).sort_values("frame", kind="stable").drop_duplicates("frame")
        new = new if due is None else new[new["frame"] >= due]
        if len(new):
            out = self.advance(key[0], list(new.itertuples(index=False)))
            self.next.update((int(new["frame"].iloc[-1]) + 1,))
            if out:
                yield pd.DataFrame(out, columns=self.names)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.next.clear()
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class Background(PerVideo):
    """A model per video: its planes of samples, their size and the random generator between micro-batches."""

    names = [x.split()[0] for x in FOREGROUND.split(", ")]

    def __init__(self, idle_ms: int | None, seed: int, low: float, high: float):
        super().__init__(idle_ms)
        self.seed, self.low, self.high = seed, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.about = handle.getValueState("about", "height int, width int, generator string")
        self.planes = handle.getListState("planes", "plane binary")

    def advance(self, video: str, frames: list) -> list[tuple]:
        model = SampleModel(self.seed)
        if self.about.exists():
            height, width, generator = self.about.get()
            model.restore([bytes(p[0]) for p in self.planes.get()], generator, height, width)
        out = []
        for r in frames:
            out += found_in(model, video, r.frame, image_of(r.pixels, r.height, r.width), self.low, self.high)
        planes, generator = model.saved()
        self.about.update((*model.samples.shape[1:], generator))
        self.planes.put([(p,) for p in planes])
        return out

    def forget(self) -> None:
        self.about.clear()
        self.planes.clear()


class Clips(PerVideo):
    """The last frames of a video; a frame that completes a window gives the clips of all proposals at its centre."""

    names = [x.split()[0] for x in CLIPS.split(", ")]

    def __init__(self, idle_ms: int | None, length: int, size: int, padding: float, method: str):
        super().__init__(idle_ms)
        self.length, self.size, self.padding, self.method = length, size, padding, method

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buffer = handle.getListState("buffer", "frame long, height int, width int, pixels binary")

    def advance(self, video: str, frames: list) -> list[tuple]:
        window = [(f, image_of(bytes(p), h, w)) for f, h, w, p in self.buffer.get()] if self.buffer.exists() else []
        out = []
        for r in frames:
            if window and r.frame != window[-1][0] + 1:
                window = []
            window = [*window[-(self.length - 1) :], (r.frame, image_of(r.pixels, r.height, r.width))] if self.length > 1 else [(r.frame, image_of(r.pixels, r.height, r.width))]
            if len(window) == self.length and r.wanted is not None:
                out += [self.clip(video, window, p) for p in r.wanted]
        kept = window[-(self.length - 1) :] if self.length > 1 else []
        self.buffer.put([(f, *image.shape[:2], image.tobytes()) for f, image in kept]) if kept else self.buffer.clear()
        return out

    def clip(self, video: str, window: list[tuple[int, np.ndarray]], p) -> tuple:
        side = max(p["w"], p["h"]) * (1 + 2 * self.padding)
        parts = [crop(image, p["x"] + p["w"] / 2, p["y"] + p["h"] / 2, side, self.size, method=self.method) for _, image in window]
        centre = window[(self.length - 1) // 2][0]
        return p["proposal"], video, centre, self.length, max(share for _, share in parts), b"".join(part.tobytes() for part, _ in parts)

    def forget(self) -> None:
        self.buffer.clear()


def foreground_stream(frames: DataFrame, seed: int = 20, low: float = 0.0, high: float = 1.0, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The rows of `background.foreground` from a stream of (video, frame, height, width, pixels)."""
    mode = "None" if idle_ms is None else "ProcessingTime"
    return frames.select("video", "frame", "height", "width", "pixels").groupBy("video").transformWithStateInPandas(Background(idle_ms, seed, low, high), FOREGROUND, "Append", mode)


def clip_stream(proposals: DataFrame, frames: DataFrame, length: int, size: int, padding: float, method: str = "linear", idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The rows of `tubelets.assembled` from a stream of frames and a table of proposals.

    Proposals meet the frame that completes their window, the one (length - 1) - (length - 1) // 2 after their
    centre; the proposals of one frame travel with it. Windows at the ends of a video or with a frame missing
    are never completed: `tubelets.dropped` and `fill_counts` of the result name and count them.
    """
    wanted = staged(wanted_by(proposals, length), "wanted")  # every micro-batch reads it
    rows = frames.join(wanted, ["video", "frame"], "left").select("video", "frame", "height", "width", "pixels", "wanted")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("video").transformWithStateInPandas(Clips(idle_ms, length, size, padding, method), CLIPS, "Append", mode)


def drained(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream until its source has nothing more, into a table of the shared folder, and read that.

    With the checkpoint and table of an earlier call it goes on where that one ended.
    """
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, name), checkpoint or scratch(spark, f"{name}-checkpoint")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the only store that takes typed state; a query keeps what it started with
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set(PROVIDER, before)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)
