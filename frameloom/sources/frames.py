"""Frame sequences as a Spark data source: one partition per video, frames in decode order.

A codec is a plug-in: anything that yields (frame number, height, width, grey bytes) for a video. The one
built in makes a seeded moving square over noise, for tests and demonstrations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "video string, frame long, height int, width int, pixels binary"


def moving_square(seed: int, frames: int, height: int = 48, width: int = 64, side: int = 8, noise: float = 2.0, still: bool = False, enters: int = 0) -> Iterator[np.ndarray]:
    """Grey frames with a bright square that moves one pixel a frame, or stands still, over seeded noise, from frame `enters` on."""
    rng = np.random.default_rng(seed)
    for k in range(frames):
        image = np.full((height, width), 90.0) + rng.normal(0, noise, (height, width))
        x = 0 if still else k % (width - side)
        if k >= enters:
            image[height // 2 - side // 2 : height // 2 + side // 2, x : x + side] = 220
        yield np.clip(image, 0, 255).astype(np.uint8)


class FrameSource(DataSource):
    """format "frames": options videos, frames, seed, height, width, still, noise, enters."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


class FrameReader(DataSourceReader):
    def __init__(self, options):
        at = lambda k, d: int(options.get(k, d))
        self.videos, self.frames, self.seed = at("videos", 2), at("frames", 30), at("seed", 7)
        self.height, self.width, self.enters = at("height", 48), at("width", 64), at("enters", 0)
        self.noise = float(options.get("noise", 2.0))
        self.still = str(options.get("still", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(v) for v in range(self.videos)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        v = partition.value
        for k, image in enumerate(moving_square(self.seed + v, self.frames, self.height, self.width, noise=self.noise, still=self.still, enters=self.enters)):
            yield f"v{v}", k, self.height, self.width, image.tobytes()
