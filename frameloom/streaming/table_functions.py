"""Frame kernels as table functions of SQL.

    SELECT * FROM frame_components(TABLE(frames) PARTITION BY video ORDER BY frame)

gives the rows of `background.foreground`: a background model per video, in one pass over its frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from frameloom.streaming.background import FOREGROUND, SampleModel, found_in, image_of

COLUMNS = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in FOREGROUND.split(", ")])


def component_function(seed: int = 20, low: float = 0.0, high: float = 1.0):
    """An Arrow table function over frames (video, frame, height, width, pixels) that are partitioned by video and ordered by frame."""

    class Components:
        def __init__(self) -> None:
            self.video, self.model = None, None

        def eval(self, frames: pa.RecordBatch) -> Iterator[pa.Table]:
            out: list[tuple] = []
            for video, frame, height, width, pixels in zip(*(frames.column(c).to_pylist() for c in ("video", "frame", "height", "width", "pixels"))):
                if self.model is None or video != self.video:
                    self.video, self.model = video, SampleModel(seed)
                out += found_in(self.model, video, frame, image_of(pixels, height, width), low, high)
            yield pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(COLUMNS)], schema=COLUMNS)

    return F.arrow_udtf(Components, returnType=FOREGROUND)


def register(spark: SparkSession, name: str = "frame_components", **settings) -> None:
    spark.udtf.register(name, component_function(**settings))
