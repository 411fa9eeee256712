"""Frames made from rows of rectangles, so that what a frame holds can be told from a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.sources.frames import SCHEMA
from frameloom.streaming.background import by_video


def painted(rows: DataFrame, height: int, width: int, back: tuple[int, ...], in_order: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """(video, frame, height, width, pixels) from rows of (video, frame, x, y, w, h, shade).

    shade is an array of as many values as `back`, the background's: one for grey, three for colour. Rectangles
    are cut off at the borders; of those that overlap the one last in order of place, size and shade is on top.
    A row with null x makes an empty frame.

    in_order: the frames of a video come from one task, in order. Then the rows are dealt and sorted before a pixel
    is painted, so that frames need not be moved. wanted: a table of (video, frame, wanted) as `tubelets.wanted_by`
    makes it, whose column goes along with the frames.
    """
    rect = F.struct("x", "y", "w", "h", "shade")
    frames = rows.groupBy("video", "frame").agg(F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), rect))).alias("rects"))
    schema, names = SCHEMA, ["video", "frame", "height", "width", "pixels"]
    carries = wanted is not None
    if carries:
        frames = frames.join(wanted, ["video", "frame"], "left").select("video", "frame", "rects", "wanted")
        schema, names = f"{SCHEMA}, wanted {wanted.schema['wanted'].dataType.simpleString()}", [*names, "wanted"]
    frames = by_video(frames) if in_order else frames

    def paint(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for video, frame, rects in zip(pdf["video"], pdf["frame"], pdf["rects"]):
                image = np.empty((height, width, len(back)), np.uint8)
                image[:] = back
                for r in rects:
                    image[max(0, r["y"]) : max(0, r["y"] + r["h"]), max(0, r["x"]) : max(0, r["x"] + r["w"])] = r["shade"]
                out.append((video, frame, height, width, image.tobytes()))
            made = pd.DataFrame(out, columns=names[:5])
            yield made.assign(wanted=pdf["wanted"]) if carries else made

    return frames.mapInPandas(paint, schema)
