"""Video metadata from pluggable probes, and the differences between what they report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.columns import or_else, rational

PROBED = "path string, rate string, frames long, height int, width int, duration double, created timestamp, error string"


def probed(files: DataFrame, probe: Callable[[str], dict], path: str = "path") -> DataFrame:
    """One row per file from a probe (path -> fields of PROBED); a failing probe leaves its error, not a lost row."""
    names = [x.split()[0] for x in PROBED.split(", ")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for p in pdf[path]:
                try:
                    rows.append({"path": p, **probe(p), "error": None})
                except Exception as e:  # whatever a plug-in raises is that file's result
                    rows.append({"path": p, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return files.select(path).mapInPandas(run, PROBED)


def inventory(first: DataFrame, second: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Two probes side by side: frames and rate with the second as fallback, duration, and whether the rates disagree."""
    a, b = first.select("path", *(F.col(c).alias(f"a_{c}") for c in ("rate", "frames"))), second.select("path", *(F.col(c).alias(f"b_{c}") for c in ("rate", "frames")))
    out = a.join(b, "path", "full_outer").withColumns({"a_fps": rational(F.col("a_rate")), "b_fps": rational(F.col("b_rate"))})
    frames, fps = or_else(F.col("a_frames"), F.col("b_frames")), or_else(F.col("a_fps"), F.col("b_fps"))
    return out.select("path", frames.alias("frames"), fps.alias("fps"), F.try_divide(frames, fps).alias("duration_s"), F.coalesce(F.abs(F.col("a_fps") - F.col("b_fps")) > tolerance, F.lit(False)).alias("disagree"))
