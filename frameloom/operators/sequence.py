"""Runs, drift and windows over frame-ordered tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str], frame: str):
    return Window.partitionBy(*by).orderBy(frame)


def segments(df: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """df with `segment`: a new one starts wherever the frame does not follow its predecessor."""
    order = _order(by, frame)
    jump = F.coalesce((F.col(frame) - F.lag(frame).over(order) != 1).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn("segment", F.sum("_jump").over(order)).drop("_jump")


def steps(df: DataFrame, by: list[str], frame: str = "frame", fps: float = 25.0) -> DataFrame:
    """Drift between consecutive frames: dx, dy, distance, per second, and over the former box's side."""
    order = _order(by, frame)
    before = lambda c: F.lag(c).over(order)
    out = df.withColumns({"dx": F.col("cx") - before("cx"), "dy": F.col("cy") - before("cy"), "_side": F.sqrt(before("w") * before("h")), "_next": F.col(frame) - before(frame)}).where("_next = 1")
    far = F.hypot("dx", "dy")
    return out.withColumns({"displacement": far, "per_s": far * fps, "over_size": F.try_divide(far, "_side")}).drop("_side", "_next")


def window_drift(df: DataFrame, by: list[str], lengths: list[int], frame: str = "frame") -> DataFrame:
    """Per track and window length: largest distance between the ends of an unbroken window, also over the first box's side.

    All lengths look ahead from each frame in one pass over one order.
    """
    order = _order(by, frame)
    ahead = lambda c, n: F.lead(c, n - 1).over(order)
    far = {n: F.when(ahead(frame, n) - F.col(frame) == n - 1, F.hypot(ahead("cx", n) - F.col("cx"), ahead("cy", n) - F.col("cy"))) for n in lengths}
    rows = df.select(*by, F.sqrt(F.first("w").over(order) * F.first("h").over(order)).alias("side"), *(c.alias(f"far_{n}") for n, c in far.items()))
    each = rows.groupBy(*by).agg(F.max("side").alias("side"), *(F.max(f"far_{n}").alias(f"far_{n}") for n in lengths))
    drift = F.explode(F.array(*(F.struct(F.lit(n).alias("length"), F.col(f"far_{n}").alias("drift")) for n in lengths))).alias("d")
    return each.select(*by, "side", drift).select(*by, F.col("d.drift").alias("drift"), (F.col("d.drift") / F.col("side")).alias("over_size"), F.col("d.length").alias("length"))


def pairwise_runs(df: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """Per track: the longest run in which each centre stays within half a box of its predecessor, earliest first."""
    order = Window.partitionBy(*by, "segment").orderBy(frame)
    still = (F.abs(F.col("cx") - F.lag("cx").over(order)) <= F.col("w") / 2) & (F.abs(F.col("cy") - F.lag("cy").over(order)) <= F.col("h") / 2)
    rows = segments(df, by, frame).withColumn("_break", F.coalesce((~still).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_break").over(order))
    runs = rows.groupBy(*by, "segment", "_run").agg(F.count("*").alias("run_frames"), F.min(frame).alias("run_start"))
    return _longest(runs, by)


def reached(v: np.ndarray, half: np.ndarray) -> np.ndarray:
    """For each start the first later place whose value is further than `half` away, or the end.

    Level k of a table holds the least and greatest of 2**k values from each place on. All starts gallop at once
    from the longest step to the shortest, taking each step whose values stay near, so a start costs a
    logarithm and the table that many numbers a place. Values that are not numbers are near to all.
    """
    n = len(v)
    low, high = [v], [v]
    while 2 ** len(low) <= n:
        step = 2 ** (len(low) - 1)
        low.append(np.fmin(low[-1][:-step], low[-1][step:]))
        high.append(np.fmax(high[-1][:-step], high[-1][step:]))
    at = np.arange(n)
    for k in range(len(low) - 1, -1, -1):
        start = np.flatnonzero(at + 2**k <= n)
        to = at[start]
        far = (high[k][to] - v[start] > half[start]) | (v[start] - low[k][to] > half[start])
        at[start[~far]] += 2**k
    return at


#: Segments of fewer frames are walked rather than tabled.
FEW = 12


def longest_anchored(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """(length, start) of the longest stretch whose centres stay in the box of its first frame; the first of equals."""
    if len(x) < 2:
        return len(x), 0
    if len(x) < FEW:
        rows = list(zip(x.tolist(), y.tolist(), (w / 2).tolist(), (h / 2).tolist()))
        best, at = 0, 0
        for s, (cx, cy, dx, dy) in enumerate(rows):
            e = next((e for e in range(s + 1, len(rows)) if abs(rows[e][0] - cx) > dx or abs(rows[e][1] - cy) > dy), len(rows))
            if e - s > best:
                best, at = e - s, s
        return best, at
    start = np.arange(len(x))
    stays = np.maximum(np.minimum(reached(x, w / 2), reached(y, h / 2)), start + 1) - start
    return int(stays.max()), int(stays.argmax())


def anchored_runs(df: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """Per track: the longest run whose centres all lie inside the box of the run's first frame, earliest first.

    Each start has its own box, which no running aggregate can follow, and a self-join would be quadratic
    in a segment. Tracks are dealt over tasks and sorted; a task streams through and holds one segment.
    """
    columns = ["cx", "cy", "w", "h"]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best, rows = None, (0, 0), []

        def close() -> tuple[int, int]:
            if len(rows) <= best[0]:  # no run of the segment can be longer
                return best
            n, at = longest_anchored(*(np.array(c, float) for c in list(zip(*rows))[1:]))
            return (n, rows[at][0]) if n > best[0] else best

        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                this, f = r[: len(by)], r[len(by)]
                if this != key:
                    best = close()
                    if key is not None:
                        out.append((*key, *best))
                    key, best, rows = this, (0, 0), []
                elif f != rows[-1][0] + 1:
                    best = close()
                    rows = []
                rows.append(r[len(by) :])
            yield pd.DataFrame(out, columns=[*by, "run_frames", "run_start"])
        if key is not None:
            yield pd.DataFrame([(*key, *close())], columns=[*by, "run_frames", "run_start"])

    ordered = df.select(*by, F.col(frame).cast("long"), *(F.col(c).cast("double") for c in columns)).repartition(*by).sortWithinPartitions(*by, frame)
    return ordered.mapInPandas(run, f"{kinds}, run_frames long, run_start long")


def _longest(runs: DataFrame, by: list[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("run_frames")).alias("order"), "run_start"))
    return runs.groupBy(*by).agg(best.alias("best")).select(*by, (-F.col("best.order")).alias("run_frames"), F.col("best.run_start").alias("run_start"))


def first_sustained(df: DataFrame, by: list[str], below: float, value: str, min_run: int, frame: str = "frame") -> DataFrame:
    """Per group: the first frame from which min_run rows in a row lie below a level; null if none do."""
    w = _order(by, frame).rowsBetween(-(min_run - 1), 0)
    low = F.count_if(F.col(value) < below).over(w)
    start = F.min(F.col(frame)).over(w)
    return df.withColumn("_at", F.when(low == min_run, start)).groupBy(*by).agg(F.min("_at").alias("first_frame"))


def full_windows(df: DataFrame, by: list[str], lead: int, trail: int, frame: str = "frame") -> DataFrame:
    """Rows whose whole window of frames is present."""
    w = _order(by, frame).rangeBetween(-lead, trail)
    return df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == lead + trail + 1).drop("_n")


def early_stop(df: DataFrame, by: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """df with best (so far), epochs_since_best and stopped: whether patience had run out by then."""
    order = Window.partitionBy(*by).orderBy(epoch)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    better = F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True))
    rows = df.withColumn("best", F.max(value).over(so_far)).withColumn("_at", F.when(better, F.col(epoch)))
    rows = rows.withColumn("epochs_since_best", F.col(epoch) - F.max("_at").over(so_far))
    return rows.withColumn("stopped", F.max((F.col("epochs_since_best") >= patience).cast("int")).over(so_far) == 1).drop("_at")


def cadence(df: DataFrame, by: list[str], at: str, duration: str) -> DataFrame:
    """Gap in seconds to the former row, and slack: the gap less the former row's duration."""
    order = Window.partitionBy(*by).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = (micros - F.lag(micros).over(order)) / 1e6
    return df.withColumn("gap_s", gap).withColumn("slack_s", gap - F.lag(duration).over(order)).where(F.col("gap_s").isNotNull())


def whole_tracks(df: DataFrame, by: list[str], at_least: int, frame: str = "frame") -> DataFrame:
    """Tracks without a gap and with room for a window: first and last frame, number of frames."""
    out = df.groupBy(*by).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("n_frames"))
    return out.where((F.col("last_frame") - F.col("first_frame") == F.col("n_frames") - 1) & (F.col("n_frames") >= at_least))
