"""Spatial matching of detections and annotated boxes, labelling, and frame-to-frame association."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.columns import overlap_1d

TRACKED = ["video", "frame", "idx", "cx", "cy", "track_id", "ratio"]


def coverages(blobs: DataFrame, gts: DataFrame, by: tuple[str, ...] = ("frame",), keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, blob, gt, coverage, blob_area, keep): share of each annotated box that each detection of its frame covers.

    An equi-join on the frame; the overlap is arithmetic. A box without area has coverage 0. keep are columns of
    the annotated boxes that go along, so that nothing has to be joined back.
    """
    a = blobs.select(*by, F.col("idx").alias("blob"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    b = gts.select(*by, F.col("idx").alias("gt"), "x", "y", "w", "h", *keep)
    c = lambda name: F.col(name)
    share = covered(c("bx"), c("by"), c("bw"), c("bh"))
    return a.join(b, list(by)).select(*by, "blob", "gt", share.alias("coverage"), (c("bw") * c("bh")).alias("blob_area"), *keep)


def covered(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Share of the box in columns x, y, w and h that the box given covers; 0 where it has no area."""
    c = lambda name: F.col(name)
    both = overlap_1d(x, x + w, c("x"), c("x") + c("w")) * overlap_1d(y, y + h, c("y"), c("y") + c("h"))
    area = c("w") * c("h")
    return F.when(area > 0, both / area).otherwise(F.lit(0.0))


def best_in_frame(blobs: DataFrame, gts: DataFrame, by: tuple[str, ...] = ("frame",), keep: tuple[str, ...] = ()) -> DataFrame:
    """What `best_per_gt` gives for the `coverages` of annotated boxes that differ in (by, idx).

    A frame's few detections meet each of its annotated boxes as one list, so that no task sorts a row per pair.
    """
    found = blobs.groupBy(*by).agg(F.collect_list(F.struct("idx", "x", "y", "w", "h")).alias("blobs"))
    order = lambda b: F.struct((-covered(b["x"], b["y"], b["w"], b["h"])).alias("order"), b["idx"].alias("blob"), (b["w"] * b["h"]).alias("blob_area"))
    rows = gts.select(*by, F.col("idx").alias("gt"), "x", "y", "w", "h", *keep).join(found, list(by))
    out = rows.select(*by, "gt", F.array_min(F.transform("blobs", order)).alias("best"), F.size("blobs").cast("long").alias("n_blobs"), *keep)
    return out.select(*by, "gt", F.col("best.blob").alias("blob"), (-F.col("best.order")).alias("coverage"), F.col("best.blob_area").alias("blob_area"), "n_blobs", *keep)


def best_per_gt(pairs: DataFrame, by: tuple[str, ...] = ("frame",), keep: tuple[str, ...] = ()) -> DataFrame:
    """The best detection of each annotated box, with its kept columns: highest coverage, then the first detection."""
    best = F.min(F.struct((-F.col("coverage")).alias("order"), "blob", "blob_area"))
    out = pairs.groupBy(*by, "gt").agg(best.alias("best"), F.count("*").alias("n_blobs"), *(F.first(c).alias(c) for c in keep))
    return out.select(*by, "gt", F.col("best.blob").alias("blob"), (-F.col("best.order")).alias("coverage"), F.col("best.blob_area").alias("blob_area"), "n_blobs", *keep)


def greedy(pairs: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One-to-one assignment per frame: highest coverage first, ties to the first detection, then the first box.

    A frame's few pairs are folded in that order with the ends taken so far; no Python runs.
    """
    rows = pairs.where(F.col("coverage") >= threshold).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("order"), "blob", "gt"))).alias("rows"))
    kind = "array<struct<order:double,blob:bigint,gt:bigint>>"
    fold = F.aggregate(
        F.col("rows").cast(kind),
        F.array().cast(kind),
        lambda taken, r: F.when(F.exists(taken, lambda t: (t["blob"] == r["blob"]) | (t["gt"] == r["gt"])), taken).otherwise(F.array_append(taken, r)),
    )
    taken = rows.select(*by, F.explode(fold).alias("t"))
    return taken.select(*by, F.col("t.blob").alias("blob"), F.col("t.gt").alias("gt"), (-F.col("t.order")).alias("coverage"))


def labelled(blobs: DataFrame, pairs: DataFrame, assigned: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(by, blob, label, gt, best): positive if assigned, negative if it covers nothing, ignored between."""
    best = pairs.groupBy(*by, "blob").agg(F.max("coverage").alias("best"))
    out = blobs.select(*by, F.col("idx").alias("blob")).join(best, [*by, "blob"], "left").join(assigned.select(*by, "blob", "gt"), [*by, "blob"], "left")
    best = F.coalesce("best", F.lit(0.0))
    label = F.when(F.col("gt").isNotNull(), "positive").when(best <= 0, "negative").otherwise("ignored")
    return out.select(*by, "blob", label.alias("label"), F.coalesce("gt", F.lit(-1)).cast("long").alias("gt"), best.alias("best"))


def best_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of each row, reduced costs) of a square assignment with the smallest total, by shortest augmenting paths."""
    n = len(cost)
    row_price, column_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        reach, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, column, far = start, -1, 0.0
        while row >= 0:
            ways = far + cost[row] - row_price[row] - column_price
            shorter = ~done & (ways < reach)
            reach[shorter], before[shorter] = ways[shorter], column
            open_reach = np.where(done, np.inf, reach)
            column = int(open_reach.argmin())
            far = float(open_reach[column])
            done[column] = True
            row = row_of[column]
        seen = done.copy()
        seen[column] = False
        row_price[start] += far
        row_price[row_of[seen]] += far - reach[seen]
        column_price[seen] -= far - reach[seen]
        while column >= 0:
            earlier = before[column]
            row_of[column] = row_of[earlier] if earlier >= 0 else start
            column = earlier
    column_of = np.empty(n, int)
    column_of[row_of] = np.arange(n)
    return column_of, np.maximum(cost - row_price[:, None] - column_price, 0)


def cheapest_cycles(reduced: np.ndarray, column_of: np.ndarray) -> np.ndarray:
    """(i, k): the least that all totals grow by if row i takes the column of row k, and others move on in a ring."""
    step = reduced[:, column_of]
    way = step.copy()
    np.fill_diagonal(way, 0)
    for via in range(len(way)):
        np.minimum(way, way[:, via, None] + way[via], out=way)
    return step + way.T


def associate(before: list[tuple[float, float]], now: list[tuple[float, float]], slack: float = 1e-12) -> tuple[dict[int, int], float | None]:
    """({place now: place before}, ratio of the second-best to the best total distance).

    Equal numbers: the assignment with the smallest total; of equal ones the first, as lists of places
    before. Any other assignment differs from the best one by rings of rows that pass their partners on,
    so the second-best total is the best one plus the cheapest ring. Unequal numbers: each box now, in
    order, takes the nearest box before that is free. No ratio for a single box or a best of 0.

    Totals are equal within slack times the largest distance (at least 1). With 0 the two totals of two boxes are
    compared as they add up in doubles, as SQL compares them: boxes on one line differ there by their last bit.
    """
    if not before or not now:
        return {}, None
    gap = np.sqrt(sum(np.subtract.outer([p[i] for p in now], [p[i] for p in before]) ** 2 for i in (0, 1)))
    if len(before) != len(now):
        free, out = np.ones(len(before), bool), {}
        for i, row in enumerate(gap[: len(before)]):
            out[i] = int(np.where(free, row, np.inf).argmin())
            free[out[i]] = False
        return out, None
    n = len(now)
    if n == 1:
        return {0: 0}, None
    nearly = slack * max(1.0, float(gap.max()))
    if n == 2:
        straight, crossed = float(gap[0, 0] + gap[1, 1]), float(gap[0, 1] + gap[1, 0])
        best, other = min(straight, crossed), max(straight, crossed)
        return {0: 0, 1: 1} if straight <= crossed + nearly else {0: 1, 1: 0}, other / best if best > 0 else None
    column_of, reduced = best_assignment(gap)
    rings = cheapest_cycles(reduced, column_of)
    np.fill_diagonal(rings, np.inf)
    second = float(rings.min())
    if second <= nearly:  # other assignments are as good
        column_of = first_of_equals(reduced, column_of, nearly)
    total = float(gap[np.arange(n), column_of].sum())
    return dict(enumerate(column_of.tolist())), (total + second) / total if total > 0 else None


def first_of_equals(reduced: np.ndarray, column_of: np.ndarray, nearly: float) -> np.ndarray:
    """Of the best assignments the one whose list of columns comes first: row by row the least column that a free ring allows."""
    column_of, n = column_of.copy(), len(column_of)
    for i in range(n):
        rows = np.arange(i, n)
        for column in sorted(c for c in column_of[rows] if c < column_of[i] and reduced[i, c] <= nearly):
            # a path over free steps from the row that has the column to the one that gives its own to it
            came, todo = {int(np.flatnonzero(column_of == column)[0]): -1}, [int(np.flatnonzero(column_of == column)[0])]
            while todo and i not in came:
                k = todo.pop(0)
                for other in rows:
                    if other not in came and reduced[k, column_of[other]] <= nearly:
                        came[int(other)] = k
                        todo.append(int(other))
            if i in came:
                ring, k = [i], came[i]
                while k >= 0:
                    ring.append(k)
                    k = came[k]
                ring.reverse()  # from the row that has the column to row i
                columns = [column_of[x] for x in ring]
                for x, c in zip(ring, columns[1:] + columns[:1]):
                    column_of[x] = c
                break
    return column_of


def track_ids(boxes: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(video, frame, idx, cx, cy, track_id, ratio) from boxes with (video, frame, idx, cx, cy); slack as in `associate`.

    Identities pass from frame to frame by `associate`; a gap, an empty frame or an unmatched box starts
    new ones. The fold needs a video's frames in order: videos are dealt over tasks and sorted, and a task
    streams through its batches, holding one frame of state.
    """

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, ids, points, last, fresh = None, [], [], None, 0
        held: list[tuple] = []

        def close() -> list[tuple]:
            nonlocal ids, points, last, fresh
            frame, now = held[0][1], [(r[3], r[4]) for r in held]
            match, ratio = associate(points, now, slack) if last is not None and frame == last + 1 else ({}, None)
            new = []
            for i in range(len(now)):
                new.append(ids[match[i]] if i in match else fresh)
                fresh += i not in match
            ids, points, last = new, now, frame
            return [(*r, t, ratio) for r, t in zip(held, new)]

        for pdf in pdfs:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False, name=None):
                if held and r[:2] != held[0][:2]:
                    out += close()
                    held = []
                if r[0] != video:
                    video, ids, points, last, fresh = r[0], [], [], None, 0
                held.append(r)
            yield pd.DataFrame(out, columns=TRACKED)
        if held:
            yield pd.DataFrame(close(), columns=TRACKED)

    kind = boxes.schema["video"].dataType.simpleString()
    ordered = boxes.select("video", "frame", "idx", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).repartition("video").sortWithinPartitions("video", "frame", "idx")
    return ordered.mapInPandas(fold, f"video {kind}, frame long, idx long, cx double, cy double, track_id long, ratio double")
