"""Tubelets: the crops of a window of frames around each proposal, as one row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.streaming.background import by_video, crop, image_of, resized
from frameloom.streaming.windows import micro_batches

# Axis orders of a clip of (frames, height, width) as models take it.
LAYOUTS = ("centre", "tchw", "cthw")


def wanted_frames(frames: DataFrame, proposals: DataFrame, length: int, frame: str = "frame", centre: str = "centre") -> DataFrame:
    """Only the frames that some window needs, so that others are not decoded further."""
    lead = (length - 1) // 2
    need = proposals.select("video", F.explode(F.sequence(F.col(centre) - lead, F.col(centre) + length - 1 - lead)).alias(frame)).distinct()
    return frames.join(need, ["video", frame], "left_semi")


CLIPS = "proposal long, video string, centre long, n long, synthetic double, clip binary"


def wanted_by(proposals: DataFrame, length: int) -> DataFrame:
    """(video, frame, wanted): the proposals whose window a frame completes, the one (length - 1) - (length - 1) // 2 after their centre."""
    trail = length - 1 - (length - 1) // 2
    box = F.struct(F.col("proposal").cast("long").alias("proposal"), *(F.col(c).cast("double").alias(c) for c in "xywh"))
    return proposals.groupBy("video", (F.col("centre") + trail).alias("frame")).agg(F.sort_array(F.collect_list(box)).alias("wanted"))


def assembled(proposals: DataFrame, frames: DataFrame, length: int, size: int, padding: float, method: str = "linear") -> DataFrame:
    """(proposal, video, centre, n, synthetic, clip) of complete windows.

    proposals: (proposal, video, centre, x, y, w, h); frames: (video, frame, height, width, pixels).
    Windows that run past either end of a video, or that lack a frame or have one twice, are left out; see `dropped`.
    """
    rows = frames.join(wanted_by(proposals, length), ["video", "frame"], "left").select("video", "frame", "height", "width", "pixels", "wanted")
    return clips_of(by_video(rows), length, size, padding, method)


def clips_of(rows: DataFrame, length: int, size: int, padding: float, method: str = "linear") -> DataFrame:
    """The clips of frames that carry the proposals of `wanted_by`, each video in one task and in order.

    A frame goes through a task once, whatever the number of windows that it lies in: clips are cut where the frames
    are, from those of one batch and the few before it, and nothing has to be put together afterwards.
    """

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in pdfs:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            done = 0 if held is None else len(held) - 1
            if len(rows):  # the last row waits: the next may be the same frame again
                yield from cut_rows(rows, done, len(rows) - 1, length, size, padding, method)
                held = rows.iloc[max(0, len(rows) - length - 1) :].reset_index(drop=True)
        if held is not None:
            yield from cut_rows(held, len(held) - 1, len(held), length, size, padding, method)

    return rows.mapInPandas(cut, CLIPS)


#: Clips that are cut at once.
CUT_CLIPS = 2048


def cut_rows(rows: pd.DataFrame, first: int, last: int, length: int, size: int, padding: float, method: str) -> Iterator[pd.DataFrame]:
    """The clips that rows `first` to `last` of ordered frames complete; the row after the last is there if it is the same frame again."""
    video, frame = rows["video"].to_numpy(), rows["frame"].to_numpy()
    follows = np.zeros(len(rows), bool)
    same = video[1:] == video[:-1]
    follows[1:] = same & (frame[1:] == frame[:-1] + 1)
    twice = np.zeros(len(rows), bool)
    twice[1:] = same & (frame[1:] == frame[:-1])
    twice[:-1] |= twice[1:]
    run = np.arange(len(rows)) - np.maximum.accumulate(np.where(follows, -1, np.arange(len(rows))))
    broken = np.concatenate([[0], np.cumsum(twice)])
    at = np.arange(len(rows))
    whole = (run >= length - 1) & (broken[at + 1] == broken[np.maximum(at - length + 1, 0)])
    wanted = rows["wanted"].to_numpy()
    found = [(i, p) for i in range(first, last) if whole[i] and wanted[i] is not None for p in wanted[i]]
    shape = list(zip(rows["height"], rows["width"], map(len, rows["pixels"])))
    for a in range(0, len(found), CUT_CLIPS):
        some = found[a : a + CUT_CLIPS]
        ends = np.array([i for i, _ in some])
        x, y, w, h = (np.array([p[c] for _, p in some], float) for c in "xywh")
        if not np.isfinite([x, y, w, h]).all():
            raise ValueError("a proposal without a place")
        side = np.maximum(w, h) * (1 + 2 * padding)
        frames_at = ends[:, None] + np.arange(1 - length, 1)
        parts, shares = crops(rows["pixels"], shape, frames_at, x + w / 2, y + h / 2, side, size, method)
        centre = frame[ends] - (length - 1 - (length - 1) // 2)
        yield pd.DataFrame({"proposal": [p["proposal"] for _, p in some], "video": video[ends], "centre": centre, "n": length, "synthetic": shares.max(axis=1), "clip": parts})


def crops(pixels: pd.Series, shape: list[tuple], at: np.ndarray, cx: np.ndarray, cy: np.ndarray, side: np.ndarray, size: int, method: str) -> tuple[list[bytes], np.ndarray]:
    """(clips, shares outside) of crops (clip, frame) as `background.crop` makes them one by one; frames of one form and crops of one side go together."""
    kinds: dict[tuple, list[int]] = {}
    for i in range(len(at)):
        kinds.setdefault((max(1, round(side[i])), tuple(shape[k] for k in at[i])), []).append(i)
    clips: list[bytes] = [b""] * len(at)
    shares = np.zeros(at.shape)
    for (n, forms), clip in kinds.items():
        clip = np.array(clip)
        if len(set(forms)) > 1:  # frames of several sizes
            for i in clip:
                made = [crop(image_of(pixels[k], *shape[k][:2]), cx[i], cy[i], side[i], size, method=method) for k in at[i]]
                clips[i], shares[i] = b"".join(part.tobytes() for part, _ in made), [share for _, share in made]
            continue
        height, width, _ = forms[0]
        used, place = np.unique(at[clip], return_inverse=True)
        images = np.frombuffer(b"".join(pixels[k] for k in used), np.uint8).reshape(len(used), height, width, -1)
        x, y = (np.rint(c[clip] - side[clip] / 2).astype(int)[:, None] + np.arange(n) for c in (cx, cy))
        share = 1 - ((x >= 0) & (x < width)).sum(axis=1) * ((y >= 0) & (y < height)).sum(axis=1) / (n * n)
        out = share == 1
        x[out], y[out] = cx[clip][out].astype(int)[:, None], cy[clip][out].astype(int)[:, None]
        y, x = np.clip(y, 0, height - 1), np.clip(x, 0, width - 1)
        cuts = images[place.reshape(at[clip].shape)[:, :, None, None], y[:, None, :, None], x[:, None, None, :]]
        shares[clip] = share[:, None]
        for j, i in enumerate(clip):
            clips[i] = cuts[j].tobytes() if n == size else b"".join(resized(part, size, method).tobytes() for part in cuts[j])
    return clips, shares


def dropped(proposals: DataFrame, clips: DataFrame) -> DataFrame:
    """Proposals whose window was not complete."""
    return proposals.join(clips.select("proposal"), "proposal", "left_anti")


def fill_counts(proposals: DataFrame, clips: DataFrame) -> DataFrame:
    """One row: clips requested, filled, and dropped because their window was not complete."""
    requested, filled = (df.agg(F.count("*").alias(n)) for df, n in ((proposals, "requested"), (clips, "filled")))
    return requested.crossJoin(F.broadcast(filled)).withColumn("dropped", F.col("requested") - F.col("filled"))  # one row each


def rows_for_seed(manifest: DataFrame, seed: int, seeds: str = "seeds", label: str = "label") -> DataFrame:
    """The clips of one run with a 0/1 target: all positives, and the negatives whose seeds (`1|3`) name the seed."""
    positive = F.col(label) == "positive"
    drawn = F.array_contains(F.split(F.coalesce(F.col(seeds).cast("string"), F.lit("")), r"\|"), str(seed))
    return manifest.where(positive | drawn).withColumn("target", positive.cast("int"))


def augmented(x: np.ndarray, keys: np.ndarray, seed: int, flip: float, brightness: tuple[float, float], contrast: tuple[float, float]) -> np.ndarray:
    """Clips (clip, frame, height, width, ...) in 0 to 1, each mirrored, brightened and spread about its mean by its own draw.

    A clip's draw depends on the seed and its key alone and holds for all its frames.
    """
    draws = np.array([np.random.default_rng([seed, int(key)]).random(3) for key in keys]).reshape(len(x), 3)
    each = (-1,) + (1,) * (x.ndim - 1)
    light, spread = (low + (high - low) * draws[:, i].reshape(each) for i, (low, high) in ((1, brightness), (2, contrast)))
    mean = light * x.mean(axis=tuple(range(1, x.ndim)), dtype=np.float64, keepdims=True)
    out = np.where(draws[:, 0].reshape(each) < flip, x[:, :, :, ::-1], x)
    return np.clip(spread * (light * out - mean) + mean, 0, 1).astype(x.dtype)


def as_model_input(
    clips: pd.Series, length: int, size: int, layout: str, mean: float | tuple[float, ...] = 0.0, std: float | tuple[float, ...] = 1.0, augment: dict | None = None, keys: np.ndarray | None = None
) -> np.ndarray:
    """Normalised float clips in a layout: the centre frame alone, frames of channels, or channels of frames.

    Clips have one value a pixel or several, told from their bytes; mean and std are one number or one for each
    channel. augment: seed, flip, brightness and contrast of `augmented`; then keys name the clips.
    """
    x = np.stack([np.frombuffer(c, np.uint8).reshape(length, size, size, -1) for c in clips]).astype(np.float32) / 255
    if augment is not None:
        x = augmented(x, keys, **augment)
    x = ((x - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).transpose(0, 1, 4, 2, 3)
    if layout == "centre":
        return x[:, (length - 1) // 2]
    return x if layout == "tchw" else x.swapaxes(1, 2)


def score_arrays(scores: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per video (or another small group) parallel arrays of the named columns in one order."""
    rows = scores.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("_rows"))
    return rows.select(by, *(F.col(f"_rows.{c}").alias(c) for c in columns))


def scored(
    clips: DataFrame, score: Callable[[np.ndarray], np.ndarray], length: int, size: int, layout: str = "centre", batch: int = 256, mean: float | tuple[float, ...] = 0.0, std: float | tuple[float, ...] = 1.0
) -> DataFrame:
    """(proposal, score) from a scorer over batches of `batch` clips, the last of a partition as many as are left."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"proposal": part["proposal"], "score": np.asarray(score(as_model_input(part["clip"], length, size, layout, mean, std)), float)})

    return micro_batches(clips, one, ["proposal", "clip"], "proposal long, score double", batch)
