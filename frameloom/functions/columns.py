"""Column expressions: parsing, box geometry, binning and the closed forms of the measurement study.

All of them stay inside Spark's generated code. Inputs are columns; where a null can occur the result is
null unless the docstring says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean true; every other text means false.
TRUE_TEXTS = ("true", "1", "yes", "t")
# Usability scores from worst to best.
SCORE_ORDER = ("cannot_tell", "not_usable", "degraded", "usable")


def truthy(c: Column) -> Column:
    """A text flag: true for TRUE_TEXTS in any case and padding, otherwise false - also for null."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_TEXTS), F.lit(False))


def tolerant_int(c: Column) -> Column:
    """" 08" gives 8; texts that are no integer give null."""
    return F.trim(c).try_cast("long")


def whole(c: Column) -> Column:
    """An integer that may have been written as a float."""
    return c.cast("double").cast("long")


def frame_area(resolution: Column) -> Column:
    """Pixels of a "1920x1080"."""
    part = F.split(resolution, "x")
    return F.get(part, F.lit(0)).cast("double") * F.get(part, F.lit(1)).cast("double")


def frame_side(resolution: Column, which: int) -> Column:
    return F.get(F.split(resolution, "x"), F.lit(which)).cast("double")


def rational(c: Column) -> Column:
    """A rate written "30000/1001" or "25"; null where the divisor is zero."""
    part = F.split(c, "/")
    return F.try_divide(F.get(part, F.lit(0)).cast("double"), F.coalesce(F.get(part, F.lit(1)).cast("double"), F.lit(1.0)))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def visible_area(x: Column, y: Column, w: Column, h: Column, resolution: Column) -> Column:
    """Area of the part of a box inside its frame."""
    zero = F.lit(0.0)
    return overlap_1d(x, x + w, zero, frame_side(resolution, 0)) * overlap_1d(y, y + h, zero, frame_side(resolution, 1))


def box_geometry(x: Column, y: Column, w: Column, h: Column, resolution: Column) -> dict[str, Column]:
    """Centre, whole and visible area, whether it is clipped, and sizes relative to the frame."""
    box, visible, frame = w * h, visible_area(x, y, w, h, resolution), frame_area(resolution)
    return {
        "cx": x + w / 2, "cy": y + h / 2, "box_area": box.cast("double"), "visible_area": visible,
        "clipped": visible < box - 1e-6, "area_frac": visible / frame,
        "equiv_side": F.sqrt(visible), "equiv_side_frac": F.sqrt(visible / frame),
    }


def crop_side(w: Column, h: Column, padding: Column) -> Column:
    """Side of the square crop around a box with padding on each side."""
    return F.greatest(w, h) * (1 + 2 * padding)


def synthetic_fraction(cx: Column, cy: Column, side: Column, resolution: Column) -> Column:
    """Share of a square crop that lies outside its frame and has to be invented."""
    zero, half = F.lit(0.0), side / 2
    inside = overlap_1d(cx - half, cx + half, zero, frame_side(resolution, 0)) * overlap_1d(cy - half, cy + half, zero, frame_side(resolution, 1))
    return 1 - F.try_divide(inside, side * side)


def window_frames(centre: Column, length: int, stride: int = 1) -> Column:
    """The frames of a window; a window of even length has one more frame after its centre."""
    lead = (length - 1) // 2
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: centre + stride * (i - lead))


def resolution_scale(resolution: Column, reference: str) -> Column:
    """Linear scale of a resolution against a reference one."""
    return F.sqrt(frame_area(resolution) / frame_area(F.lit(reference)))


def nearest_odd(k: Column) -> Column:
    """Nearest odd integer, the lower one from the middle, at least 1."""
    return F.greatest(2 * F.ceil((k - 2) / 2) + 1, F.lit(1)).cast("long")


def survives_opening(w: Column, h: Column, kernel: Column) -> Column:
    """Whether a solid box keeps a pixel under erosion with a kernel of this side."""
    return (w > 0) & (h > 0) & (w >= kernel) & (h >= kernel)


def absorption_frames(n: Column, fraction: float = 0.10) -> Column:
    """Frames until a background model that remembers n frames takes in a constant foreground."""
    return math.log(1 - fraction) / F.log(1 - 1 / F.greatest(n, F.lit(1)).cast("double"))


def ceiling_frames(n: Column, fraction: float = 0.10) -> Column:
    """Longest standstill that stays foreground at frame n: the model's rate is 1 / (2 n) early in a clip."""
    return absorption_frames(2 * F.greatest(n, F.lit(1)), fraction)


def track_key(video: Column, centre: Column, gt_index: Column, label: Column) -> Column:
    """Names the annotated object of a positive; empty for others."""
    return F.when(label == "positive", F.concat_ws(":", video, centre, gt_index)).otherwise("")


def score_rank(c: Column) -> Column:
    """Place of a usability score in SCORE_ORDER; null for other texts."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(SCORE_ORDER):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def repaired_cue(call: Column, cue: Column, note: Column, cues: tuple[str, ...] = ("appearance", "motion", "both")) -> Column:
    """struct(cue, provenance): where a reviewer's cue comes from.

    In order: no call, a conflict between the cue and the note, the cue as written, the note alone, a cue
    that is none of the known ones, a call that needs none, and missing.
    """
    clean, said = F.lower(F.trim(F.coalesce(cue, F.lit("")))), F.lower(F.trim(F.coalesce(note, F.lit(""))))
    named = F.lit("")
    for name in reversed(cues):
        named = F.when(said.contains(name), F.lit(name)).otherwise(named)
    answer = lambda value, why: F.struct(value.alias("cue"), F.lit(why).alias("provenance"))
    empty = F.lit("")
    return (
        F.when(F.length(F.trim(F.coalesce(call, empty))) == 0, answer(empty, "unscored"))
        .when(clean.isin(*cues) & (named != "") & (named != clean), answer(empty, "conflict"))
        .when(clean.isin(*cues), answer(clean, "recorded"))
        .when((clean == "") & (named != ""), answer(named, "note"))
        .when(clean != "", answer(empty, "unknown"))
        .when(F.lower(F.trim(call)) == "background", answer(empty, "not_needed"))
        .otherwise(answer(empty, "missing"))
    )


def digitize(c: Column, edges: Column) -> Column:
    """How many edges are at or below c."""
    return F.size(F.filter(edges, lambda e: e <= c))


def log_bin(area: Column, largest: Column, n_bins: int) -> Column:
    """Bin of n_bins log-spaced ones from 1 to largest; the last bin is closed, areas below 1 have none."""
    at = F.floor(F.log(area) / F.log(largest) * n_bins).cast("int")
    return F.when(area == largest, F.lit(n_bins - 1)).when((area >= 1) & (area < largest), F.least(at, F.lit(n_bins - 1)))


def log_edge(k: Column, largest: Column, n_bins: int) -> Column:
    return F.exp(F.log(largest) * k / n_bins)


def padded_id(prefix: str, n: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def file_stem(path: Column) -> Column:
    """The last part of a path without its suffix; the folders are cut off first, since the pattern would be tried from each of their letters."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"([^/]*?)(\.[^./]*)?$", 1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def or_else(c: Column, default: Column) -> Column:
    """default where c is null or zero, as in `x or y`."""
    return F.coalesce(F.nullif(c, F.lit(0)), default)
