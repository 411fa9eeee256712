"""Queries over boxes: geometry, matching, labelling, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import aggregates as A
from frameloom.operators import joins as J
from frameloom.operators import matching as M
from frameloom.operators import metrics as X
from frameloom.plans.views import duck, view
from frameloom.session import staged

R6 = lambda c: F.round(c, 6)
R12 = lambda c: F.round(c, 12)  # noqa: E731  finer than any tie that shares of small areas can make

FRAME_W = "CAST(split_part(resolution, 'x', 1) AS double)"
FRAME_H = "CAST(split_part(resolution, 'x', 2) AS double)"
VISIBLE = f"(greatest(least(x + w, {FRAME_W}) - greatest(x, 0), 0) * greatest(least(y + h, {FRAME_H}) - greatest(y, 0), 0))"
COVS = """covs AS (SELECT b.frame, b.idx AS blob, g.idx AS gt, b.w * b.h AS blob_area,
  CAST(greatest(least(b.x + b.w, g.x + g.w) - greatest(b.x, g.x), 0) * greatest(least(b.y + b.h, g.y + g.h) - greatest(b.y, g.y), 0) AS double) / (g.w * g.h) AS coverage
  FROM blobs b JOIN gts g ON b.frame = g.frame)"""
BEST = """best AS (SELECT frame, gt, blob, coverage, blob_area, n_blobs FROM (
  SELECT *, row_number() OVER (PARTITION BY frame, gt ORDER BY coverage DESC, blob) AS r, count(*) OVER (PARTITION BY frame, gt) AS n_blobs FROM covs) WHERE r = 1)"""
GREEDY = """queue AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY coverage DESC, blob, gt) AS r FROM covs WHERE coverage >= 0.5),
fold(frame, r, blobs, gts, blob, gt, coverage, taken) AS (
  SELECT frame, r, [blob], [gt], blob, gt, coverage, true FROM queue WHERE r = 1
  UNION ALL
  SELECT q.frame, q.r, CASE WHEN list_contains(f.blobs, q.blob) OR list_contains(f.gts, q.gt) THEN f.blobs ELSE list_append(f.blobs, q.blob) END,
    CASE WHEN list_contains(f.blobs, q.blob) OR list_contains(f.gts, q.gt) THEN f.gts ELSE list_append(f.gts, q.gt) END,
    q.blob, q.gt, q.coverage, NOT (list_contains(f.blobs, q.blob) OR list_contains(f.gts, q.gt))
  FROM fold f JOIN queue q ON q.frame = f.frame AND q.r = f.r + 1),
assigned AS (SELECT frame, blob, gt, coverage FROM fold WHERE taken)"""
LABELLED = """labelled AS (SELECT b.frame, b.idx AS blob, CASE WHEN a.gt IS NOT NULL THEN 'positive' WHEN coalesce(m.best, 0) <= 0 THEN 'negative' ELSE 'ignored' END AS label,
  coalesce(a.gt, -1) AS gt, coalesce(m.best, 0.0::DOUBLE) AS best
  FROM blobs b LEFT JOIN (SELECT frame, blob, max(coverage) AS best FROM covs GROUP BY ALL) m ON m.frame = b.frame AND m.blob = b.idx
  LEFT JOIN assigned a ON a.frame = b.frame AND a.blob = b.idx)"""
FULL = f"{duck('blobs', 'gts')}, {COVS}, {BEST}, {GREEDY}, {LABELLED}"


def pairs(spark, d):
    return M.coverages(view(spark, d, "blobs"), view(spark, d, "gts"))


def boxes_once(spark, d):
    """All boxes, then detections, then annotated boxes: derived once and written, since the steps of a query read them several times."""
    boxes = staged(view(spark, d, "boxes"), "boxes")
    return boxes, boxes.where("kind = 'blob'"), boxes.where("kind = 'gt'")


def labels(blobs, gts):
    p = staged(M.coverages(blobs, gts), "pairs")  # read by the assignment and by the labels
    return M.labelled(blobs, p, M.greedy(p))


PROPERTIES = ("scene", "resolution", "video", "split")


def matched(blobs, gts):
    """The best detection of each annotated box with its frame's properties."""
    return M.best_in_frame(blobs, gts, keep=PROPERTIES)


MATCHED = "matched AS (SELECT b.*, g.scene, g.resolution, g.video, g.split FROM best b JOIN gts g ON g.frame = b.frame AND g.idx = b.gt)"
DIM = f"({FRAME_W} * {FRAME_H})"


def geometry(spark, d):
    """PRJ-1, PRJ-2, PRJ-4: box geometry."""
    b = view(spark, d, "boxes")
    g = C.box_geometry(*(F.col(c).cast("double") for c in "xywh"), F.col("resolution"))
    return b.select("frame", "idx", *((R12(c) if n != "clipped" else c).alias(n) for n, c in g.items()))


def crops(spark, d):
    """PRJ-5, K-6: padded square crops and the share that lies outside the frame."""
    b = J.with_grid(view(spark, d, "gts"), padding=[0.0, 0.25, 0.5])
    side = C.crop_side(F.col("w"), F.col("h"), F.col("padding"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return b.select("frame", "idx", "padding", R6(side).alias("side"), R6(C.synthetic_fraction(cx, cy, side, F.col("resolution"))).alias("synthetic"))


def kernels(spark, d):
    """PRJ-7, K-5, A-7, J-14: boxes erased by opening at each kernel, over all rows and by each grouping."""
    b = J.with_grid(view(spark, d, "gts"), k=[21, 25, 29, 33])
    scaled = C.nearest_odd(F.col("k") * C.resolution_scale(F.col("resolution"), "160x120"))
    erased = ~C.survives_opening(F.col("w"), F.col("h"), scaled)
    n = {"instances": F.count("*"), "erased": F.count_if(F.col("erased"))}
    return A.by_each(b.withColumn("erased", erased), ["resolution", "scene", "split"], ["k"], n)


def area_band(spark, d):
    """FLT-3: detections within an inclusive area band given as shares of the frame."""
    area, frame = F.col("w") * F.col("h"), C.frame_area(F.col("resolution"))
    b = view(spark, d, "blobs").where(area.between(frame * 0.05, frame * 0.0625))
    return b.select("frame", "idx", area.alias("area"))


def found_at(spark, d):
    """FLT-4: annotated boxes found at a least share of the frame and a least coverage."""
    _, blobs, gts = boxes_once(spark, d)
    m = matched(blobs, gts).where((F.col("coverage") >= 0.3) & (F.col("blob_area") >= 0.05 * C.frame_area(F.col("resolution"))))
    return m.select("frame", "gt", "blob", R12("coverage").alias("coverage"))


def coverage_pairs(spark, d):
    """J-6: the spatial join."""
    return pairs(spark, d).where("coverage > 0").select("frame", "blob", "gt", R12("coverage").alias("coverage"))


def best_match(spark, d):
    """J-6: best detection per annotated box, with the first one where nothing overlaps."""
    return M.best_per_gt(pairs(spark, d)).select("frame", "gt", "blob", R12("coverage").alias("coverage"), "blob_area", "n_blobs")


def greedy(spark, d):
    """J-7: greedy one-to-one assignment."""
    return M.greedy(pairs(spark, d)).select("frame", "blob", "gt", R12("coverage").alias("coverage"))


def three_way(spark, d):
    """J-8, PRJ-10: labels with the key of the annotated object."""
    key = C.track_key(F.concat(F.lit("v"), (F.col("frame") % 30).cast("string")), F.col("frame"), F.col("gt"), F.col("label"))
    _, blobs, gts = boxes_once(spark, d)
    return labels(blobs, gts).select("frame", "blob", "label", "gt", R12("best").alias("best"), key.alias("track_key"))


def label_counts(spark, d):
    """A-1, A-28: label counts per split and recall over all annotated boxes."""
    boxes, blobs, gts = boxes_once(spark, d)
    frames = boxes.select("frame", "split").distinct()
    gt = gts.groupBy("split").agg(F.count("*").alias("n_gt"))
    rows = labels(blobs, gts).join(frames, "frame").groupBy("split").agg(*(F.count_if(F.col("label") == x).alias(x) for x in ("positive", "negative", "ignored")))
    return A.rolled_up(rows.join(gt, "split"), ["split"], ["positive", "negative", "ignored", "n_gt"], "positive", "n_gt")


def single_positive(spark, d):
    """G-6: annotated boxes with more than one positive, before the assignment (some) and after it (none)."""
    _, blobs, gts = boxes_once(spark, d)
    p = staged(M.coverages(blobs, gts), "pairs")
    before = p.where("coverage >= 0.3").select("frame", "gt", F.lit("positive").alias("label"))
    after = M.labelled(blobs, p, M.greedy(p))
    found = lambda df, step: X.single_positive(df, ["frame", "gt"]).withColumn("step", F.lit(step))
    return found(before, "before").unionByName(found(after, "after"))


def nway(spark, d):
    """J-5: several methods' results aligned on the annotated box, later rows overwriting earlier ones."""
    p = pairs(spark, d)
    best = lambda cond: J.last_of(p.where(cond).select("frame", "gt", "blob", "coverage"), ["frame", "gt"], ["coverage", "blob"])
    t = {"even": best("blob % 4 = 0"), "odd": best("blob % 4 = 2"), "late": best("blob > 2")}
    out = J.aligned(t, ["frame", "gt"], "coverage")
    return out.select("frame", "gt", *(R12(c).alias(c) for c in t))


def overlap(spark, d):
    """A-13: three-set overlap of methods, per scene."""
    p = M.coverages(view(spark, d, "blobs"), view(spark, d, "gts"), keep=("scene",))
    hit = lambda cond: F.max((F.expr(cond) & (F.col("coverage") >= 0.3)).cast("int")) == 1
    rows = p.groupBy("frame", "gt", "scene").agg(hit("blob % 4 = 0").alias("a"), hit("blob % 4 = 2").alias("b"), hit("blob > 4").alias("c"))
    return A.overlap(rows, ["a", "b", "c"], ["scene"])


def histogram(spark, d):
    """A-9: log-spaced area histogram with a closed last bin."""
    h = A.area_histogram(view(spark, d, "blobs"), ["video"], F.col("w") * F.col("h"), C.frame_area(F.col("resolution")), 40)
    return h.select("video", "bin", R6("bin_lo").alias("bin_lo"), R6("bin_hi").alias("bin_hi"), "n")


HIST = f"""hist AS (SELECT video, bin, exp(ln(largest) * bin / 40) AS bin_lo, exp(ln(largest) * (bin + 1) / 40) AS bin_hi, largest, count(*) AS n FROM (
  SELECT video, {DIM} AS largest, CASE WHEN w * h = {DIM} THEN 39 ELSE least(CAST(floor(ln(w * h) / ln({DIM}) * 40) AS int), 39) END AS bin
  FROM blobs WHERE w * h BETWEEN 1 AND {DIM}) GROUP BY ALL)"""
FRAMES = "frames AS (SELECT video, count(DISTINCT frame) AS n_frames FROM boxes GROUP BY ALL)"


def per_frame(boxes, blobs, thresholds=(500.0, 900.0, 1200.0, 1600.0)):
    h = A.area_histogram(blobs, ["video"], F.col("w") * F.col("h"), C.frame_area(F.col("resolution")), 40)
    frames = boxes.groupBy("video").agg(F.count_distinct("frame").alias("n_frames"))
    return A.blobs_per_frame(h, frames, thresholds)


PER_FRAME = f"""{HIST}, {FRAMES}, per_frame AS (SELECT threshold, CAST(sum(CASE WHEN bin_lo >= threshold THEN n ELSE 0 END) AS bigint) AS n_blobs, (SELECT CAST(sum(n_frames) AS bigint) FROM frames) AS n_frames
  FROM hist, (SELECT unnest([500.0, 900.0, 1200.0, 1600.0])::DOUBLE AS threshold) GROUP BY threshold)"""


def suffix_curve(spark, d):
    """A-10: detections per frame above each area, from the histogram."""
    boxes, blobs, _ = boxes_once(spark, d)
    return per_frame(boxes, blobs).select("threshold", "n_blobs", "n_frames", R6("blobs_per_frame").alias("blobs_per_frame"))


def recall_grid(spark, d):
    """A-11: recall over least area and coverage, per scene."""
    _, blobs, gts = boxes_once(spark, d)
    g = A.recall_grid(matched(blobs, gts), [500, 900, 1200, 1600], [0.3, 0.5, 0.7], ["scene"])
    return g.select("scene", "min_area", "min_coverage", "n_gt", "found", R6("recall").alias("recall"))


def operating_curve(spark, d):
    """A-12: recall against cost per threshold."""
    boxes, blobs, gts = boxes_once(spark, d)
    c = A.operating_curve(per_frame(boxes, blobs), A.recall_grid(matched(blobs, gts), [500, 900, 1200, 1600], [0.5]), 0.17)
    return c.select("threshold", "min_coverage", R6("blobs_per_frame").alias("blobs_per_frame"), R6("recall").alias("recall"), R6("hours").alias("hours"))


def upper_limit(spark, d):
    """A-31: what a per-resolution area limit costs, per scene and coverage."""
    limits = spark.createDataFrame([("160x120", 1400.0), ("320x240", 1800.0)], "resolution string, max_area double")
    _, blobs, gts = boxes_once(spark, d)
    return A.over_limit(matched(blobs, gts), limits, ["resolution"], "blob_area", "max_area", [0.3, 0.5], "coverage", ["scene"])


def anchors(spark, d):
    """A-32: area anchors from coverage and detection rate."""
    boxes, blobs, gts = boxes_once(spark, d)
    m = matched(blobs, gts).withColumn("area_frac", F.col("blob_area") / C.frame_area(F.col("resolution")))
    a = A.anchor(per_frame(boxes, blobs), m, 1.05, 0.5)
    return a.select(R6("lower").alias("lower"), "upper", R6("middle").alias("middle"), "overlap")


def storage(spark, d):
    """A-35: proposals, bytes and hours per split and threshold."""
    boxes, blobs, _ = boxes_once(spark, d)
    splits = boxes.groupBy("split").agg(F.count_distinct("frame").alias("split_frames"))
    s = A.storage(per_frame(boxes, blobs), splits, 8 * 112 * 112 * 3, 0.17)
    return s.select("split", "threshold", *(F.round(c, 4).alias(c) for c in ("n_proposals", "bytes", "hours")))


def area_extremes(spark, d):
    """A-30: smallest and largest box per resolution with side and share of the frame."""
    area = F.col("w") * F.col("h")
    out = view(spark, d, "gts").groupBy("resolution").agg(F.min(area).alias("smallest"), F.max(area).alias("largest"))
    return out.select("resolution", "smallest", "largest", R6(F.sqrt("largest")).alias("side"), R6(F.col("largest") / C.frame_area(F.col("resolution"))).alias("share"))


def size_summary(spark, d):
    """A-2, A-6: exact percentiles of visible size per scene and resolution."""
    v = view(spark, d, "gts").withColumn("side", C.box_geometry(*(F.col(c).cast("double") for c in "xywh"), F.col("resolution"))["equiv_side"])
    s = A.summary(v, ["scene", "resolution"], "side")
    return s.select("scene", "resolution", "n", *(R6(c).alias(c) for c in s.columns[3:]))


def synthetic_summary(spark, d):
    """A-40: how much of the crops is invented: mean, percentiles, largest, share above zero."""
    c = crops(spark, d)
    return c.groupBy("padding").agg(F.count("*").alias("n"), R6(F.avg("synthetic")).alias("mean"), R6(F.percentile("synthetic", F.lit(0.9))).alias("p90"), F.max("synthetic").alias("max"), R6(F.count_if(F.col("synthetic") > 0) / F.count("*")).alias("share"))


def size_bands(spark, d):
    """B-1, B-2, A-22: recall by deciles of box area."""
    from frameloom.operators.metrics import recall_by_band

    _, blobs, gts = boxes_once(spark, d)
    gt = gts.withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    got = labels(blobs, gts).where("label = 'positive'").select("frame", F.col("gt").alias("idx"), "label").join(gt, ["frame", "idx"])
    return recall_by_band(got, gt, "area", [600.0, 900.0, 1200.0, 1800.0, 5000.0]).select("band", "n_gt", "matched", R6("recall").alias("recall"))


S = f"{duck('boxes', 'gts', 'blobs')}"
CROPS = f"""crops AS (SELECT frame, idx, padding, side, 1 - greatest(least(cx + side / 2, {FRAME_W}) - greatest(cx - side / 2, 0), 0) * greatest(least(cy + side / 2, {FRAME_H}) - greatest(cy - side / 2, 0), 0) / (side * side) AS synthetic
  FROM (SELECT *, greatest(w, h) * (1 + 2 * padding) AS side, x + w / 2 AS cx, y + h / 2 AS cy FROM gts, (SELECT unnest([0.0, 0.25, 0.5])::DOUBLE AS padding)))"""
QUERIES = {
    "box_geometry": (geometry, f"""{S} SELECT frame, idx, round((x + w / 2)::DOUBLE, 12) AS cx, round((y + h / 2)::DOUBLE, 12) AS cy, (w * h)::DOUBLE AS box_area, round({VISIBLE}, 12) AS visible_area,
      {VISIBLE} < w * h - 1e-6 AS clipped, round({VISIBLE} / {DIM}, 12) AS area_frac, round(sqrt({VISIBLE}), 12) AS equiv_side, round(sqrt({VISIBLE} / {DIM}), 12) AS equiv_side_frac FROM boxes"""),
    "crop_boxes": (crops, f"{S}, {CROPS} SELECT frame, idx, padding, round(side, 6) AS side, round(synthetic, 6) AS synthetic FROM crops"),
    "opening_survival": (kernels, f"""{S}, e AS (SELECT *, NOT (w >= kk AND h >= kk) AS gone FROM (SELECT *, greatest(2 * ceil((k * sqrt({DIM} / 19200.0::DOUBLE) - 2) / 2) + 1, 1) AS kk FROM gts, (SELECT unnest([21, 25, 29, 33]) AS k)))
      SELECT k, CASE WHEN grouping(resolution) = 0 THEN 'resolution' WHEN grouping(scene) = 0 THEN 'scene' WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS group_type,
      coalesce(resolution, scene, split, 'all') AS grp, count(*) AS instances, count(*) FILTER (gone) AS erased FROM e GROUP BY GROUPING SETS ((k), (k, resolution), (k, scene), (k, split))"""),
    "area_band": (area_band, f"{S} SELECT frame, idx, w * h AS area FROM blobs WHERE w * h BETWEEN {DIM} * 0.05::DOUBLE AND {DIM} * 0.0625::DOUBLE"),
    "found_at": (found_at, f"{FULL}, {MATCHED} SELECT frame, gt, blob, round(coverage, 12) AS coverage FROM matched WHERE coverage >= 0.3::DOUBLE AND blob_area >= 0.05::DOUBLE * {DIM}"),
    "coverage_join": (coverage_pairs, f"{FULL} SELECT frame, blob, gt, round(coverage, 12) AS coverage FROM covs WHERE coverage > 0"),
    "best_match": (best_match, f"{FULL} SELECT frame, gt, blob, round(coverage, 12) AS coverage, blob_area, n_blobs FROM best"),
    "greedy_assignment": (greedy, f"{FULL} SELECT frame, blob, gt, round(coverage, 12) AS coverage FROM assigned"),
    "three_way_labels": (three_way, f"""{FULL} SELECT frame, blob, label, gt, round(best, 12) AS best, CASE WHEN label = 'positive' THEN 'v' || (frame % 30) || ':' || frame || ':' || gt ELSE '' END AS track_key FROM labelled"""),
    "label_rollup": (label_counts, f"""{FULL}, f AS (SELECT DISTINCT frame, split FROM boxes), n AS (SELECT split, count(*) AS n_gt FROM gts GROUP BY ALL)
      SELECT split, positive, negative, ignored, n_gt, round(positive / n_gt, 6) AS recall FROM (SELECT split, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'ignored') AS ignored
      FROM labelled JOIN f USING (frame) GROUP BY ALL) JOIN n USING (split)"""),
    "single_positive": (single_positive, f"{FULL} SELECT frame, gt, count(*) AS n_positive, 'before' AS step FROM covs WHERE coverage >= 0.3 GROUP BY frame, gt HAVING count(*) > 1 UNION ALL SELECT frame, gt, count(*), 'after' FROM labelled WHERE label = 'positive' GROUP BY frame, gt HAVING count(*) > 1"),
    "nway_align": (nway, f"""{FULL}, a AS (SELECT frame, gt, max(coverage) AS even FROM covs WHERE blob % 4 = 0 GROUP BY ALL), b AS (SELECT frame, gt, max(coverage) AS odd FROM covs WHERE blob % 4 = 2 GROUP BY ALL),
      c AS (SELECT frame, gt, max(coverage) AS late FROM covs WHERE blob > 2 GROUP BY ALL) SELECT frame, gt, round(even, 12) AS even, round(odd, 12) AS odd, round(late, 12) AS late FROM a JOIN b USING (frame, gt) JOIN c USING (frame, gt)"""),
    "method_overlap": (overlap, f"""{FULL}, h AS (SELECT covs.frame, gt, scene, bool_or(blob % 4 = 0 AND coverage >= 0.3) AS a, bool_or(blob % 4 = 2 AND coverage >= 0.3) AS b, bool_or(blob > 4 AND coverage >= 0.3) AS c
      FROM covs JOIN gts g ON g.frame = covs.frame AND g.idx = covs.gt GROUP BY ALL), o AS (SELECT scene, count(*) AS n, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (c) AS n_c, count(*) FILTER (a OR b OR c) AS n_union,
      count(*) FILTER (a AND b AND c) AS n_intersection, count(*) FILTER (NOT (a OR b OR c)) AS n_missed, count(*) FILTER (a AND NOT b AND NOT c) AS only_a, count(*) FILTER (b AND NOT a AND NOT c) AS only_b, count(*) FILTER (c AND NOT a AND NOT b) AS only_c
      FROM h GROUP BY scene) SELECT *, n_union - greatest(n_a, n_b, n_c) AS union_gain FROM o"""),
    "area_histogram": (histogram, f"{S}, {HIST} SELECT video, bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, n FROM hist"),
    "suffix_curve": (suffix_curve, f"{S}, {PER_FRAME} SELECT threshold, n_blobs, n_frames, round(n_blobs / n_frames, 6) AS blobs_per_frame FROM per_frame"),
    "recall_grid": (recall_grid, f"""{FULL}, {MATCHED} SELECT scene, min_area, min_coverage, count(*) AS n_gt, count(*) FILTER (blob_area >= min_area AND coverage >= min_coverage) AS found,
      round(count(*) FILTER (blob_area >= min_area AND coverage >= min_coverage) / count(*), 6) AS recall FROM matched, (SELECT unnest([500, 900, 1200, 1600])::DOUBLE AS min_area), (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS min_coverage) GROUP BY ALL"""),
    "operating_curve": (operating_curve, f"""{FULL}, {MATCHED}, {PER_FRAME}, r AS (SELECT min_area, count(*) FILTER (blob_area >= min_area AND coverage >= 0.5) / count(*) AS recall FROM matched, (SELECT unnest([500, 900, 1200, 1600])::DOUBLE AS min_area) GROUP BY ALL)
      SELECT threshold, 0.5::DOUBLE AS min_coverage, round(n_blobs / n_frames, 6) AS blobs_per_frame, round(recall, 6) AS recall, round(n_blobs * 0.17::DOUBLE / 3600, 6) AS hours FROM per_frame JOIN r ON threshold = min_area"""),
    "upper_limit_cost": (upper_limit, f"""{FULL}, {MATCHED} SELECT scene, min_coverage, count(*) FILTER (coverage >= min_coverage) AS found, count(*) FILTER (coverage >= min_coverage AND blob_area > CASE resolution WHEN '160x120' THEN 1400 ELSE 1800 END) AS lost
      FROM matched, (SELECT unnest([0.3, 0.5])::DOUBLE AS min_coverage) GROUP BY ALL"""),
    "area_anchors": (anchors, f"""{FULL}, {MATCHED}, {PER_FRAME}, a AS (SELECT max(blob_area / {DIM}) AS lower FROM matched WHERE coverage >= 0.5), b AS (SELECT min(threshold) AS upper FROM per_frame WHERE n_blobs / n_frames <= 1.05)
      SELECT round(lower, 6) AS lower, upper, round(sqrt(lower * upper), 6) AS middle, lower >= upper AS overlap FROM a, b"""),
    "storage_sizing": (storage, f"""{S}, {PER_FRAME}, s AS (SELECT split, count(DISTINCT frame) AS split_frames FROM boxes GROUP BY ALL), n AS (SELECT split, threshold, n_blobs / n_frames * split_frames AS n_proposals FROM per_frame, s)
      SELECT split, threshold, round(n_proposals, 4) AS n_proposals, round(n_proposals * 301056, 4) AS bytes, round(n_proposals * 0.17::DOUBLE / 3600, 4) AS hours FROM n"""),
    "area_extremes": (area_extremes, f"{S} SELECT resolution, min(w * h) AS smallest, max(w * h) AS largest, round(sqrt(max(w * h)), 6) AS side, round(max(w * h) / {DIM}, 6) AS share FROM gts GROUP BY resolution"),
    "size_summary": (size_summary, f"""{S}, v AS (SELECT scene, resolution, sqrt({VISIBLE}) AS s FROM gts) SELECT scene, resolution, count(*) AS n, round(min(s), 6) AS min, round(max(s), 6) AS max,
      round(quantile_cont(s, 0.01), 6) AS p01, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.99), 6) AS p99 FROM v GROUP BY ALL"""),
    "synthetic_summary": (synthetic_summary, f"""{S}, {CROPS}, c AS (SELECT padding, round(synthetic, 6) AS synthetic FROM crops) SELECT padding, count(*) AS n, round(avg(synthetic), 6) AS mean, round(quantile_cont(synthetic, 0.9), 6) AS p90, max(synthetic) AS max,
      round(count(*) FILTER (synthetic > 0) / count(*), 6) AS share FROM c GROUP BY ALL"""),
    "size_band_recall": (size_bands, f"""{FULL}, g AS (SELECT frame, idx, CAST(len([e FOR e IN [600, 900, 1200, 1800, 5000] IF e <= w * h]) AS int) AS band FROM gts), every AS (SELECT CAST(unnest(range(6)) AS int) AS band),
      n AS (SELECT band, count(*) AS n_gt FROM g GROUP BY ALL), m AS (SELECT band, count(*) AS matched FROM labelled l JOIN g ON g.frame = l.frame AND g.idx = l.gt WHERE label = 'positive' GROUP BY ALL)
      SELECT band, coalesce(n_gt, 0) AS n_gt, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / nullif(n_gt, 0), 6) AS recall FROM every LEFT JOIN n USING (band) LEFT JOIN m USING (band)"""),
}
