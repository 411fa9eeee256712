"""Summaries, histograms, threshold curves, overlaps and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.columns import log_bin, log_edge
from frameloom.session import staged

PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
#: Parts that a group's values are dealt over.
PARTS = 64
#: Counted values up to which one aggregate takes them all.
FEW = 1_000_000


def percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """Exact, linearly interpolated percentiles per group: columns by and p0, p1, ... in the order of points.

    Nulls and NaNs do not count, and rows without a group are left out. Equal values are counted first and
    written, so that a value which most rows share is one row and the input is read once. Few counts go to
    the percentile aggregate. Otherwise approximate quantiles cut a group's distinct values into parts; the
    sizes of the parts tell which few of them hold the wanted ranks, and only these are sorted, so no
    task holds a group's values. Both ways are exact.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("_v"), F.lit(1).alias("_all")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    by = [*by, "_all"]
    known = rows
    for c in by:
        known = known.where(F.col(c).isNotNull())
    counts = staged(known.groupBy(*by, "_v").agg(F.count("*").alias("_c")), "value-counts")
    if counts.count() <= few:
        found = counts.groupBy(*by).agg(F.percentile("_v", F.array(*(F.lit(float(p)) for p in points)), F.col("_c")).alias("_p"))
        return found.select(*by, *(F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(len(points)))).drop("_all")
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    placed = counts.join(cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    inside = Window.partitionBy(*by)
    earlier = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_size"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(earlier), F.lit(0)), "_n": F.sum("_size").over(inside)})
    at = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for i, p in enumerate(points)))
    ranks = F.flatten(F.transform(at, lambda t: F.array(*(F.struct(t["i"].alias("i"), (t["at"] - F.floor(t["at"])).alias("share"), F.lit(k).alias("k"), F.least(F.floor(t["at"]) + k, F.col("_n") - 1).alias("rank")) for k in (0, 1)))))
    here = F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_size")))
    wanted = sizes.select(*by, "_part", "_before", here.alias("_wanted")).where(F.size("_wanted") > 0)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    sorted_parts = placed.join(wanted, [*by, "_part"]).withColumn("_upto", upto)
    hits = sorted_parts.select(*by, "_v", F.explode(F.filter("_wanted", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c")))).alias("r"))
    end = lambda i, k: F.max(F.when((F.col("r.i") == i) & (F.col("r.k") == k), F.col("_v")))
    share = lambda i: F.max(F.when(F.col("r.i") == i, F.col("r.share")))
    each = [(end(i, 0) + (end(i, 1) - end(i, 0)) * share(i)).alias(f"p{i}") for i in range(len(points))]
    return hits.groupBy(*by).agg(*each).drop("_all")


def summary(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float] = PERCENTILES) -> DataFrame:
    """n, min, max and exact, linearly interpolated percentiles; nulls and NaNs do not count, nor rows without a group."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    ends = df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"))
    rows = ends.join(percentiles(df, by, value, points), list(by), "left") if by else ends.crossJoin(F.broadcast(percentiles(df, by, value, points)))  # one row each
    return rows.select(*by, "n", "min", "max", *(F.col(f"p{i}").alias(f"p{round(p * 100):02d}") for i, p in enumerate(points)))


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample standard deviation (null for one row), min and max."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def counted(df: DataFrame, by: Sequence[str], flag: Column, name: str = "flagged") -> DataFrame:
    """Rows, flagged rows and their share."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias(name), (F.count_if(flag) / F.count("*")).alias("share"))


def by_each(df: DataFrame, groups: Sequence[str], extra: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over all rows and over each single grouping column in one pass (grouping sets).

    group_type names the column ("all" for none) and group its value; extra columns are always grouped by.
    """
    sets = [list(map(F.col, extra)), *([*map(F.col, extra), F.col(g)] for g in groups)]
    out = df.groupingSets(sets, *map(F.col, extra), *map(F.col, groups)).agg(*(c.alias(n) for n, c in aggregates.items()), *(F.grouping(g).alias(f"_{g}") for g in groups))
    kind, value = F.lit("all"), F.lit("all")
    for g in groups:
        kind = F.when(F.col(f"_{g}") == 0, F.lit(g)).otherwise(kind)
        value = F.when(F.col(f"_{g}") == 0, F.col(g).cast("string")).otherwise(value)
    return out.select(*extra, kind.alias("group_type"), value.alias("grp"), *aggregates)


def table_of(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of a category per row with a fixed list of values, and the row's total."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(row).agg(*counts, F.count("*").alias("total"))


def area_histogram(df: DataFrame, by: Sequence[str], area: Column, largest: Column, n_bins: int = 240) -> DataFrame:
    """Non-empty log-spaced bins with their edges and counts."""
    rows = df.select(*by, largest.alias("_largest"), log_bin(area, largest, n_bins).alias("bin")).where("bin IS NOT NULL")
    out = rows.groupBy(*by, "_largest", "bin").agg(F.count("*").alias("n"))
    low, high = log_edge(F.col("bin"), F.col("_largest"), n_bins), log_edge(F.col("bin") + 1, F.col("_largest"), n_bins)
    return out.select(*by, "bin", low.alias("bin_lo"), high.alias("bin_hi"), "n")


def blobs_per_frame(hist: DataFrame, frames: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), fraction_of: str | None = None) -> DataFrame:
    """Detections per frame with at least each area: sums of whole bins, so the straddled bin is left out.

    thresholds are areas or, with fraction_of, shares of that column. frames has n_frames once per video.
    """
    limit = F.col("threshold") * (F.col(fraction_of) if fraction_of else F.lit(1.0))
    rows = hist.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    sums = rows.groupBy(*by, "threshold").agg(F.sum(F.when(F.col("bin_lo") >= limit, F.col("n")).otherwise(0)).alias("n_blobs"))
    total = frames.groupBy(*by).agg(F.sum("n_frames").alias("n_frames"))
    out = sums.join(total, list(by)) if by else sums.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("blobs_per_frame", F.col("n_blobs") / F.col("n_frames"))


def recall_grid(matched: DataFrame, areas: Sequence[float], coverages: Sequence[float], by: Sequence[str] = (), area: str = "blob_area", coverage: str = "coverage") -> DataFrame:
    """Share of annotated boxes found at each least area and coverage: one scan, the grid is exploded."""
    rows = matched.withColumn("min_area", F.explode(F.array(*(F.lit(float(a)) for a in areas)))).withColumn("min_coverage", F.explode(F.array(*(F.lit(float(c)) for c in coverages))))
    hit = (F.col(area) >= F.col("min_area")) & (F.col(coverage) >= F.col("min_coverage"))
    return rows.groupBy(*by, "min_area", "min_coverage").agg(F.count("*").alias("n_gt"), F.count_if(hit).alias("found"), (F.count_if(hit) / F.count("*")).alias("recall"))


def operating_curve(per_frame: DataFrame, recall: DataFrame, seconds: float) -> DataFrame:
    """Recall against the cost in hours of scoring every detection, per threshold."""
    joined = per_frame.join(recall, per_frame["threshold"] == recall["min_area"])
    return joined.select("threshold", "min_coverage", "blobs_per_frame", "recall", (F.col("n_blobs") * seconds / 3600).alias("hours"))


def overlap(df: DataFrame, methods: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Hits of several methods on the same objects: each, union, intersection, alone, none, and the gain over the best."""
    c = [F.col(m) for m in methods]
    any_of, all_of = c[0], c[0]
    for x in c[1:]:
        any_of, all_of = any_of | x, all_of & x
    alone = []
    for m in methods:
        only = F.col(m)
        for o in methods:
            if o != m:
                only = only & ~F.col(o)
        alone.append(F.count_if(only).alias(f"only_{m}"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(m)).alias(f"n_{m}") for m in methods), F.count_if(any_of).alias("n_union"), F.count_if(all_of).alias("n_intersection"), F.count_if(~any_of).alias("n_missed"), *alone)
    return out.withColumn("union_gain", F.col("n_union") - F.greatest(*(F.col(f"n_{m}") for m in methods)))


def banded(df: DataFrame, value: str, edges: Sequence[float], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per half-open band [edge, next edge); the last band is open, values below the first edge are band -1."""
    band = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(value))) - 1
    return df.groupBy(band.alias("band")).agg(*(c.alias(n) for n, c in aggregates.items()))


def two_denominators(df: DataFrame, kept: Column, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Recall over the rows kept and over all rows, where dropped rows count as misses; both counts are reported."""
    n_kept, n_hit = F.count_if(kept), F.count_if(kept & hit)
    return df.groupBy(*by).agg(F.count("*").alias("n_all"), n_kept.alias("n_kept"), n_hit.alias("n_hit")).withColumns({"recall_kept": F.try_divide("n_hit", "n_kept"), "recall_all": F.try_divide("n_hit", "n_all"), "n_dropped": F.col("n_all") - F.col("n_kept")})


def concentration(df: DataFrame, group: Sequence[str], member: str, tops: Sequence[int] = (2, 5)) -> DataFrame:
    """Per group: rows, members, and the shares of its largest members.

    Members are ranked only as far as the largest of `tops`, which each task does before it sends its rows on.
    """
    counts = df.groupBy(*group, member).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*group).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_members"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), member)
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(tops))
    first = ranked.groupBy(*group).agg(*(F.sum(F.when(F.col("rank") <= t, F.col("n")).otherwise(0)).alias(f"top{t}") for t in tops))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    both = whole.alias("a").join(first.alias("b"), same)
    return both.select(*(F.col(f"a.{g}").alias(g) for g in group), "n_rows", "n_members", *((F.col(f"top{t}") / F.col("n_rows")).alias(f"top{t}_share") for t in tops))


def over_limit(df: DataFrame, limits: DataFrame, on: Sequence[str], area: str, limit: str, coverages: Sequence[float], coverage: str, by: Sequence[str] = ()) -> DataFrame:
    """What an upper area limit costs: found boxes at each coverage, and how many of them lie above the limit.

    limits, a row per value of on, goes out to every task: dealt by so few values, all boxes would lie in as few tasks.
    """
    rows = df.join(F.broadcast(limits), list(on)).withColumn("min_coverage", F.explode(F.array(*(F.lit(float(c)) for c in coverages))))
    hit = F.col(coverage) >= F.col("min_coverage")
    return rows.groupBy(*by, "min_coverage").agg(F.count_if(hit).alias("found"), F.count_if(hit & (F.col(area) > F.col(limit))).alias("lost"))


def anchor(per_frame: DataFrame, matched: DataFrame, rate: float, coverage: float) -> DataFrame:
    """Lower anchor: largest share a covering detection takes; upper: first grid value with few enough detections; their geometric middle."""
    low = matched.where(F.col("coverage") >= coverage).agg(F.max("area_frac").alias("lower"))
    high = per_frame.where(F.col("blobs_per_frame") <= rate).agg(F.min("threshold").alias("upper"))
    both = low.crossJoin(F.broadcast(high))  # one row each
    return both.withColumns({"middle": F.sqrt(F.col("lower") * F.col("upper")), "overlap": F.col("lower") >= F.col("upper")})


def confusion(df: DataFrame, truth: str, call: str, truths: Sequence[str], calls: Sequence[str], undecided: str) -> DataFrame:
    """Counts per true class and call, and accuracy over decided calls; every true class is reported."""
    spark = df.sparkSession
    every = spark.createDataFrame([(t,) for t in truths], f"{truth} string")
    counts = df.groupBy(truth).agg(*(F.count_if(F.col(call) == c).alias(c) for c in calls), F.count_if(F.col(call) != undecided).alias("decided"), F.count_if(F.col(call) == F.col(truth)).alias("right"))
    out = every.join(counts, truth, "left").fillna(0)
    return out.withColumn("accuracy", F.try_divide("right", "decided"))


def agreement(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """How many pairs were scored twice and how many agree; pairs with a null score do not count."""
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    return pairs.agg(F.count_if(both).alias("n_pairs"), F.count_if(both & (F.col(first) == F.col(second))).alias("n_agree"))


def condition_table(df: DataFrame, row: str, condition: str, usable: Column, joint: str = "AB") -> DataFrame:
    """Usable rows per condition, where a joint condition counts in each of its parts."""
    parts = F.when(F.col(condition) == joint, F.split(F.lit(",".join(joint)), ",")).otherwise(F.array(F.col(condition)))
    rows = df.withColumn("part", F.explode(parts))
    return rows.groupBy(row, "part").agg(F.count("*").alias("n"), F.count_if(usable).alias("n_usable"))


def usable_yield(df: DataFrame, by: Sequence[str], score: str, frames: str, length: str) -> DataFrame:
    """Mean usable frames: all for a usable window, the recorded count for a degraded one (unknown ones left out), else none."""
    value = F.when(F.col(score) == "usable", F.col(length).cast("double")).when(F.col(score) == "degraded", F.col(frames).cast("double")).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_frames"))


def run_place(start: Column, length: Column, total: Column) -> Column:
    """Where a visible run lies in its window: whole, lead, trail, both ends cut, or none."""
    return (
        F.when(length <= 0, "none").when((start == 0) & (length == total), "whole").when(start == 0, "trail_cut").when(start + length == total, "lead_cut").otherwise("both_cut")
    )


def rolled_up(df: DataFrame, by: Sequence[str], counters: Sequence[str], part: str, whole: str) -> DataFrame:
    """Sums of per-video counters and the rate of two of them."""
    sums = df.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in counters))
    return sums.withColumn("recall", F.round(F.try_divide(part, whole), 6))


def storage(per_frame: DataFrame, splits: DataFrame, bytes_each: int, seconds_each: float) -> DataFrame:
    """Bytes and hours of keeping and scoring every proposal, per split and threshold."""
    rows = per_frame.crossJoin(F.broadcast(splits))  # a row per split
    n = F.col("blobs_per_frame") * F.col("split_frames")
    return rows.select("split", "threshold", n.alias("n_proposals"), (n * bytes_each).alias("bytes"), (n * seconds_each / 3600).alias("hours"))


def pass_cost(frames: DataFrame, rates: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    """Seconds of one pass over all frames at known rates; videos without a rate are counted, not dropped."""
    rows = frames.join(rates, on, "left")
    return rows.groupBy(*by).agg(F.sum(F.try_divide("n_frames", "rate")).alias("seconds"), F.count_if(F.col("rate").isNull()).alias("n_unknown"))


def collated(grid: DataFrame, runs: DataFrame, key: Sequence[str], group: str, value: str, ceiling: str) -> DataFrame:
    """Spread of runs over an expected grid, headroom against the ceiling, and the number of runs that are missing."""
    rows = grid.join(runs, list(key), "left")
    out = rows.groupBy(group).agg(F.count(value).alias("n_runs"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(ceiling).alias("ceiling"))
    return out.withColumn("headroom", F.try_divide("mean", "ceiling"))


def run_table(runs: DataFrame, epochs: DataFrame, key: Sequence[str], subset: str, full: str, seconds: Sequence[str]) -> DataFrame:
    """runs with the gap of the subset's value over the full pass's, their number of epochs and the sums of epoch times."""
    spent = epochs.groupBy(*key).agg(F.count("*").alias("n_epochs"), *(F.sum(c).alias(c) for c in seconds))
    return runs.join(spent, list(key), "left").withColumn("gap", F.col(subset) - F.col(full))


def mean_by_scene(runs: DataFrame, arm: str, scene: str, value: str, ceiling: str) -> DataFrame:
    """Per arm and scene: the mean over runs that have a value, the scene's ceiling, and how far the mean stays below it."""
    out = runs.groupBy(arm, scene).agg(F.count(value).alias("n_runs"), F.avg(value).alias("mean"), F.max(ceiling).alias("ceiling"))
    return out.withColumn("below", F.col("ceiling") - F.col("mean"))
