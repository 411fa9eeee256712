"""Operators on small hand-made rows, and folds against independent definitions."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import governance as G
from frameloom.operators import joins as J
from frameloom.operators import matching as M
from frameloom.operators import metrics as X
from frameloom.operators import sampling as S
from frameloom.operators import sequence as Q

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


def test_parsing(spark):
    assert [one(spark, C.truthy(F.col("a")), a=a) for a in (" True", "1", "yes", "no", "T ", "x")] == [True, True, True, False, True, False]
    assert [one(spark, C.tolerant_int(F.col("a")), a=a) for a in (" 08", "8.5", "", "-3")] == [8, None, None, -3]
    assert one(spark, C.rational(F.col("a")), a="30000/1001") == pytest.approx(29.97002997)
    assert one(spark, C.rational(F.col("a")), a="5/0") is None
    assert [one(spark, C.nearest_odd(F.col("a")), a=a) for a in (0.2, 1.0, 2.0, 2.1, 4.0, 4.5)] == [1, 1, 1, 3, 3, 5]
    assert one(spark, C.or_else(F.col("a"), F.lit(7)), a=0) == 7


def test_geometry(spark):
    g = C.box_geometry(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("r"))
    row = spark.createDataFrame([(-5.0, 10.0, 10.0, 4.0, "100x50")], "x double, y double, w double, h double, r string").select(*(c.alias(n) for n, c in g.items())).first()
    assert (row.visible_area, row.box_area, row.clipped, row.cx) == (20.0, 40.0, True, 0.0)
    assert row.equiv_side == pytest.approx(math.sqrt(20))
    assert one(spark, C.window_frames(F.col("c"), 8), c=10) == list(range(7, 15))
    assert one(spark, C.synthetic_fraction(F.lit(-50.0), F.lit(10.0), F.lit(10.0), F.col("r")), r="100x50") == 1.0


def test_bins(spark):
    edges = F.array(*map(F.lit, [1.0, 2.0, 4.0]))
    assert [one(spark, C.digitize(F.col("a"), edges), a=a) for a in (0.5, 1.0, 3.9, 4.0, 9.0)] == [0, 1, 2, 3, 3]
    largest = F.lit(100.0)
    assert [one(spark, C.log_bin(F.col("a"), largest, 10), a=a) for a in (0.5, 1.0, 99.9, 100.0, 101.0)] == [None, 0, 9, 9, None]


def greedy_by_hand(pairs, threshold):
    taken, out = (set(), set()), set()
    for cov, b, g in sorted(((-c, b, g) for b, g, c in pairs if c >= threshold)):
        if b not in taken[0] and g not in taken[1]:
            taken[0].add(b)
            taken[1].add(g)
            out.add((b, g))
    return out


@FEW
@given(st.dictionaries(st.tuples(st.integers(1, 4), st.integers(1, 4)), st.sampled_from([0.0, 0.4, 0.5, 0.7, 0.9]), min_size=1, max_size=12))
def test_greedy(spark, pairs):
    rows = [(1, b, g, c) for (b, g), c in pairs.items()]
    got = M.greedy(spark.createDataFrame(rows, "frame long, blob long, gt long, coverage double"), 0.5).collect()
    assert {(r.blob, r.gt) for r in got} == greedy_by_hand([(b, g, c) for (b, g), c in pairs.items()], 0.5)


def test_zero_area_and_no_overlap(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 5, 5), (1, 2, 50, 50, 5, 5)], "frame long, idx long, x int, y int, w int, h int")
    g = spark.createDataFrame([(1, 1, 0, 0, 0, 5), (1, 2, 90, 90, 4, 4)], "frame long, idx long, x int, y int, w int, h int")
    p = M.coverages(b, g)
    assert {r.coverage for r in p.collect()} == {0.0}
    assert {(r.gt, r.blob) for r in M.best_per_gt(p).collect()} == {(1, 1), (2, 1)}
    assert {r.label for r in M.labelled(b, p, M.greedy(p)).collect()} == {"negative"}


def test_associate():
    before, now = [(0.0, 0.0), (10.0, 0.0)], [(9.0, 0.0), (1.0, 0.0)]
    match, ratio = M.associate(before, now)
    assert match == {0: 1, 1: 0} and ratio == pytest.approx(18 / 2)
    assert M.associate(before, [(8.0, 0.0)]) == ({0: 1}, None)
    assert M.associate([], now) == ({}, None)


def test_track_ids(spark):
    rows = [("a", 1, 0, 0.0, 0.0), ("a", 1, 1, 10.0, 0.0), ("a", 2, 0, 9.0, 0.0), ("a", 2, 1, 1.0, 0.0), ("a", 4, 0, 1.0, 0.0), ("b", 1, 0, 5.0, 5.0)]
    got = M.track_ids(spark.createDataFrame(rows, "video string, frame long, idx long, cx double, cy double")).collect()
    assert {(r.video, r.frame, r.idx): r.track_id for r in got} == {("a", 1, 0): 0, ("a", 1, 1): 1, ("a", 2, 0): 1, ("a", 2, 1): 0, ("a", 4, 0): 2, ("b", 1, 0): 0}


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["positive", "negative", "ignored"])), max_size=12), st.integers(1, 5))
def test_average_precision(spark, rows, extra):
    rows = [("g", i, s, label) for i, (s, label) in enumerate(rows)]
    n_gt = sum(r[3] == "positive" for r in rows) + extra
    truth = spark.createDataFrame([("g",)] * n_gt, "grp string")
    got = X.average_precision(spark.createDataFrame(rows, "grp string, doc_id long, score int, label string"), truth, ["grp"]).first()
    tp, want = 0, 0.0
    for k, r in enumerate(sorted((r for r in rows if r[3] != "ignored"), key=lambda r: (-r[2], r[1])), 1):
        if r[3] == "positive":
            tp += 1
            want += tp / k / n_gt
    assert got.ap == pytest.approx(want) and got.ceiling == pytest.approx(tp / n_gt)


def test_average_precision_of_unmatched_groups(spark):
    rows = spark.createDataFrame([("only scored", 1, 5, "negative")], "grp string, doc_id long, score int, label string")
    got = {r.grp: (r.n_gt, r.ap) for r in X.average_precision(rows, spark.createDataFrame([("only truth",)], "grp string"), ["grp"]).collect()}
    assert got == {"only scored": (0, None), "only truth": (1, 0.0)}


TRACK = "video string, frame long, cx double, cy double, w double, h double"


@FEW
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 9)), min_size=1, max_size=14))
def test_runs(spark, steps):
    frame, rows = 0, []
    for jump, x in steps:
        frame += 2 if jump else 1
        rows.append(("v", frame, float(x), 0.0, 6.0, 6.0))
    df = spark.createDataFrame(rows, TRACK)

    def best(ok):
        runs = []
        for i in range(len(rows)):
            j = i + 1
            while j < len(rows) and rows[j][1] == rows[j - 1][1] + 1 and ok(i, j):
                j += 1
            runs.append((j - i, rows[i][1]))
        return min(runs, key=lambda r: (-r[0], r[1]))

    a = Q.anchored_runs(df, ["video"]).first()
    assert (a.run_frames, a.run_start) == best(lambda i, j: abs(rows[j][2] - rows[i][2]) <= 3)
    p = Q.pairwise_runs(df, ["video"]).first()
    assert (p.run_frames, p.run_start) == best(lambda i, j: abs(rows[j][2] - rows[j - 1][2]) <= 3)


def test_windows(spark):
    df = spark.createDataFrame([("v", f) for f in (1, 2, 3, 5, 6)], "video string, frame long")
    assert [r.frame for r in Q.full_windows(df, ["video"], 1, 1).collect()] == [2]
    near = J.in_windows(df.withColumnRenamed("frame", "centre"), df, ["video"], 1, 2)
    assert {(r.centre, r.frame) for r in near.collect()} == {(c, f) for c in (1, 2, 3, 5, 6) for f in (1, 2, 3, 5, 6) if c - 1 <= f <= c + 2}


def test_draw(spark):
    pool = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id long, cell string")
    wanted = spark.createDataFrame([(100, "a"), (101, "a"), (102, "c")], "id long, cell string")
    draws, cells = S.stratified(pool, wanted, ["cell"], 6.0, [1, 2], ["id"])
    assert {(r.cell, r.quota, r.available, r.drawn, r.shortfall) for r in cells.collect()} == {("a", 12, 10, 10, 2), ("c", 6, 0, 0, 6)}
    assert {(r.seed, r["count"]) for r in draws.groupBy("seed").count().collect()} == {(1, 10), (2, 10)}
    first = {r.id for r in S.share_of_each(pool, ["cell"], 0.1, 4, ["id"]).collect()}
    assert len(first) == 2 and first == {r.id for r in S.share_of_each(pool.repartition(3), ["cell"], 0.1, 4, ["id"]).collect()}


def test_guard(spark, tmp_path):
    df = spark.createDataFrame([("train",), (" Test",)], "split string")
    with pytest.raises(G.HeldOut):
        G.split_rows(df, ["test"])
    assert G.split_rows(df, ["TEST "], allow_test=True).count() == 1
    with pytest.raises(ValueError):
        G.split_rows(df, ["val"])
    with pytest.raises(ValueError, match="missing"):
        G.require_columns(df, ["video"])
    with pytest.raises(J.MissingKeys):
        J.lookup(df, spark.createDataFrame([("train", 1)], "split string, n int"), ["split"], "raise")


def test_gated_write(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    bad = G.violations(spark, [G.check(df, "rows", F.count("*"), 3.0), G.check(df, "note", F.count("*"), 3.0, severity="note")])
    assert {(r.check_name, r.diff, r.severity) for r in bad.collect()} == {("rows", -1.0, "failure"), ("note", -1.0, "note")}
    with pytest.raises(G.Violations, match="rows"):
        G.write_if_clean(df, bad, str(tmp_path / "out"))
    G.write_if_clean(df, bad.where("severity = 'note'"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_summary_equals_numpy(spark):
    from frameloom.operators.aggregates import summary

    values = [float(x) for x in np.random.default_rng(3).normal(size=101)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", float("nan")), ("a", None), ("b", 1.0)], "g string, v double")
    got = {r.g: r for r in summary(df, ["g"], "v").collect()}
    assert got["a"].n == 101 and got["a"].p25 == pytest.approx(np.percentile(values, 25))
    assert (got["b"].n, got["b"].p99) == (1, 1.0)


@FEW
@given(st.lists(st.sampled_from([0.0, 1.0, 1.0, 2.5, -3.0, 7.0]), min_size=1, max_size=30), st.lists(st.floats(0, 1), min_size=1, max_size=3))
def test_percentiles_with_ties(spark, values, points):
    from frameloom.operators.aggregates import percentiles

    got = percentiles(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v", points, parts=4).first()
    assert [got[f"p{i}"] for i in range(len(points))] == pytest.approx([np.percentile(values, p * 100) for p in points])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "video string, frame long, cx double, cy double, w double, h double")
    assert Q.anchored_runs(empty, ["video"]).count() == Q.pairwise_runs(empty, ["video"]).count() == 0
    assert M.track_ids(empty.withColumn("idx", F.lit(1))).count() == 0


def test_permutation_ties():
    square = [(0.0, 0.0), (2.0, 0.0)]
    match, _ = M.associate(square, [(1.0, 0.0), (1.0, 0.0)])
    assert match == dict(enumerate(next(itertools.permutations(range(2)))))


def permuted(before, now):
    """The definition: the first permutation with the smallest total, and the second total against it."""
    totals = sorted((round(sum(math.dist(now[i], before[j]) for i, j in enumerate(p)), 9), k, p) for k, p in enumerate(itertools.permutations(range(len(before)))))
    return dict(enumerate(totals[0][2])), totals[1][0] / totals[0][0] if len(totals) > 1 and totals[0][0] > 0 else None


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.tuples(*[st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=n, max_size=n)] * 2)))
def test_association_is_the_best_permutation(boxes):
    before, now = boxes
    match, ratio = M.associate(before, now)
    want, want_ratio = permuted(before, now)
    assert match == want and (ratio is None) == (want_ratio is None) and (ratio is None or ratio == pytest.approx(want_ratio))


def test_association_of_many_boxes():
    rng = np.random.default_rng(5)
    before = rng.random((50, 2)) * 100
    order = rng.permutation(50)
    now = before[order] + rng.random((50, 2)) * 0.01
    began = time.process_time()
    match, ratio = M.associate([tuple(p) for p in before], [tuple(p) for p in now])
    assert match == dict(enumerate(order.tolist())) and ratio > 1 and time.process_time() - began < 0.5


def test_a_shared_score_is_ranked_in_many_tasks(spark):
    from frameloom.operators import metrics

    rows = [(i, "g", 1.0 if i % 10 else float(i), "positive" if i % 3 == 0 else "negative") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, grp string, score double, label string")
    got = {r.doc_id: (r["rank"], r.tp, r.fp) for r in metrics.ranked(df, ["grp"]).collect()}
    tp, want = 0, {}
    for rank, (i, _, _, label) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        tp += label == "positive"
        want[i] = (rank, tp, rank - tp)
    assert got == want


def test_percentiles_both_ways(spark):
    from frameloom.operators.aggregates import percentiles

    rows = [("a" if i % 3 else None, float(i % 50)) for i in range(600)] + [("b", 5.0)] * 300 + [("b", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    built_in, parts = (sorted(map(tuple, percentiles(df, ["g"], "v", [0.0, 0.1, 0.37, 0.9, 1.0], few=few).collect())) for few in (10**6, 0))
    assert len(parts) == 2 and all(x == pytest.approx(y) for a, b in zip(built_in, parts) for x, y in zip(a[1:], b[1:]))
