"""Label formats, merged precision, epoch logs that survive replay, long anchored runs, and the table function."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import metrics, sequence
from frameloom.sources import scans
from frameloom.streaming import epochs, table_functions
from frameloom.streaming.background import foreground
from tests.test_frame_streams import FRAMES, found, noisy


def test_both_label_formats(spark, tmp_path):
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.txt").write_text("1.0 1.0 2 3 4 5 drone\n\n  2 0\n1.0 2 1 1 1 1 x 2.5 2 2 2 y\n3e0 0.0\n")
    many = scans.label_frames(spark, str(tmp_path / "many"))
    assert sorted((r.frame, r.n) for r in many.collect()) == [(1, 2), (2, 0), (3, 0)]
    assert sorted((r.x, r.kind) for r in scans.boxes_of(many).where("idx IS NOT NULL").collect()) == [(1.0, "x"), (2.5, "y")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "b.txt").write_text("7.0 1.5 2 3 4\n7 5 6 7 8 bird of prey\n\n 9.9 1 1 1 1 x\n")
    one = scans.label_frames(spark, str(tmp_path / "one"), fmt=scans.ONE_BOX)
    assert sorted((r.frame, r.idx, r.x, r.h, r.kind) for r in scans.boxes_of(one).collect()) == [(7, 0, 1.5, 4.0, None), (7, 1, 5.0, 8.0, "bird"), (9, 0, 1.0, 1.0, "x")]
    assert scans.box_counts(one).first()[1:] == (3, 2, 0)


@pytest.mark.parametrize("line, fmt, message", [
    ("1 2 1 1 1 1 x", scans.MULTIBOX, "wrong number of fields"), ("1", scans.MULTIBOX, "wrong number of fields"), ("x 0", scans.MULTIBOX, "no frame number"), ("1 x", scans.MULTIBOX, "wrong number of fields"),
    ("1 2 3 4", scans.ONE_BOX, "too few fields"), ("nan 1 2 3 4", scans.ONE_BOX, "no frame number"),
])
def test_bad_label_lines_name_themselves(spark, tmp_path, line, fmt, message):
    (tmp_path / "c.txt").write_text(f"5 0\n{line}\n" if fmt == scans.MULTIBOX else f"5 1 2 3 4\n{line}\n")
    with pytest.raises(Exception, match=f"{message} in .*c.txt: {line}"):
        scans.label_frames(spark, str(tmp_path), fmt=fmt).collect()
    with pytest.raises(ValueError, match="unknown label format"):
        scans.label_frames(spark, str(tmp_path), fmt="other")


def test_merged_precision(spark):
    rng = np.random.default_rng(8)
    rows = [(["a", "b", "c", None][int(g)], int(s), int(k), ["positive", "negative", "ignored"][int(x)]) for k, (g, s, x) in enumerate(zip(rng.integers(0, 4, 4000), rng.integers(0, 5, 4000), rng.integers(0, 3, 4000)))]
    scored = spark.createDataFrame(rows, "grp string, score long, doc_id long, label string").repartition(5)
    truth = spark.createDataFrame([("a",)] * 900 + [("d",)] * 3 + [("b",)] * 500, "grp string")
    same = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    want = same(metrics.average_precision(scored, truth, ["grp"]))
    assert same(metrics.merged_precision(scored, truth, ["grp"])) == want and len(want) >= 4
    ranking = sorted((r for r in rows if r[0] == "a" and r[3] != "ignored"), key=lambda r: (-r[1], r[2]))
    hits = [i + 1 for i, r in enumerate(ranking) if r[3] == "positive"]
    assert next(r for r in want if r[0] == "a")[-1] == round(sum((k + 1) / i for k, i in enumerate(hits)) / 900, 9)
    assert same(metrics.merged_precision(scored.limit(0), truth, ["grp"])) == same(metrics.average_precision(scored.limit(0), truth, ["grp"]))


def slow_anchored(x, y, w, h):
    best, at = 0, 0
    for s in range(len(x)):
        e = s + 1
        while e < len(x) and not (abs(x[e] - x[s]) > w[s] / 2 or abs(y[e] - y[s]) > h[s] / 2):
            e += 1
        if e - s > best:
            best, at = e - s, s
    return best, at


def test_anchored_runs_on_random_tracks():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        x, y = np.cumsum(rng.integers(-2, 3, (2, n)), axis=1).astype(float)
        w, h = rng.integers(-1, 14, (2, n)).astype(float)
        x[rng.random(n) < 0.05] = np.nan
        assert sequence.longest_anchored(x, y, w, h) == slow_anchored(x, y, w, h)


def test_anchored_runs_of_many_long_starts():
    n = 200_000
    x = np.arange(n) / n * 1.9  # every start runs for half the track, none for all of it
    began = time.time()
    assert sequence.longest_anchored(x, x * 0, np.full(n, 2.0), np.ones(n))[0] > n // 2
    assert time.time() - began < 5


def test_epoch_log_is_the_batch_result_and_survives_replay(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(run, e, None if rng.random() < 0.1 and e else float(v)) for run in ("a", "b") for e, v in enumerate(rng.integers(0, 6, 14 if run == "a" else 5))]
    schema = "run string, epoch long, value double"
    want = sorted((tuple(r) for r in sequence.early_stop(spark.createDataFrame(rows, schema), ["run"], "epoch", "value", 4).select("run", "epoch", "value", "best", "epochs_since_best", "stopped").collect()), key=repr)
    for k, cuts in enumerate(([0, 20], [0, 1, 4, 5, 9, 20])):
        path = f"{tmp_path}/{k}"
        sink = epochs.epoch_sink(path, "run", "epoch", "value", 4)
        parts = [spark.createDataFrame([r for r in rows if a <= r[1] < b], schema) for a, b in zip(cuts, cuts[1:])]
        assert not epochs.may_stop(spark, path, "run", "string")
        for n, part in enumerate(parts):
            sink(part, n)
            if n % 2 == 0:
                sink(part, n)  # the driver was lost after the batch was written and before it was noted
        log = epochs.epoch_log(spark, path)
        assert sorted((tuple(r) for r in log.select("run", "epoch", "value", "best", "epochs_since_best", "stopped").collect()), key=repr) == want
        known = {r.run: r for r in epochs.known(spark, path, "run", "string").collect()}
        assert known["a"].last_epoch == 13 and known["b"].last_epoch == 4
        sink(parts[-1], len(parts))  # epochs that were seen already come under a new number
        assert epochs.epoch_log(spark, path).count() == len(rows)
        for n, run in enumerate(("a", "b"), len(parts) + 1):
            sink(spark.createDataFrame([(run, e, -1.0) for e in range(50, 60)], schema), n)
        assert epochs.may_stop(spark, path, "run", "string")


def test_table_function(spark):
    for colour in (False, True):
        frames = spark.createDataFrame(noisy(colour=colour), FRAMES).repartition(5)
        table_functions.register(spark, "some_components", seed=4, low=0.004)
        got = spark.sql("SELECT * FROM some_components(TABLE({f}) PARTITION BY video ORDER BY frame)", f=frames)
        assert found(got) == found(foreground(frames, seed=4, low=0.004)) and got.count() > 60
        joined = spark.sql("SELECT c.video, count(*) AS n FROM some_components(TABLE({f}) PARTITION BY video ORDER BY frame) c WHERE c.area > 9 GROUP BY c.video", f=frames)
        assert joined.count() == 3
    assert spark.sql("SELECT * FROM some_components(TABLE({f}) PARTITION BY video ORDER BY frame)", f=frames.limit(0)).count() == 0
    assert spark.createDataFrame(noisy(), FRAMES).agg(F.count("*")).first()[0] > 0
