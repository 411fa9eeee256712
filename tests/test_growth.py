"""What only showed on larger tables: near ties, frames that pass a task once, offsets of many files, readers of small pieces."""

from __future__ import annotations

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions.columns import file_stem
from frameloom.operators import matching as M
from frameloom.plans import catalog
from frameloom.sources import video
from frameloom.sources.painted import painted
from frameloom.sources.video_stream import TASKS, VideoStream, write_videos
from frameloom.streaming import tubelets
from frameloom.streaming.background import crop
from tests.comparing import same_rows


def test_totals_of_boxes_on_one_line_are_compared_as_sql_does(spark, sf, tmp_path):
    values = [(50.0,), (34.03,), (29.12,), (86.74,), (60.4,)]  # crossed and straight are equal but for their last bit
    points = [(v, 0.0) for (v,) in values]
    assert M.associate(points[1:3], points[3:])[0] == {0: 0, 1: 1} and M.associate(points[1:3], points[3:], slack=0.0)[0] == {0: 1, 1: 0}
    rows = [(50 * i, datetime.datetime(2024, 1, 1, 0, i), 7, "view", v, "{}") for i, (v,) in enumerate(values)]
    for name in ("region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations").split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "events.parquet").symlink_to(next((tmp_path / "written").glob("*.parquet")))
    same_rows(catalog.queries()["track_association"](spark, str(tmp_path)), catalog.oracle_sql()["track_association"], str(tmp_path))


def moved_after_python(df) -> bool:
    """Whether rows that Python has made are shuffled in df's plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    python = [i for i, line in enumerate(lines) if "MapInPandas" in line]
    return any("Exchange" in line for line in lines[: max(python)])


def test_a_micro_batch_has_few_tasks_for_many_videos():
    reader = VideoStream({"path": "/none", "progress": "/none"}).streamReader(None)
    end = {f"v{i:05}": 60 + i % 7 for i in range(9000)}
    parts = reader.partitions({"v00001": 50}, end)
    assert len(parts) <= TASKS + 1
    assert [r for p in parts for r in p.ranges] == [(v, 50 if v == "v00001" else 0, n) for v, n in end.items()]


def test_packed_videos_are_small_and_read_frame_by_frame(spark, tmp_path):
    frames = painted(spark.range(60).selectExpr("'v' || id % 2 AS video", "id div 2 AS frame", "CAST(id % 20 AS int) AS x", "3 AS y", "4 AS w", "5 AS h", "array(30, 220, 200) AS shade"), 32, 48, (90, 90, 90), in_order=True)
    write_videos(frames, f"{tmp_path}/packed", in_order=True, packed=True)
    write_videos(frames, f"{tmp_path}/plain")
    for v in ("v0", "v1"):
        packed, plain = ((tmp_path / kind / f"{v}.y4m").read_bytes() for kind in ("packed", "plain"))
        assert len(packed) * 20 < len(plain)
        assert list(video.y4m_colour_frames(packed)) == list(video.y4m_colour_frames(plain)) and video.y4m_probe(packed) == video.y4m_probe(plain)
        cut = list(video.y4m_colour_frames(packed[:-40]))  # the file ends within a frame
        assert len(cut) < 30 and cut == list(video.y4m_colour_frames(plain))[: len(cut)]


@pytest.mark.parametrize("name", ["tubelets", "scored_clips", "foreground_components"])
def test_painted_frames_are_not_moved(spark, sf, name):
    assert not moved_after_python(catalog.queries()[name](spark, sf))


def test_clips_across_batches_gaps_and_repeats(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rng = np.random.default_rng(3)
    images = {(v, k): rng.integers(0, 256, (12 + v, 15, 3 - 2 * v)).astype(np.uint8) for v in range(2) for k in range(40)}
    there = [(v, k) for v, k in images if k not in (9, 25)]
    rows = [(f"v{v}", k, 12 + v, 15, images[v, k].tobytes()) for v, k in [*there, (0, 17), (1, 30), (1, 30)]]
    boxes = [(i, f"v{i % 2}", int(rng.integers(-2, 42)), float(rng.integers(-30, 40)), float(rng.integers(-9, 12)), float(rng.integers(1, 5)), 3.0) for i in range(300)]
    proposals = spark.createDataFrame(boxes, "proposal long, video string, centre long, x double, y double, w double, h double")
    frames = spark.createDataFrame(rows, "video string, frame long, height int, width int, pixels binary").repartition(3)
    want = {}
    for i, v, centre, x, y, w, h in boxes:
        window = [(int(v[1]), k) for k in range(centre - 1, centre + 3)]
        if all(k in there and k not in ((0, 17), (1, 30)) for k in window):
            parts = [crop(images[k], x + w / 2, y + h / 2, max(w, h) * 2, 6) for k in window]
            want[i] = (v, centre, 4, max(s for _, s in parts), b"".join(p.tobytes() for p, _ in parts))
    try:
        for size in (1, 7, 1000):
            spark.conf.set(name, size)
            got = {r.proposal: (r.video, r.centre, r.n, r.synthetic, bytes(r.clip)) for r in tubelets.assembled(proposals, frames, 4, 6, 0.5).collect()}
            assert got == want and len(want) > 100
    finally:
        spark.conf.set(name, before)


def test_pictures_are_coloured_together(monkeypatch):
    calls, real = [], video.to_bgr
    monkeypatch.setattr(video, "to_bgr", lambda planes: calls.append(1) or real(planes))
    content = b"YUV4MPEG2 W6 H5 F25:1 C420jpeg\n" + b"".join(b"FRAME\n" + bytes((7 * k + i) % 256 for i in range(48)) for k in range(500))
    assert sum(1 for _ in video.y4m_colour_frames(content)) == 500 and len(calls) == 1


def test_label_files_are_parsed_once(spark, sf):
    plan = catalog.queries()["single_box_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan


def test_listing_of_values_with_several_files_and_none(spark, sf, tmp_path):
    for name in ("region nation customer supplier part lineitem events documents embeddings pages benchmark labels conversations").split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    rows = [(i, "AFO"[i % 3] if i % 10 else None) for i in range(900)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "orders.parquet").symlink_to(next((tmp_path / "written").glob("*.parquet")))
    same_rows(catalog.queries()["file_listing"](spark, str(tmp_path)), catalog.oracle_sql()["file_listing"], str(tmp_path))


def test_stems_of_long_paths(spark):
    paths = ["", "/", "a", "a/", "a/b", "/x.y/b", "x/b.txt", "x/.hidden", "x/b.tar.gz", "x/b.", "x/..", "file:///p/q-1/part-00000-c000.txt", "http://h.org", "a.b/c\n", "a/\n", "a\n/b.c", "a/b.c\r\n", "é/ü.txt", None]
    odd = spark.createDataFrame(list(enumerate(paths)), "i int, p string")
    whole = F.regexp_extract("p", r"([^/]*?)(\.[^./]*)?$", 1)  # what a stem is, tried from every letter of the path
    assert odd.where(~file_stem(F.col("p")).eqNullSafe(whole)).collect() == [] and odd.count() == len(paths)
    long = spark.range(20).select(F.concat(F.lit("/" + "d" * 30_000 + "/v"), "id", F.lit(".txt")).alias("p"))
    began = time.time()
    assert sorted(r[0] for r in long.select(file_stem(F.col("p"))).collect()) == sorted(f"v{i}" for i in range(20))
    assert time.time() - began < 5


def test_few_limits_do_not_gather_the_boxes(spark, sf):
    plan = catalog.queries()["upper_limit_cost"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(frame" in plan and "hashpartitioning(resolution" not in plan


def test_best_of_a_list_is_the_best_of_the_pairs(spark):
    rng = np.random.default_rng(5)
    schema = "frame long, idx long, x long, y long, w long, h long, scene string"
    odd = lambda v, k: None if k % 23 == 0 else int(v)
    rows = [(None if k % 31 == 0 else k // 9, k, odd(x, k), int(y), int(w), int(h), f"s{k % 3}" if k % 5 else None) for k, (x, y, w, h) in enumerate(rng.integers(-2, 9, (900, 4)))]
    boxes = spark.createDataFrame(rows, schema).repartition(5)
    blobs, gts = boxes.where("idx % 3 > 0 AND coalesce(frame, 0) % 7 > 0"), boxes.where("idx % 3 = 0")
    order = ["frame", "gt", "blob", "coverage", "blob_area", "n_blobs", "scene"]
    same = lambda df: sorted((tuple(r) for r in df.select(order).collect()), key=repr)
    want = M.best_per_gt(M.coverages(blobs, gts, keep=("scene",)), keep=("scene",))
    got = M.best_in_frame(blobs, gts, keep=("scene",))
    assert same(got) == same(want) and got.count() > 200 and got.select(order).dtypes == want.select(order).dtypes
