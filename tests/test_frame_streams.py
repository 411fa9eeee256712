"""The background pass and the clips as streams against their batch forms, for any cut of the input and after restarts."""

from __future__ import annotations

import os
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pytest

from frameloom.sources.frames import moving_square
from frameloom.sources.video import decoded, y4m_colour_frames, y4m_frames
from frameloom.sources.video_stream import VideoStream, write_videos
from frameloom.streaming import stateful
from frameloom.streaming.background import foreground
from frameloom.streaming.tubelets import assembled, dropped
from frameloom.streaming.windows import full_batches, micro_batches
from tests.conftest import ROOT

FRAMES = "video string, frame long, height int, width int, pixels binary"


def noisy(n=26, colour=False):
    rows = []
    for v in range(3):
        for k, image in enumerate(moving_square(v, n - 3 * v, 20, 26, 6, noise=6.0, enters=2)):
            image = np.stack([image, image[::-1], 255 - image], axis=2) if colour else image
            rows.append((f"v{v}", k, 20, 26, image.tobytes()))
    return rows


def proposals(spark):
    rows = [(i, f"v{i % 3}", i // 3, float(i * 5 % 24 - 2), float(i * 3 % 18 - 2), 3.0 + i % 4, 2.0 + i % 5) for i in range(90)] + [(500, "gone", 3, 0.0, 0.0, 2.0, 2.0)]
    return spark.createDataFrame(rows, "proposal long, video string, centre long, x double, y double, w double, h double")


def found(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


def files(spark, path, rows, cuts):
    """Frames in files of ranges of frames, each older than the next; rows within a file are in no order."""
    for a, b in zip([0, *cuts], [*cuts, 10**9]):
        part = [r for r in rows if a <= r[1] < b]
        if part:
            spark.createDataFrame(part[::-1], FRAMES).coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("cuts", [[], [1, 2, 11]])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cuts):
    rows = noisy()
    batch = spark.createDataFrame(rows, FRAMES)
    stream = files(spark, f"{tmp_path}/in", rows, cuts)
    want = found(foreground(batch, low=0.004))
    assert len(want) > 60
    assert found(stateful.drained(stateful.foreground_stream(stream, low=0.004, idle_ms=None), "t")) == want
    want = assembled(proposals(spark), batch, 8, 6, 0.5)
    clips = stateful.drained(stateful.clip_stream(proposals(spark), stream, 8, 6, 0.5, idle_ms=None), "t")
    assert found(clips.select(*want.columns)) == found(want) and clips.count() > 20
    assert found(dropped(proposals(spark), clips)) == found(dropped(proposals(spark), want))


def test_gaps_repeats_and_colour(spark, tmp_path):
    rows = [r for r in noisy(colour=True) if r[1] != 12]
    batch = spark.createDataFrame(rows, FRAMES)
    stream = files(spark, f"{tmp_path}/in", rows + [(*r[:2], 20, 26, bytes(1560)) for r in rows if r[1] == 7], [9])
    repeated = spark.createDataFrame([r for r in rows if 4 < r[1] < 9], FRAMES).coalesce(1)
    repeated.write.mode("append").parquet(f"{tmp_path}/in")  # frames that were seen already come again
    clips = stateful.drained(stateful.clip_stream(proposals(spark), stream, 4, 6, 0.5, idle_ms=None), "t")
    want = found(assembled(proposals(spark), batch, 4, 6, 0.5))
    got = found(clips)
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(len(r[5]) == 4 * 6 * 6 * 3 for r in got)


@pytest.mark.parametrize("colour", [False, True])
def test_a_video_stream_goes_on_after_a_restart(spark, tmp_path, colour):
    spark.dataSource.register(VideoStream)
    rows = noisy(colour=colour)
    frames = spark.createDataFrame(rows, FRAMES)
    path = f"{tmp_path}/videos"
    options = {"path": path, "progress": f"{tmp_path}/progress", "frames_per_batch": 5}
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    for upto in (7, 7, 18, 99):  # files grow between runs, and once nothing is new
        write_videos(frames.where(f"frame < {upto}"), path)
        stream = spark.readStream.format("video_stream").options(**options).load()
        got = stateful.drained(stateful.foreground_stream(stream, low=0.004, idle_ms=None), "t", check, out)
    contents = spark.read.format("binaryFile").load(path).selectExpr("regexp_extract(path, '([^/]+)[.]y4m$', 1) AS video", "content")
    batch = decoded(contents, y4m_colour_frames if colour else y4m_frames)
    assert found(got) == found(foreground(batch, low=0.004)) and batch.count() == len(rows)
    if not colour:
        assert found(batch) == found(frames)
    seen = spark.readStream.format("video_stream").options(**(options | {"progress": f"{tmp_path}/other"})).load()
    assert found(stateful.drained(seen, "t")) == found(batch)  # every frame once, as the decoder gives it


def test_plans_go_forward_only(spark, tmp_path):
    rows = noisy()
    write_videos(spark.createDataFrame(rows, FRAMES), f"{tmp_path}/videos")
    options = {"path": f"{tmp_path}/videos", "progress": f"{tmp_path}/progress", "frames_per_batch": "4"}
    first = VideoStream(options).streamReader(None)
    a = first.latestOffset()
    b = first.latestOffset()
    assert a == {"v0": 4, "v1": 4, "v2": 4} and b == {"v0": 8, "v1": 8, "v2": 8}
    again = VideoStream(options).streamReader(None)  # as after a restart
    assert again.latestOffset() == {"v0": 12, "v1": 12, "v2": 12}
    replayed = [f for p in again.partitions(a, b) for f in again.read(p)]
    assert [(r[0], r[1], r[4]) for r in replayed] == [(r[0], r[1], r[4]) for r in rows if 4 <= r[1] < 8]
    assert again.partitions(b, b) == []


def until(true, seconds=40):
    """Timers keep a query awake, so it is watched rather than waited for."""
    for _ in range(2 * seconds):
        if true():
            return
        time.sleep(0.5)


def test_idle_videos_lose_their_state(spark, tmp_path):
    rows = noisy()
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    write = lambda a, b: spark.createDataFrame([r for r in rows if a <= r[1] < b and r[0] == "v0"], FRAMES).coalesce(1).write.mode("append").parquet(source)
    write(0, 6)
    stream = spark.readStream.schema(FRAMES).parquet(source)
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKS)
    query = stateful.clip_stream(proposals(spark), stream, 8, 6, 0.5, idle_ms=1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="500 milliseconds").start()
    spark.conf.set(stateful.PROVIDER, before)
    try:
        until(lambda: any(p["numInputRows"] for p in query.recentProgress) and sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) == 0)
        write(6, 14)  # frames 6 and 7 would complete windows if the first six were still there
        until(lambda: sum(p["numInputRows"] for p in query.recentProgress) == 14)
    finally:
        query.stop()
    got = spark.read.schema("proposal long, video string, centre long").parquet(out).collect()
    assert {r.centre for r in got} == {9}


def test_full_batches(spark):
    pdfs = [pd.DataFrame({"id": range(a, b)}) for a, b in ((0, 3), (3, 4), (4, 4), (4, 15), (15, 17))]
    got = list(full_batches(iter(pdfs), 4))
    assert [len(x) for x in got] == [4, 4, 4, 4, 1] and pd.concat(got)["id"].tolist() == list(range(17))
    assert list(full_batches(iter([]), 4)) == []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for arrow in (3, 7, 1000):
            spark.conf.set(name, arrow)
            sizes = micro_batches(spark.range(100).repartition(3), lambda p: pd.DataFrame({"n": [len(p)]}), ["id"], "n long", size=8)
            per_part = sizes.rdd.mapPartitions(lambda rows: [[r.n for r in rows]]).collect()
            assert sum(map(sum, per_part)) == 100 and all(set(p[:-1]) <= {8} for p in per_part)
    finally:
        spark.conf.set(name, before)


def test_a_session_without_a_shared_folder(tmp_path):
    code = "from frameloom.session import local_session, staged, shared_dir\ns = local_session(2, 2)\nassert s.conf.get('spark.checkpoint.dir', None) is None\nassert staged(s.range(9), 'x').count() == 9 and shared_dir(s) == shared_dir(s)\nprint('fine')"
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
