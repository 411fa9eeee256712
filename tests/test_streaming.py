from __future__ import annotations

import time

from frameloom.streaming.windows import rolling_stream


def test_windows_cross_micro_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for k, frames in enumerate(([0, 1, 2, 3, 4], [5, 6, 7, 8, 12], [13])):
        rows = [(v, f, float(f)) for v in ("a", "b") for f in frames]
        spark.createDataFrame(rows, "video string, frame long, value double").coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema("video string, frame long, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = rolling_stream(stream, 4, idle_ms=None).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = {(r.video, r.centre, r.first_frame, r.last_frame, r.total) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(v, s + 1, s, s + 3, float(4 * s + 6)) for v in ("a", "b") for s in range(6)}


def test_idle_videos_lose_their_buffer(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    write = lambda frames: spark.createDataFrame([("a", f, 1.0) for f in frames], "video string, frame long, value double").coalesce(1).write.mode("append").parquet(str(source))
    write([0, 1])
    stream = spark.readStream.schema("video string, frame long, value double").parquet(str(source))
    query = rolling_stream(stream, 3, idle_ms=1500).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        time.sleep(12)
        write([2, 3])  # would complete 0..2 if the buffer were still there
        time.sleep(8)
    finally:
        query.stop()
    assert spark.read.schema("video string, centre long").parquet(str(out)).count() == 0
