"""Container probes on files put together by hand, the tensor store, and pictures in colour against plain definitions."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from frameloom.plans.containers import avi_file, box, iso_file
from frameloom.sources import probes, tensors
from frameloom.sources.containers import Opened, container_probe, iso_probe
from frameloom.sources.video import to_bgr, to_ycbcr, y4m_colour_frames
from frameloom.streaming import tubelets as T

AT = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
SECONDS = int(AT.timestamp()) + 2_082_844_800


def put(path, body):
    path.write_bytes(body)
    return str(path)


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("wide", [True, False])
def test_iso_files(tmp_path, first, wide):
    body = iso_file(1920, 1080, 30_000, [(100, 1001), (20, 2002)], SECONDS, 5_000_000, first, wide)
    path = put(tmp_path / "a.mp4", body)
    assert container_probe(path) == {"rate": "180000/7007", "frames": 120, "height": 1080, "width": 1920, "duration": 140_140 / 30_000, "created": AT}
    f = Opened(path)
    iso_probe(f)
    assert f.size > 5_000_000 and f.read_bytes < 700  # neither the media nor the table of sizes


def test_avi_files(tmp_path):
    path = put(tmp_path / "a.avi", avi_file(640, 480, 1001, 30_000, 77, f"{AT:%a %b %d %H:%M:%S %Y}", 10_001))
    assert container_probe(path) == {"rate": "30000/1001", "frames": 77, "height": 480, "width": 640, "duration": 77 * 1001 / 30_000, "created": AT}
    long = put(tmp_path / "b.avi", avi_file(640, 480, 1, 25, 77, "some day", 10, 5000))
    assert (container_probe(long)["frames"], container_probe(long)["rate"], container_probe(long)["created"]) == (5000, "25/1", None)
    y4m = put(tmp_path / "c.y4m", b"YUV4MPEG2 W3 H3 F50:2 C422\n" + (b"FRAME\n" + bytes(9 + 2 * 6)) * 4 + b"FRAME\nabc")
    assert container_probe(y4m) == {"rate": "25/1", "frames": 4, "height": 3, "width": 3, "duration": 4 / 25, "created": None}


def test_damaged_files_are_rows(spark, tmp_path):
    good = iso_file(16, 8, 90_000, [(5, 3000)], 0, 100)
    moov = good.index(b"moov") - 4
    bad = {
        "cut.mp4": good[: moov + 60], "none.mp4": box(b"ftyp", bytes(8)) + box(b"free"), "empty": b"", "text.mp4": b"no video at all, only text", "huge.mp4": good.replace(b"stbl", b"stbX"),
        "size.mp4": good[:moov] + b"\xff\xff\xff\xff" + good[moov + 4 :], "cut.avi": avi_file(4, 4, 1, 25, 2, "", 9)[:100], "video.avi": avi_file(4, 4, 1, 25, 2, "", 9).replace(b"vids", b"txts"), "counts.mp4": good.replace(b"\0\0\0\5\0\0\x0b\xb8", b"\0\0\0\6\0\0\x0b\xb8"),
    }
    names = [put(tmp_path / k, v) for k, v in bad.items()] + [str(tmp_path / "lost.mp4"), put(tmp_path / "good.mp4", good)]
    got = {os.path.basename(r.path): r for r in probes.probed(spark.createDataFrame([(n,) for n in names], "path string"), container_probe).collect()}
    assert len(got) == len(names) and {k for k, r in got.items() if r.error is None} == {"good.mp4"}
    assert (got["good.mp4"].rate, got["good.mp4"].frames, got["good.mp4"].created) == ("30/1", 5, None)


def test_every_cut_of_a_file_is_an_error(tmp_path):
    for body in (iso_file(16, 8, 90_000, [(5, 3000)], 9, 10), avi_file(4, 4, 1, 25, 2, "", 9)):
        for n in range(0, len(body), 7):
            path = put(tmp_path / f"{n}.x", body[:n])
            try:
                assert container_probe(path)["frames"] in (2, 5)  # what is cut off was not needed
            except Exception as e:
                assert str(e)


# ---- tensor store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('store')}/clips"
    rows = spark.range(0, 50_000, 5).select("id", F.unhex(F.concat(F.md5(F.col("id").cast("string")), F.md5(F.lit("x")))).alias("data"))
    tensors.write_tensors(rows.repartition(9), path, 32)
    return path, {r.id: bytes(r.data) for r in rows.collect()}


def test_records_come_back(spark, store):
    path, want = store
    for condition, ids in [
        (None, want), ("id >= 100 AND id < 900", [i for i in want if 100 <= i < 900]), ("id = 45", [45]), ("id IN (5, 6, 49995, -1, null)", [5, 49995]), ("id > 49990 OR id = 0", [49995, 0]),
        ("id > 49980 AND id <= 49990 AND id % 2 = 0", [49990]), ("id IN (5, 10, 15) AND id > 5 AND id IN (10, 20)", [10]), ("id < 0", []), ("data = x'00'", []), ("id IS NULL", []), ("45 = id", [45]), ("id <> 5 AND id < 15", [0, 10]),
    ]:
        got = tensors.read_tensors(spark, path, condition).collect()
        assert sorted((r.id, bytes(r.data)) for r in got) == sorted((i, want[i]) for i in ids), condition
    assert tensors.read_tensors(spark, path).where("id = 45").select("id").collect() == [(45,)]


def test_only_the_records_named_are_read(store):
    path, want = store

    def touched(*filters):
        reader = tensors.TensorReader(path)
        assert [f for f in reader.pushFilters(list(filters))] == [f for f in filters if isinstance(f, IsNotNull)]
        rows = [(i, bytes(d.as_py())) for p in reader.partitions() for b in reader.read(p) for i, d in zip(b.column(0).to_pylist(), b.column(1))]
        assert all(want[i] == d for i, d in rows)
        return len(rows), reader.read_bytes

    n, read = touched(GreaterThanOrEqual(("id",), 20_000), LessThan(("id",), 20_500), IsNotNull(("id",)))
    assert n == 100 and read < 100 * (32 + 16) + 4 * 2 * 16 * 16
    n, read = touched(EqualTo(("id",), 35_000))
    assert n == 1 and read < 32 + 16 + 2 * 16 * 16
    n, read = touched(In(("id",), (1, 2, 3)))
    assert n == 0 and read < 3 * 2 * 16 * 16
    n, read = touched()
    assert n == len(want) and read >= n * (32 + 16)


def test_a_failed_write_leaves_the_old_store(spark, store, tmp_path):
    path, want = f"{tmp_path}/s", None
    rows = spark.range(100).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("data"))
    tensors.write_tensors(rows, path, 16)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="16 bytes"):
        tensors.write_tensors(rows.withColumn("data", F.when(F.col("id") == 77, F.unhex(F.lit("00"))).otherwise(F.col("data"))), path, 16)
    assert sorted(os.listdir(path)) == before and tensors.read_tensors(spark, path).count() == 100
    writer = tensors.TensorWriter(path, 16, True)

    def halfway():
        yield next(iter(rows.limit(3).toArrow().to_batches()))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(halfway())
    done = writer.write(iter(rows.limit(3).toArrow().to_batches()))
    writer.abort([None, done])
    assert sorted(os.listdir(path)) == before
    tensors.write_tensors(rows.withColumn("id", F.col("id") + 50), path, 16, mode="append")  # ids may occur twice
    assert tensors.read_tensors(spark, path).count() == 200 and tensors.read_tensors(spark, path, "id = 60").count() == 2
    tensors.write_tensors(rows.limit(0), path, 16)
    assert tensors.read_tensors(spark, path).count() == 0 and os.listdir(path) == ["table.json"]


# ---- colour


def test_colour_conversion():
    rng = np.random.default_rng(3)
    planes = rng.integers(0, 256, (3, 20, 30), dtype=np.uint8)
    cut = lambda v: max(0, min(255, v // 256))
    for y, x in zip(rng.integers(0, 20, 60), rng.integers(0, 30, 60)):
        c, d, e = (int(planes[i, y, x]) - (16, 128, 128)[i] for i in range(3))
        assert to_bgr(planes)[y, x].tolist() == [cut(298 * c + 516 * d + 128), cut(298 * c - 100 * d - 208 * e + 128), cut(298 * c + 409 * e + 128)]
    bgr = rng.integers(0, 256, (40, 40, 3), dtype=np.uint8)
    assert np.abs(to_bgr(to_ycbcr(bgr)).astype(int) - bgr).max() <= 4
    for grey in (0, 90, 255):
        assert np.abs(to_bgr(to_ycbcr(np.full((1, 1, 3), grey, np.uint8))).astype(int) - grey).max() <= 1


@pytest.mark.parametrize("space, down, across", [("C420jpeg", 2, 2), ("C422", 1, 2), ("C444", 1, 1), ("Cmono", 0, 0)])
def test_chroma_holds_for_its_block(space, down, across):
    rng = np.random.default_rng(5)
    luma = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    small = rng.integers(0, 256, (2, -(-5 // down), -(-7 // across)), dtype=np.uint8) if down else None
    body = luma.tobytes() + (small.tobytes() if down else b"")
    frames = list(y4m_colour_frames(f"YUV4MPEG2 W7 H5 F25:1 {space}\n".encode() + (b"FRAME\n" + body) * 2 + b"FRAME\n" + body[:-1]))
    assert len(frames) == 2
    got = np.frombuffer(frames[1][2], np.uint8).reshape(5, 7, 3)
    for y in range(5):
        for x in range(7):
            one = [luma[y, x], *(small[:, y // down, x // across] if down else (128, 128))]
            assert got[y, x].tolist() == to_bgr(np.array(one, np.uint8).reshape(3, 1, 1))[0, 0].tolist()


@pytest.mark.parametrize("layout", T.LAYOUTS)
def test_colour_clips_as_model_input(layout):
    rng = np.random.default_rng(6)
    clips = [rng.integers(0, 256, (4, 3, 3, 3), dtype=np.uint8) for _ in range(5)]
    mean, std = (0.1, 0.2, 0.3), (0.5, 0.25, 2.0)
    how = {"seed": 3, "flip": 0.5, "brightness": (0.7, 1.3), "contrast": (0.5, 1.5)}
    for augment in (None, how):
        got = T.as_model_input([c.tobytes() for c in clips], 4, 3, layout, mean, std, augment, np.arange(5))
        for i, clip in enumerate(clips):
            x = clip.astype(np.float64) / 255
            if augment:
                a, b, c = np.random.default_rng([3, i]).random(3)
                x = (x[:, :, ::-1] if a < 0.5 else x) * (0.7 + 0.6 * b)
                x = np.clip((x - x.mean()) * (0.5 + c) + x.mean(), 0, 1)
            x = (x - mean) / std
            want = {"centre": x[1].transpose(2, 0, 1), "tchw": x.transpose(0, 3, 1, 2), "cthw": x.transpose(3, 0, 1, 2)}[layout]
            assert got[i].shape == want.shape and np.allclose(got[i], want, atol=1e-4)
