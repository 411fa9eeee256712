from __future__ import annotations

import json

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from frameloom.operators import sinks
from frameloom.sources import config, scans
from frameloom.sources.frames import FrameSource, moving_square
from frameloom.streaming import background as B
from frameloom.streaming.windows import completed, micro_batches


def test_config(tmp_path):
    (tmp_path / "configs").mkdir()
    path = tmp_path / "configs" / "c.yaml"
    path.write_text("data_root: ~/x\nruled:\n  window: {T: 8, pad: null}\n  rule: greedy\n")
    c = config.load_config(path)
    assert config.ruled(c, "window.T") == 8 and config.ruled(c, "window.pad", allow_null=True) is None
    with pytest.raises(config.RuledValueMissing, match="a.*b"):
        config.require_all(c, ["rule", "a", "b"])
    assert "~" not in str(config.data_root(c)) and config.beside_config(c, "y") == tmp_path / "y"
    with pytest.raises(ValueError):
        config.data_root({"data_root": " "})
    assert config.contradictions(c, [("window", "rule")], {"rule": ["optimal"]}) and not config.contradictions(c, [("rule", "none")], {"rule": ["greedy"]})


def test_commented_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# x\nvideo,n\n  # indented\n\nv1,3\nv2,4\n")
    assert sorted(tuple(r) for r in scans.commented_csv(spark, str(tmp_path / "a.csv"), "video string, n int").collect()) == [("v1", 3), ("v2", 4)]
    (tmp_path / "p.tsv").write_text("#c\nvideo\tsplit\nv1\t Train\n")
    assert [tuple(r) for r in scans.partition_table(spark, str(tmp_path / "p.tsv")).collect()] == [("v1", "train")]


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("video,n\nv1,x\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        scans.csv(spark, str(tmp_path / "a.csv"), "video string, n int").collect()


def test_label_text(spark, tmp_path):
    (tmp_path / "v1.txt").write_text("0 0\n1 2 1 2 3 4 bird 5 6 7 8 drone\n2 1 9 9 9 9 bird\n2 1 1 1 1 1 drone\n")
    frames = scans.label_frames(spark, str(tmp_path / "v1.txt"))
    boxes = scans.boxes_of(frames).collect()
    assert {(r.frame, r.idx, r.x, r.kind) for r in boxes} == {(0, None, None, None), (1, 0, 1.0, "bird"), (1, 1, 5.0, "drone"), (2, 0, 1.0, "drone")}
    assert tuple(scans.box_counts(frames).first()) == ("v1", 3, 2, 1)
    (tmp_path / "bad.txt").write_text("1 2 1 2 3\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="bad.txt"):
        scans.label_frames(spark, str(tmp_path / "bad.txt")).collect()


def test_listing_and_sniffing(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.mp4").write_text("x")
    (tmp_path / "in" / "sub" / "a.txt").write_text("3 1 1 2 3 4 bird\n")
    (tmp_path / "in" / "sub" / "b.txt").write_text('{"k": 1}\n')
    files = scans.listing(spark, str(tmp_path / "in"))
    assert {(r.stem, r.has_first, r.has_second) for r in scans.paired_stems(files, ".mp4", ".txt").collect()} == {("a", True, True), ("b", False, True)}
    assert {(r.file, r.kind) for r in scans.sniffed(spark, str(tmp_path / "in" / "sub")).collect()} == {("a", "boxes"), ("b", "json")}


def test_json_runs_and_records(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps({"arm": "a", "ap": 0.5}, indent=1))
    assert [tuple(r) for r in scans.json_runs(spark, str(tmp_path / "s1.json"), "arm string, ap double").collect()] == [("a", 0.5, "s1")]
    from pyspark.sql import functions as F

    row = sinks.run_record(spark.range(3), {"seed": "1"}, {"n": F.count("*")}).first()["record"]
    assert json.loads(row) == {"parameters": {"seed": "1"}, "counts": {"n": 3}}


def test_access_log_and_export(spark, tmp_path):
    for _ in range(2):
        sinks.log_access(spark, str(tmp_path / "log"), "me", "draw", ["val"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.export_csv(spark.range(3).selectExpr("id", "id * 2 AS extra"), str(tmp_path / "csv"), ["id"], ["id"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id"]


def test_background_model():
    run = lambda seed: [B.SampleModel(seed)] and (lambda m: [m.apply(f) for f in moving_square(3, 12)])(B.SampleModel(seed))
    a, b, c = run(1), run(1), run(2)
    assert all((x == y).all() for x, y in zip(a, b)) and not a[0].any()
    assert max(np.mean(x != y) for x, y in zip(a, c)) < 0.05
    found = [p for p in B.components(a[-1]) if p[4] >= 30]
    assert any(p[0] <= 11 <= p[0] + p[2] for p in found)


def test_components():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]])
    assert B.components(mask) == [(0, 0, 2, 2, 2), (3, 0, 1, 2, 2), (0, 3, 2, 1, 2), (3, 3, 1, 1, 1)]
    assert B.components(np.zeros((3, 3))) == []


def test_crop():
    image = np.arange(16, dtype=np.uint8).reshape(4, 4) * 10
    full, share = B.crop(image, 2, 2, 4, 4)
    assert (full == image).all() and share == 0
    assert B.crop(image, -50, 2, 4, 4)[1] == 1.0 and (B.crop(image, -50, 2, 4, 4)[0] == image[2, 0]).all()
    assert B.crop(image, 0, 2, 4, 4, replicate=False)[0][:, 0].sum() == 0
    left, share = B.square(image, 0, 2, 4)
    assert share == 0.5 and left.tolist() == [[r[0], r[0], r[0], r[1]] for r in image.tolist()]


def test_resizing():
    image = np.array([[0, 0, 90, 90], [0, 0, 90, 90], [10, 20, 30, 40], [50, 60, 70, 81]], np.uint8)
    assert B.resized(image, 2, "area").tolist() == [[0, 90], [35, 55]]
    assert B.resized(image, 3, "area")[0].tolist() == [0, 45, 90]  # a pixel of 4/3 width: a third of it and one whole, halved between
    assert B.resized(image[:2, :2] + np.array([[0, 100], [0, 100]], np.uint8), 4).tolist() == [[0, 25, 75, 100]] * 4
    colour = np.stack([image] * 3, axis=2)
    assert (B.resized(colour, 2, "area")[..., 1] == B.resized(image, 2, "area")).all() and (B.resized(image, 4) == image).all()
    assert (B.area_weights(7, 3).sum(axis=1) == pytest.approx(1)) and (B.linear_weights(7, 3).sum(axis=1) == pytest.approx(1))


def test_grey_values():
    rng = np.random.default_rng(2)
    bgr = rng.integers(0, 256, (40, 40, 3), dtype=np.uint8)
    one = lambda p: int(np.float32(np.float32(np.float32(0.114) * np.float32(p[0])) + np.float32(np.float32(0.587) * np.float32(p[1]))) + np.float32(np.float32(0.299) * np.float32(p[2])))
    assert B.to_grey(bgr).tolist() == [[one(p) for p in row] for row in bgr.tolist()]
    pure = np.repeat(np.arange(256, dtype=np.uint8)[:, None, None], 3, axis=2)
    assert B.to_grey(pure)[:, 0].tolist() == [one((v, v, v)) for v in range(256)]


def test_samples_start_from_neighbours():
    grey = np.arange(30, dtype=np.uint8).reshape(5, 6)
    model = B.SampleModel(3, n=200)
    model.start(grey)
    for y in range(5):
        for x in range(6):
            around = {int(grey[(y + dy) % 5, (x + dx) % 6]) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
            assert set(model.samples[:, y, x].tolist()) == around
    steps = {int(model.samples[0, y, x]) - int(grey[y, x]) for y in range(1, 4) for x in range(1, 5)}
    assert len(steps) > 2  # every pixel has its own draw


def test_updates_stay_inside_and_never_hit_the_pixel_itself():
    model = B.SampleModel(1, n=4, phi=1)
    model.samples = np.zeros((4, 3, 3), np.uint8)
    only = np.zeros((3, 3), bool)
    only[0, 0] = True
    for _ in range(200):
        model.replace(np.full((3, 3), 9, np.uint8), only, neighbours=True)
    touched = set(zip(*(c.tolist() for c in np.nonzero(model.samples.any(axis=0)))))
    assert touched == {(0, 1), (1, 0), (1, 1)}
    model.replace(np.full((3, 3), 9, np.uint8), only, neighbours=False)
    assert model.samples[:, 0, 0].any()


def test_a_second_seed_differs_slightly():
    rng = np.random.default_rng(0)
    scene = rng.integers(70, 120, (60, 60), dtype=np.uint8)
    frames = []
    for i in range(30):
        f = scene.copy()
        f[25:35, i : i + 10] = 240
        frames.append(f)
    a, b, c = ([m.apply(f) for f in frames] for m in (B.SampleModel(0), B.SampleModel(0), B.SampleModel(1)))
    assert all((x == y).all() for x, y in zip(a, b)) and not a[0].any() and a[1].any()
    assert 0 < np.mean([(x != y).mean() for x, y in zip(a, c)]) < 0.05


def test_header_is_dropped_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\n\nkey,n\n1,2\nkey,3\n")
    (tmp_path / "b.csv").write_text("key,n\n  # x\n4,5\n")
    got = sorted((r.key, r.n) for r in scans.commented_csv(spark, str(tmp_path), "key string, n int").collect())
    assert got == [("1", 2), ("4", 5), ("key", 3)]


def y4m(frames, width, height, rate="25:1", colour="C420", chroma=None):
    chroma = 2 * ((width + 1) // 2) * ((height + 1) // 2) if chroma is None else chroma
    return f"YUV4MPEG2 W{width} H{height} F{rate} {colour}\n".encode() + b"".join(b"FRAME\n" + f.tobytes() + b"\x80" * chroma for f in frames)


def test_videos_decode(spark, tmp_path):
    from frameloom.sources import video as V

    frames = list(moving_square(5, 7, 11, 13, side=4))
    root = tmp_path / "data"
    (root / "videos").mkdir(parents=True)
    (root / "cam").mkdir()
    (root / "cam" / "a.y4m").write_bytes(y4m(frames, 13, 11))
    (root / "videos" / "b.y4m").write_bytes(y4m(frames[:3], 13, 11, colour="Cmono", chroma=0)[:-5])  # cut off
    (root / "videos" / "c.y4m").write_bytes(b"no video")
    wanted = spark.createDataFrame([("cam/a.y4m",), ("cam/b.y4m",), ("c.y4m",), ("lost.y4m",)], "video string")
    files = V.video_files(spark, str(root), wanted)
    assert {r.video: r.path is not None for r in files.collect()} == {"cam/a.y4m": True, "cam/b.y4m": True, "c.y4m": True, "lost.y4m": False}
    counts = V.decoded_counts(files)
    got = {r.video: r for r in counts.collect()}
    assert (got["cam/a.y4m"].decoded, got["cam/a.y4m"].said, got["cam/a.y4m"].rate) == (7, 7, "25/1")
    assert got["cam/b.y4m"].decoded == 2 and "ValueError" in got["c.y4m"].error and got["lost.y4m"].error
    assert {r.video for r in V.count_mismatches(counts).collect()} == {"c.y4m", "lost.y4m"}
    rows = V.decoded(files.where("video <> 'c.y4m'")).collect()
    assert len(rows) == 9 and all(np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width), frames[r.frame]) for r in rows)


def test_augmented_clips():
    from frameloom.streaming import tubelets as T

    rng = np.random.default_rng(4)
    clips = rng.random((5, 3, 4, 4)).astype(np.float32)
    keys = np.arange(5)
    how = {"seed": 1, "flip": 0.5, "brightness": (0.8, 1.2), "contrast": (0.8, 1.2)}
    a, b = T.augmented(clips, keys, **how), T.augmented(clips[::-1], keys[::-1], **how)[::-1]
    assert np.array_equal(a, b) and not np.array_equal(a, T.augmented(clips, keys, **(how | {"seed": 2})))
    flipped = T.augmented(clips, keys, 1, 1.0, (1, 1), (1, 1))
    assert flipped == pytest.approx(clips[..., ::-1], abs=1e-6) and a.min() >= 0 and a.max() <= 1



def test_frame_source(spark):
    spark.dataSource.register(FrameSource)
    df = spark.read.format("frames").options(videos=3, frames=5).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 15
    assert {r["n"] for r in df.groupBy("video").agg({"frame": "max"}).withColumnRenamed("max(frame)", "n").collect()} == {4}


def test_rolling_buffer():
    out, frames, _ = completed([0, 1, 2, 3, 5, 6], [1.0] * 6, 3)
    assert out == [(1, 0, 2, 3.0), (2, 1, 3, 3.0)] and frames == [5, 6]
    first, frames, items = completed([0, 1], [1.0, 1.0], 3)
    assert first == [] and completed(frames + [2], items + [1.0], 3)[0] == [(1, 0, 2, 3.0)]


def test_micro_batches(spark):
    sizes = micro_batches(spark.range(10).coalesce(1), lambda p: p.assign(n=len(p))[["id", "n"]], ["id"], "id long, n long", size=4)
    assert sorted({r.n for r in sizes.collect()}) == [2, 4]
