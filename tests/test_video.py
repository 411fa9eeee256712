from __future__ import annotations

import numpy as np
import pytest

from frameloom.operators.observed import Throughput
from frameloom.sources import probes
from frameloom.sources.frames import FrameSource, moving_square
from frameloom.streaming import tubelets as T
from frameloom.streaming.background import components
from frameloom.streaming.mixture import MixtureModel, NeighbourModel


@pytest.fixture(scope="module")
def frames(spark):
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").options(videos=2, frames=12).load()


def test_tubelets(spark, frames):
    rows = [(1, "v0", 5, 2.0, 20.0, 8.0, 8.0), (2, "v0", 1, 2.0, 20.0, 8.0, 8.0), (3, "v1", 8, 60.0, 20.0, 8.0, 8.0), (4, "v1", 7, -90.0, 0.0, 4.0, 4.0)]
    proposals = spark.createDataFrame(rows, "proposal long, video string, centre long, x double, y double, w double, h double")
    clips = T.assembled(proposals, frames, 8, 6, 0.5)
    got = {r.proposal: r for r in clips.collect()}
    assert set(got) == {1, 4} and {r.proposal for r in T.dropped(proposals, clips).collect()} == {2, 3}
    assert len(got[1].clip) == 8 * 36 and got[1].synthetic > 0 and got[4].synthetic == 1.0
    assert T.wanted_frames(frames, proposals.where("proposal = 1"), 8).count() == 8
    for layout in T.LAYOUTS:
        scores = T.scored(clips, lambda x: x.reshape(len(x), -1).mean(axis=1), 8, 6, layout, batch=1).collect()
        assert {r.proposal for r in scores} == {1, 4} and all(0 <= r.score <= 1 for r in scores)


@pytest.mark.parametrize("make", [lambda: MixtureModel(history=60), lambda: NeighbourModel(history=60)])
def test_models_find_the_square(make):
    model = make()
    masks = [model.apply(f) for f in moving_square(3, 40)]
    assert not masks[0].any()
    found = [c for c in components(masks[-1]) if c[4] >= 20]
    assert found and any(abs(c[0] - 39) <= 10 for c in found)


def plain_mixture(values, history, rate, parts=4, match=16.0, share=0.9, start=15.0, floor=4.0):
    """Whether each value of one pixel is foreground, by the recursion written out for a single pixel."""
    gaussians, out = [], []
    for t, x in enumerate(values, 1):
        if t == 1:
            gaussians = [[1.0, float(x), start]] + [[0.0, 0.0, start] for _ in range(parts - 1)]
        a = rate if rate is not None else 1 / min(2 * t, history)
        fitting = [i for i, (w, m, v) in enumerate(gaussians) if w > 0 and (x - m) ** 2 < match * v]
        covered, background = 0.0, set()
        for i in sorted(range(parts), key=lambda i: -gaussians[i][0]):
            if covered < share:
                background.add(i)
            covered += gaussians[i][0]
        out.append(not background & set(fitting))
        best = max(fitting, key=lambda i: (gaussians[i][0], -i)) if fitting else None
        for i, g in enumerate(gaussians):
            g[0] += a * ((i == best) - g[0])
        if best is None:
            gaussians[min(range(parts), key=lambda i: (gaussians[i][0], i))] = [a, float(x), start]
        else:
            w, m, v = gaussians[best]
            k = a / max(w, a)
            gaussians[best] = [w, m + k * (x - m), max(floor, v + k * ((x - m) ** 2 - v))]
        total = sum(g[0] for g in gaussians)
        for g in gaussians:
            g[0] /= total
    return out


def plain_neighbours(values, history, samples=7, distance=20, least=2):
    ring, out, every = [values[0]] * samples, [], max(1, history // samples)
    for t, x in enumerate(values):
        out.append(sum(abs(int(r) - int(x)) < distance for r in ring) < least)
        if t % every == 0:
            ring[t // every % samples] = x
    return out


@pytest.mark.parametrize("history,rate", [(500, None), (6, None), (500, 0.05)])
def test_models_against_single_pixels(history, rate):
    rng = np.random.default_rng(11)
    modes = rng.choice([20, 24, 60, 90, 130, 180, 250], (120, 5, 7), p=[0.1, 0.1, 0.2, 0.35, 0.1, 0.1, 0.05])
    frames = np.clip(modes + rng.integers(-5, 6, modes.shape), 0, 255).astype(np.uint8)
    mixture, neighbours = MixtureModel(history, rate=rate), NeighbourModel(history)
    got = [np.array([m.apply(f) for f in frames]) > 0 for m in (mixture, neighbours)]
    assert all(0.05 < g.mean() < 0.95 for g in got[:1])
    for y in range(5):
        for x in range(7):
            assert got[0][:, y, x].tolist() == plain_mixture(frames[:, y, x].astype(float).tolist(), history, rate)
            assert got[1][:, y, x].tolist() == plain_neighbours(frames[:, y, x].tolist(), history)


def test_mixture_learns_only_at_its_rate():
    still = list(moving_square(3, 60, still=True))
    empty = np.full_like(still[0], 90)

    def last(rate):
        model = MixtureModel(history=20)
        for _ in range(20):
            model.apply(empty, rate)
        return [model.apply(f, rate)[20:28, 0:8].mean() for f in still][-1]

    assert last(None) < 50 < last(0.0)


def test_probes(spark):
    files = spark.createDataFrame([("a.mp4",), ("b.mp4",)], "path string")

    def one(path):
        if path.startswith("b"):
            raise OSError("no codec")
        return {"rate": "30000/1001", "frames": 300, "height": 4, "width": 6, "duration": 10.0}

    a = probes.probed(files, one)
    assert {r.path: r.error for r in a.collect()} == {"a.mp4": None, "b.mp4": "OSError: no codec"}
    b = probes.probed(files, lambda p: {"rate": "25/1", "frames": 250})
    got = {r.path: (r.frames, r.disagree) for r in probes.inventory(a, b).collect()}
    assert got == {"a.mp4": (300, True), "b.mp4": (250, False)}


def test_throughput(spark):
    t = Throughput()
    t.watch(spark.range(50)).write.format("noop").mode("overwrite").save()
    assert t.rates()["frames"] == 50
