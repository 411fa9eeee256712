"""Count-based rolling windows over frame streams.

Structured Streaming windows are cut by time; a window of T frames needs state. The buffer of a video
holds its last T - 1 frames: when frame i arrives, the window centred trail frames earlier is complete and
is emitted; windows at the two ends of a video never complete and emit nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "video string, centre long, first_frame long, last_frame long, total double"
STATE = "frames array<long>, items array<double>"
#: How long a video's buffer waits for its next frame.
IDLE_MS = 24 * 3600 * 1000


def completed(frames: list[int], items: list[float], length: int) -> tuple[list[tuple], list[int], list[float]]:
    """(windows completed, what stays in the buffer); a gap between frames empties the buffer."""
    trail = length - 1 - (length - 1) // 2
    out: list[tuple] = []
    buffer_f: list[int] = []
    buffer_v: list[float] = []
    for f, v in zip(frames, items):
        if buffer_f and f != buffer_f[-1] + 1:
            buffer_f, buffer_v = [], []
        buffer_f.append(f)
        buffer_v.append(v)
        if len(buffer_f) == length:
            out.append((f - trail, buffer_f[0], f, float(sum(buffer_v))))
            buffer_f, buffer_v = buffer_f[1:], buffer_v[1:]
    return out, buffer_f, buffer_v


def rolling_stream(stream: DataFrame, length: int, value: str = "value", idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Completed windows of a stream of (video, frame, value); frames of a video arrive in order across batches.

    A video without new frames for idle_ms loses its buffer, so state does not grow with the videos ever
    seen; a frame that comes later starts a new buffer, as after a gap. Such timeouts keep a query awake, so one
    that has to end by itself (trigger availableNow) takes None and keeps every buffer.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else ((), ())
        rows = pd.concat(list(pdfs)).sort_values("frame")
        out, frames, items = completed([*old[0], *rows["frame"].tolist()], [*old[1], *rows[value].tolist()], length)
        state.update((frames, items))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *w) for w in out], columns=["video", "centre", "first_frame", "last_frame", "total"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("video").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def full_batches(pdfs: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of exactly `size` rows, but for the last; the rest of one input goes before the next."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in pdfs:
        held.append(pdf)
        n += len(pdf)
        if n >= size:
            rows = pd.concat(held) if len(held) > 1 else held[0]
            whole = n - n % size
            for at in range(0, whole, size):
                yield rows.iloc[at : at + size]
            held, n = [rows.iloc[whole:]], n - whole
    if n:
        yield pd.concat(held)


def micro_batches(df: DataFrame, score, columns: list[str], schema: str, size: int = 256) -> DataFrame:
    """Apply a scorer to batches of `size` rows; it takes and gives a pandas frame.

    Only the last batch of a partition may be short, whatever the size of the Arrow batches that the rows come in.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in full_batches(pdfs, size):
            yield score(batch)

    return df.select(*columns).mapInPandas(run, schema)
