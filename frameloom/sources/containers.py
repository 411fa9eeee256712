"""What video containers say of themselves, without a codec: ISO base media files, AVI and YUV4MPEG2.

Only heads and indexes are read. A file is opened by Arrow's file systems and walked box by box: of each box the
8 or 16 bytes that name it and give its size; the media data between is stepped over, wherever the index stands.
Probes take a path and give a dict of rate (`30000/1001`, reduced), frames, height, width, duration in seconds and
time of creation; a damaged file raises, which `probes.probed` turns into a row with its error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from math import gcd
from typing import NamedTuple

from frameloom.sources.video import y4m_header
from frameloom.sources.video_stream import HEAD_BYTES, MARK, store_of

# Fixed value: times in ISO base media files count seconds from here.
EPOCH_1904 = datetime(1904, 1, 1, tzinfo=timezone.utc)
#: An index larger than this is taken for damage rather than read.
MOST_BYTES = 1 << 30


class Opened:
    """A file with random access that counts the bytes it has read."""

    def __init__(self, path: str):
        fs, inner = store_of(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.read_bytes = 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size or n > MOST_BYTES:
            raise ValueError(f"the file ends before byte {at + n}")
        self.file.seek(at)
        self.read_bytes += n
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


class Box(NamedTuple):
    kind: bytes
    start: int
    stop: int


def reduced(numerator: int, denominator: int) -> str:
    """A rate as the smallest whole numbers, or 0/0 if there is none."""
    if numerator <= 0 or denominator <= 0:
        return "0/0"
    d = gcd(numerator, denominator)
    return f"{numerator // d}/{denominator // d}"


# ---- ISO base media: boxes of a big-endian size, a name and a body


def boxes(f: Opened, start: int, stop: int) -> Iterator[Box]:
    """The boxes between two places of a file; their bodies are not read."""
    while start < stop:
        size, kind = struct.unpack(">I4s", f.read(start, 8))
        body = start + 8
        if size == 1:
            size, body = struct.unpack(">Q", f.read(body, 8))[0], body + 8
        end = stop if size == 0 else start + size
        if end > stop or end < body:
            raise ValueError(f"box {kind!r} at {start} ends outside what holds it")
        yield Box(kind, body, end)
        start = end


def inside(f: Opened, box: Box, *path: bytes) -> Box | None:
    """The first box found by going down a path of names."""
    for kind in path:
        box = next((b for b in boxes(f, box.start, box.stop) if b.kind == kind), None)
        if box is None:
            return None
    return box


def needed(box: Box | None, name: str) -> Box:
    if box is None:
        raise ValueError(f"no {name} box")
    return box


def whole(f: Opened, box: Box) -> bytes:
    return f.read(box.start, box.stop - box.start)


def created_at(seconds: int) -> datetime | None:
    """Null for files that do not say, and for times that no calendar holds."""
    try:
        return EPOCH_1904 + timedelta(seconds=seconds) if seconds else None
    except OverflowError:
        return None


def iso_probe(f: Opened) -> dict:
    """The first video track. Its frames are the sizes in its index, its rate their number over the time they take."""
    movie = needed(next((b for b in boxes(f, 0, f.size) if b.kind == b"moov"), None), "moov")
    for track in (b for b in boxes(f, movie.start, movie.stop) if b.kind == b"trak"):
        handler = inside(f, track, b"mdia", b"hdlr")
        if handler is None or whole(f, handler)[8:12] != b"vide":
            continue
        head = whole(f, needed(inside(f, track, b"tkhd"), "tkhd"))
        width, height = (v >> 16 for v in struct.unpack(">II", head[-8:]))
        media = whole(f, needed(inside(f, track, b"mdia", b"mdhd"), "mdhd"))
        created, _, scale, length = struct.unpack(">QQIQ" if media[0] == 1 else ">IIII", media[4 : 4 + (28 if media[0] == 1 else 16)])
        table = needed(inside(f, track, b"mdia", b"minf", b"stbl"), "stbl")
        times = whole(f, needed(inside(f, table, b"stts"), "stts"))
        runs = list(struct.iter_unpack(">II", times[8 : 8 + 8 * struct.unpack(">I", times[4:8])[0]]))
        sizes = needed(inside(f, table, b"stsz"), "stsz")
        frames = struct.unpack(">I", f.read(sizes.start + 8, 4))[0]  # the sizes themselves are not read
        if frames != sum(n for n, _ in runs):
            raise ValueError(f"{frames} sizes but {sum(n for n, _ in runs)} times")
        ticks = sum(n * d for n, d in runs)
        return {"rate": reduced(frames * scale, ticks), "frames": frames, "height": height, "width": width, "duration": length / scale if scale else None, "created": created_at(created)}
    raise ValueError("no video track")


# ---- AVI: chunks of a name and a little-endian size, padded to even places


def chunks(f: Opened, start: int, stop: int) -> Iterator[Box]:
    """The chunks between two places; a list's name is that of what it holds, and its body follows that name."""
    while start + 8 <= stop:
        kind, size = struct.unpack("<4sI", f.read(start, 8))
        if start + 8 + size > stop:
            raise ValueError(f"chunk {kind!r} at {start} ends outside what holds it")
        if kind in (b"LIST", b"RIFF"):
            yield Box(f.read(start + 8, 4), start + 12, start + 8 + size)
        else:
            yield Box(kind, start + 8, start + 8 + size)
        start += 8 + size + size % 2


def avi_probe(f: Opened) -> dict:
    """The first video stream; frames by the long index's head where there is one, for files of over a GB."""
    riff = next(chunks(f, 0, f.size))
    head = next((c for c in chunks(f, riff.start, riff.stop) if c.kind == b"hdrl"), None)
    if head is None:
        raise ValueError("no header list")
    found, frames, created = None, None, None
    for c in chunks(f, head.start, head.stop):
        if c.kind == b"strl" and found is None:
            parts = {p.kind: p for p in chunks(f, c.start, c.stop)}
            about = whole(f, parts[b"strh"])
            if about[:4] == b"vids":
                scale, rate, _, length = struct.unpack("<4I", about[20:36])
                width, height = struct.unpack("<ii", f.read(parts[b"strf"].start + 4, 8))
                found = (scale, rate, length, width, abs(height))  # a negative height means rows from the top
        elif c.kind == b"odml":
            long = next((p for p in chunks(f, c.start, c.stop) if p.kind == b"dmlh"), None)
            frames = struct.unpack("<I", f.read(long.start, 4))[0] if long else None
        elif c.kind == b"IDIT":
            said = whole(f, c).rstrip(b"\0\n ").decode("ascii", "replace")
            try:
                created = datetime.strptime(said, "%a %b %d %H:%M:%S %Y").replace(tzinfo=timezone.utc)
            except ValueError:
                created = None
    if found is None:
        raise ValueError("no video stream")
    scale, rate, length, width, height = found
    frames = frames or length
    return {"rate": reduced(rate, scale), "frames": frames, "height": height, "width": width, "duration": frames * scale / rate if rate else None, "created": created}


def y4m_probe(f: Opened) -> dict:
    """The number of frames follows from the file's size."""
    head = y4m_header(f.read(0, min(HEAD_BYTES, f.size)))
    each = len(MARK) + head["width"] * head["height"] + head["chroma"]
    frames = (f.size - head["first"]) // each
    n, d = (int(x) for x in head["rate"].split("/"))
    return {"rate": reduced(n, d), "frames": frames, "height": head["height"], "width": head["width"], "duration": frames * d / n if n > 0 else None, "created": None}


def container_probe(path: str) -> dict:
    """What the container at a path says, whichever of the three it is."""
    f = Opened(path)
    try:
        head = f.read(0, min(12, f.size))
        if head.startswith(b"RIFF") and head[8:] == b"AVI ":
            return avi_probe(f)
        if head.startswith(b"YUV4MPEG2"):
            return y4m_probe(f)
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
            return iso_probe(f)
        raise ValueError("no container that is known")
    finally:
        f.close()
