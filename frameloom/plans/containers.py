"""Queries over container files that are put together byte by byte from rows of `orders`."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from frameloom.plans.views import view
from frameloom.session import scratch
from frameloom.sources import probes
from frameloom.sources.containers import container_probe
from frameloom.sources.video_stream import store_of


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def iso_file(width: int, height: int, scale: int, runs: list[tuple[int, int]], created: int, media: int, index_first: bool = True, wide: bool = False) -> bytes:
    """A movie with a sound and a video track; runs are (frames, ticks each), media the bytes between that nobody needs."""
    n, ticks = sum(r[0] for r in runs), sum(a * b for a, b in runs)
    times = struct.pack(">II", 0, len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    sizes = struct.pack(">III", 0, 0, n) + b"\0\0\0\1" * n
    head = struct.pack(">IQQIQ", 1 << 24, created, created, scale, ticks) if wide else struct.pack(">IIIII", 0, created, created, scale, ticks)
    handler = lambda kind: box(b"hdlr", bytes(8), kind, bytes(13))
    track = lambda kind, table, size: box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", *size)), box(b"mdia", box(b"mdhd", head, bytes(4)), handler(kind), box(b"minf", box(b"stbl", *table))))
    sound = track(b"soun", [box(b"stts", struct.pack(">II", 0, 0))], (0, 0))
    moving = track(b"vide", [box(b"stts", times), box(b"stsz", sizes)], (width << 16, height << 16))
    index = box(b"moov", box(b"mvhd", bytes(100)), sound, moving)
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + media) + bytes(media)
    return box(b"ftyp", b"isom", bytes(4)) + (index + data if index_first else data + index)


def chunk(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack("<4sI", kind, len(body)) + body + b"\0" * (len(body) % 2)


def avi_file(width: int, height: int, scale: int, rate: int, frames: int, created: str, media: int, long_frames: int | None = None) -> bytes:
    """Sound and video streams; a long file's head gives all its frames, its stream's head those of its first part."""
    stream = lambda kind, length, form: chunk(b"LIST", b"strl", chunk(b"strh", kind, bytes(16), struct.pack("<4I", scale, rate, 0, length), bytes(20)), chunk(b"strf", form))
    form = struct.pack("<Iii", 40, width, -height) + bytes(28)
    long = chunk(b"LIST", b"odml", chunk(b"dmlh", struct.pack("<I", long_frames))) if long_frames else b""
    head = chunk(b"LIST", b"hdrl", chunk(b"avih", bytes(56)), stream(b"auds", 9, bytes(18)), stream(b"vids", frames, form), long, chunk(b"IDIT", created.encode() + b"\n\0"))
    return chunk(b"RIFF", b"AVI ", head, chunk(b"LIST", b"movi", bytes(media)))


def containers(spark, d):
    """SRC-14, SRC-15: a movie for each month of orders as an ISO and as an AVI file, those of July damaged, which gives rows with an error.

    A movie has a run of frames for each status of the orders; the AVI files have their number as rate.
    """
    root = scratch(spark, "containers")
    day = F.to_date("o_orderdate")
    rows = view(spark, d, "orders").groupBy(F.trunc(day, "month").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))
    run = F.struct("o_orderstatus", "n")
    months = rows.groupBy("month").agg(F.array_sort(F.collect_list(run)).alias("runs"), F.sum("n").alias("n"))

    def build(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = store_of(root)
        fs.create_dir(inner, recursive=True)
        for pdf in pdfs:
            made = []
            for month, runs, n in zip(pdf["month"], pdf["runs"], pdf["n"]):
                at = datetime(month.year, month.month, 1, tzinfo=timezone.utc)
                frames = [(int(r["n"]), 1001 + ord(r["o_orderstatus"])) for r in runs]
                iso = iso_file(16 + month.month, 8 + month.month, 30_000, frames, int(at.timestamp()) + 2_082_844_800, 50 * int(n), month.month % 2 == 0, month.month % 3 == 0)
                avi = avi_file(32 + month.month, 24, 1001, int(n) * 100, int(n), f"{at:%a %b %d %H:%M:%S %Y}", 30 * int(n), 3 * int(n) if month.month % 4 == 0 else None)
                if month.month == 7:
                    iso, avi = iso[:-6], avi[:150]
                for end, body in (("mp4", iso), ("avi", avi)):
                    made.append(f"{month.year}-{month.month:02}.{end}")
                    part = f"{inner}/.{made[-1]}"
                    with fs.open_output_stream(part) as out:
                        out.write(body)
                    fs.move(part, f"{inner}/{made[-1]}")
            yield pd.DataFrame({"path": made})

    files = months.mapInPandas(build, "path string").select(F.concat(F.lit(f"{root}/"), "path").alias("path"))
    out = probes.probed(files, container_probe)
    second = F.unix_timestamp("created")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "rate", "frames", "height", "width", F.round("duration", 6).alias("duration"), second.alias("created"), F.col("error").isNotNull().alias("failed"))


QUERIES = {
    "containers": (containers, """WITH r AS (SELECT date_trunc('month', CAST(o_orderdate AS date)) AS m, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
      s AS (SELECT m, CAST(sum(n) AS bigint) AS n, CAST(sum(n * (1001 + ascii(o_orderstatus))) AS bigint) AS ticks, month(m) AS k, strftime(m, '%Y-%m') AS name, CAST(epoch(m) AS bigint) AS made FROM r GROUP BY m),
      f AS (SELECT name || '.mp4' AS file, k = 7 AS failed, n * 30000 AS a, ticks AS b, n AS frames, 8 + k AS height, 16 + k AS width, ticks / 30000.0::DOUBLE AS duration, made FROM s
        UNION ALL SELECT name || '.avi', k = 7, n * 100, 1001, CASE WHEN k % 4 = 0 THEN 3 * n ELSE n END, 24, 32 + k, CASE WHEN k % 4 = 0 THEN 3 * n ELSE n END * 1001 / (n * 100.0::DOUBLE), made FROM s)
      SELECT file, CASE WHEN NOT failed THEN (a // gcd(a, b)) || '/' || (b // gcd(a, b)) END AS rate, CASE WHEN NOT failed THEN frames END AS frames, CASE WHEN NOT failed THEN CAST(height AS int) END AS height,
        CASE WHEN NOT failed THEN CAST(width AS int) END AS width, CASE WHEN NOT failed THEN round(duration, 6) END AS duration, CASE WHEN NOT failed THEN made END AS created, failed FROM f"""),
}
