"""Queries over frames painted from rows of `events`, in one pass and as streams, and over pictures and files made from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions.columns import rational
from frameloom.plans.views import duck, view
from frameloom.session import scratch
from frameloom.sources import tensors, video
from frameloom.sources.painted import painted
from frameloom.sources.video_stream import VideoStream, write_videos
from frameloom.streaming import background, stateful, table_functions
from frameloom.streaming.mixture import MixtureModel, NeighbourModel
from frameloom.streaming.tubelets import clips_of, scored, wanted_by

HEIGHT, WIDTH = 32, 48
# blue, green and red by tint; the third one is as bright as the background and so is never foreground
BACK = (90, 90, 90)
SHADES = ((200, 40, 60), (30, 220, 200), (20, 20, 250))
#: Inclusive shares of a frame's area, of 1,536 pixels.
LOW, HIGH = 15 / 1536, 40 / 1536


def scene_frames(spark, d, colour: bool, in_order: bool = False, wanted=None):
    """A frame for each row of `scenes` and an empty frame 0 for each video; in_order and wanted as in `painted`."""
    shades = SHADES if colour else [(background.to_grey_value(s),) for s in SHADES]
    back = BACK if colour else (background.to_grey_value(BACK),)
    s = view(spark, d, "scenes")
    shade = F.element_at(F.array(*(F.array(*(F.lit(v) for v in c)) for c in shades)), (F.col("tint") + 1).cast("int"))
    rows = s.select("video", "frame", *(F.col(c).cast("int").alias(c) for c in "xywh"), shade.alias("shade"))
    empty = s.select("video").distinct().withColumn("frame", F.lit(0).cast("long"))
    return painted(rows.unionByName(empty, allowMissingColumns=True), HEIGHT, WIDTH, back, in_order, wanted)


def scene_clips(spark, d, colour: bool):
    """Complete eight-frame clips around the proposals, cut where the frames are painted."""
    wanted = wanted_by(scene_proposals(spark, d), 8)
    return clips_of(scene_frames(spark, d, colour, in_order=True, wanted=wanted), 8, 8, 0.5)


def scene_stream(spark, frames, batch: int):
    """The frames as a stream over video files, at most `batch` of each video at a time."""
    spark.dataSource.register(VideoStream)
    root = scratch(spark, "video-stream")
    write_videos(frames, f"{root}/files", in_order=True)
    return spark.readStream.format("video_stream").options(path=f"{root}/files", progress=f"{root}/progress", frames_per_batch=batch).load()


def scene_proposals(spark, d):
    """A box of 4 x 4 pixels at each object, numbered as its event."""
    s = view(spark, d, "scenes")
    return s.select(F.col("event_id").alias("proposal"), "video", F.col("frame").alias("centre"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(4.0).alias("w"), F.lit(4.0).alias("h"))


def foreground(spark, d):
    """ST-1, K-2, K-3, K-4, SNK-2: components of colour frames with one object each, within an area band."""
    return background.foreground(scene_frames(spark, d, colour=True, in_order=True), low=LOW, high=HIGH, in_order=True)


def model_components(spark, d):
    """K-1: the same components by a mixture of Gaussians that learns slowly, and by a model of neighbours over a long history."""
    models = {"mixture": lambda: MixtureModel(rate=0.005), "neighbours": lambda: NeighbourModel(history=1_000_000)}
    found = [background.foreground(scene_frames(spark, d, colour=True, in_order=True), low=LOW, high=HIGH, model_of=of, in_order=True).withColumn("model", F.lit(name)) for name, of in models.items()]
    return found[0].unionByName(found[1])


def frame_components(spark, d):
    """K-2, K-4: the same components by a table function of SQL over a table of frames."""
    table_functions.register(spark, low=LOW, high=HIGH)
    return spark.sql("SELECT * FROM frame_components(TABLE({frames}) PARTITION BY video ORDER BY frame)", frames=scene_frames(spark, d, colour=True))


def foreground_stream(spark, d):
    """ST-1, SRC-16: the same components from a stream over video files, the model kept as state between micro-batches."""
    stream = scene_stream(spark, scene_frames(spark, d, colour=False, in_order=True), 60)
    return stateful.drained(stateful.foreground_stream(stream, low=LOW, high=HIGH, idle_ms=None), "foreground")


def clip_bytes(clips):
    return clips.select("proposal", "video", "centre", "n", F.round("synthetic", 6).alias("synthetic"), F.md5(F.hex("clip")).alias("clip_md5"))


def tubelets(spark, d):
    """K-8, K-6: complete eight-frame clips in colour around proposals, the border repeated outside; others are left out."""
    return clip_bytes(scene_clips(spark, d, colour=True))


def clip_stream(spark, d):
    """ST-2: clips around proposals from a stream of frames, each video's last seven kept as state."""
    stream = scene_stream(spark, scene_frames(spark, d, colour=False, in_order=True), 60)
    clips = stateful.clip_stream(scene_proposals(spark, d), stream, 8, 8, 0.5, idle_ms=None)
    return clip_bytes(stateful.drained(clips, "clips"))


def scored_clips(spark, d):
    """ST-3, K-9: full batches of clips, normalised by channel, whatever the size of the Arrow batches they come in."""
    clips = scene_clips(spark, d, colour=True)
    mean, std = (90 / 255, 90 / 255, 90 / 255), (1 / 255, 2 / 255, 4 / 255)
    rows = scored(clips, lambda x: x.sum(axis=(1, 2, 3, 4), dtype=float), 8, 8, "tchw", 96, mean, std)
    return rows.select("proposal", F.round(F.col("score") * 4).cast("long").alias("quarters"))


def decoded_videos(spark, d):
    """SRC-14, SRC-15, SRC-16, ST-5: video files found by base name, their decoded frames against what the container says."""
    root = f"{scratch(spark, 'videos')}/data"
    write_videos(scene_frames(spark, d, colour=True, in_order=True), f"{root}/videos", in_order=True, packed=True)
    names = view(spark, d, "scenes").select(F.concat(F.lit("cam/"), "video", F.lit(".y4m")).alias("video")).distinct()
    files = video.video_files(spark, root, names)
    counts = video.decoded_counts(files, video.y4m_colour_frames)
    whole = video.decoded(files, video.y4m_colour_frames).groupBy("video").agg(F.count("*").alias("frames"), F.sum((F.length("pixels") == 3 * HEIGHT * WIDTH).cast("int")).alias("whole"))
    out = counts.join(whole, "video").withColumn("fps", rational(F.col("rate")))
    return out.select("video", "decoded", "said", "frames", "whole", "height", "width", "fps")


def colour_pictures(spark, d):
    """SRC-16, K-3: files of 6 x 5 pictures with a chroma sample for every four pixels, one for each customer, decoded into blue, green and red."""
    # a plane repeats for keys that are equal modulo 256, so there are 256 of each kind
    plane = lambda down, right, n, w: "array(" + ", ".join("X'" + in_hex((v + down * (k // w) + right * (k % w)) % 256 for k in range(n)) + "'" for v in range(256)) + ")"
    luma, chroma = plane(7, 5, 30, 6), plane(11, 3, 9, 3)
    at = lambda planes, key: f"element_at({planes}, CAST(pmod({key}, 256) AS int) + 1)"
    picture = f"concat(X'4652414D450A', {at(luma, '3 * o_orderkey')}, {at(chroma, 'o_custkey')}, {at(chroma, '2 * o_orderkey')})"
    pictures = view(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", f"{picture} AS picture")
    each = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "picture"))), lambda p: F.hex(p["picture"]))  # a customer's orders
    body = F.unhex(F.concat(F.hex(F.lit("YUV4MPEG2 W6 H5 F30000:1001 Ip C420jpeg\n")), F.array_join(each, "")))
    files = pictures.groupBy(F.col("o_custkey").cast("string").alias("video")).agg(body.alias("content"))
    return video.decoded(files, video.y4m_colour_frames).select("video", "frame", F.md5(F.hex("pixels")).alias("pixels_md5"))


def tensor_store(spark, d):
    """SRC-18, SNK-7: clips written into a store of equally large records, all of them read, and ranges and lists of ids by their places."""
    path = scratch(spark, "tensors")
    tensors.write_tensors(scene_clips(spark, d, colour=False), path, 512, "proposal", "clip")
    every = tensors.read_tensors(spark, path).select("id", F.md5(F.hex("data")).alias("clip_md5"))
    some = tensors.read_tensors(spark, path, "id >= 100 AND id < 2000").unionByName(tensors.read_tensors(spark, path, "id IN (7, 8, 2500, -3)"))
    return every.join(some.select("id", F.md5(F.hex("data")).alias("again_md5")), "id", "left").withColumnRenamed("id", "proposal")


def clip_pixels(back: str, shades: list[str]) -> str:
    """SQL for one row per proposal, frame and pixel of its clip: the bytes in hex, and what the pixel holds."""
    shade = "CASE tint " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(shades)) + " END"
    return f"""{duck('scenes')}, last AS (SELECT video, max(frame) AS last FROM scenes GROUP BY video),
      p AS (SELECT event_id, scenes.video, frame AS centre, x - 2 AS x0, y - 2 AS y0 FROM scenes JOIN last USING (video) WHERE frame >= 3 AND frame + 4 <= last),
      px AS (SELECT q.event_id, ((f - centre + 3) * 8 + r) * 8 + c AS k, s.tint,
          s.x IS NOT NULL AND greatest(least(x0 + c, {WIDTH - 1}), 0) BETWEEN s.x AND s.x + s.w - 1 AND greatest(least(y0 + r, {HEIGHT - 1}), 0) BETWEEN s.y AND s.y + s.h - 1 AS hit
        FROM (SELECT p.*, unnest(range(centre - 3, centre + 5)) AS f FROM p) q LEFT JOIN scenes s ON s.video = q.video AND s.frame = f, range(8) cc(c), range(8) rr(r)),
      bytes AS (SELECT event_id, k, hit, tint, CASE WHEN hit THEN {shade} ELSE '{back}' END AS v FROM px)"""


def clips_sql(back: str, shades: list[str]) -> str:
    return f"""{clip_pixels(back, shades)}, m AS (SELECT event_id, md5(string_agg(v, '' ORDER BY k)) AS clip_md5 FROM bytes GROUP BY event_id)
      SELECT event_id AS proposal, video, centre, 8::BIGINT AS n, round(1 - (least(x0 + 8, {WIDTH}) - greatest(x0, 0)) * (least(y0 + 8, {HEIGHT}) - greatest(y0, 0)) / 64.0::DOUBLE, 6) AS synthetic, clip_md5 FROM p JOIN m USING (event_id)"""


def in_hex(values) -> str:
    return "".join(f"{v:02X}" for v in values)


FOREGROUND_SQL = f"{duck('scenes')} SELECT video, frame, x, y, w, h, w * h AS area FROM scenes WHERE tint <> 2 AND w * h BETWEEN 15 AND 40"
COLOUR_CLIPS = (in_hex(BACK), [in_hex(s) for s in SHADES])
GREY_CLIPS = (in_hex([background.to_grey_value(BACK)]), [in_hex([background.to_grey_value(s)]) for s in SHADES])
#: What a pixel of each tint adds to a clip's sum of normalised channels, in quarters.
ADDS = [sum(round((v - 90) * w) for v, w in zip(s, (4, 2, 1))) for s in SHADES]

QUERIES = {
    "foreground_components": (foreground, FOREGROUND_SQL),
    "model_components": (model_components, f"WITH f AS ({FOREGROUND_SQL}) SELECT f.*, model FROM f, (VALUES ('mixture'), ('neighbours')) m(model)"),
    "frame_components": (frame_components, FOREGROUND_SQL),
    "foreground_stream": (foreground_stream, FOREGROUND_SQL),
    "tubelets": (tubelets, clips_sql(*COLOUR_CLIPS)),
    "clip_stream": (clip_stream, clips_sql(*GREY_CLIPS)),
    "tensor_store": (tensor_store, f"""WITH c AS ({clips_sql(*GREY_CLIPS)}) SELECT proposal, clip_md5, CASE WHEN proposal BETWEEN 100 AND 1999 OR proposal IN (7, 8, 2500) THEN clip_md5 END AS again_md5 FROM c"""),
    "decoded_videos": (decoded_videos, f"""{duck('scenes')} SELECT 'cam/' || video || '.y4m' AS video, count(*) + 1 AS decoded, count(*) + 1 AS said, count(*) + 1 AS frames, count(*) + 1 AS whole, {HEIGHT} AS height, {WIDTH} AS width, 25.0::DOUBLE AS fps FROM scenes GROUP BY video"""),
    "colour_pictures": (colour_pictures, """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame FROM orders),
      c AS (SELECT o_custkey, frame, r, c, 298 * ((3 * o_orderkey + 7 * r + 5 * c) % 256 - 16) AS y, (o_custkey + 11 * (r // 2) + 3 * (c // 2)) % 256 - 128 AS u, (2 * o_orderkey + 11 * (r // 2) + 3 * (c // 2)) % 256 - 128 AS v FROM o, range(5) rr(r), range(6) cc(c)),
      p AS (SELECT o_custkey, frame, r, c, [CAST(greatest(0, least(255, floor((s + 128) / 256.0))) AS int) FOR s IN [y + 516 * u, y - 100 * u - 208 * v, y + 409 * v]] AS bgr FROM c)
      SELECT CAST(o_custkey AS varchar) AS video, frame, md5(string_agg(printf('%02X%02X%02X', bgr[1], bgr[2], bgr[3]), '' ORDER BY r, c)) AS pixels_md5 FROM p GROUP BY o_custkey, frame"""),
    "scored_clips": (scored_clips, f"""{clip_pixels(*COLOUR_CLIPS)} SELECT event_id AS proposal, CAST(sum(CASE WHEN hit THEN CASE tint WHEN 0 THEN {ADDS[0]} WHEN 1 THEN {ADDS[1]} ELSE {ADDS[2]} END ELSE 0 END) AS bigint) AS quarters FROM bytes GROUP BY event_id"""),
}
