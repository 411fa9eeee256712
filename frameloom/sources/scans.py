"""Scans with declared schemas. Spark's readers do all reading, so any store they know will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameloom.functions.columns import file_stem, file_suffix
from frameloom.operators.governance import split_rows


def csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """A headered CSV whose header must be the schema's and whose rows must fit it."""
    return spark.read.schema(schema).options(header=True, sep=sep, mode="FAILFAST", enforceSchema=False).csv(path)


def commented_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV with blank lines and lines that begin with # after any blanks.

    The header of a file is its first line whose text is the first column's name followed by the separator,
    or alone; a later line like it is a row.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where((F.length(F.trim("value")) > 0) & ~F.ltrim("value").startswith("#"))
    if header:
        first = spark.createDataFrame([], schema).columns[0]
        like = lines.where(F.trim("value").startswith(first + sep) | (F.trim("value") == first))
        headers = like.groupBy("file").agg(F.min("place").alias("place"))
        lines = lines.join(headers, ["file", "place"], "left_anti")
    row = F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "FAILFAST"})
    return lines.select(row.alias("row")).select("row.*")


def partition_table(spark: SparkSession, path: str) -> DataFrame:
    """(video, split) from a commented, tab-separated list; splits in lower case."""
    rows = commented_csv(spark, path, "video string, split string", sep="\t")
    return rows.select(F.trim("video").alias("video"), F.lower(F.trim("split")).alias("split"))


# Names of the two kinds of label lines.
MULTIBOX, ONE_BOX = "multibox_per_line", "one_box_per_line"


def label_frames(spark: SparkSession, path: str, fields: int = 5, fmt: str = MULTIBOX) -> DataFrame:
    """(video, frame, n, values) of label files, with lines `frame n (x y w h class)*n` or `frame x y w h [class ...]`.

    Numbers may be written as decimals; frames and counts are cut off to whole ones. A line of the wrong length or
    without its numbers is an error that names its file and text. With several boxes a line, frames without boxes
    are kept and of a frame that is written twice the last line counts; with one box a line, a frame has as many
    boxes as lines, in their order, and a class or null.
    """
    if fmt not in (MULTIBOX, ONE_BOX):
        raise ValueError(f"unknown label format {fmt}")
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.length("value") > 0)
    rows = lines.withColumn("t", F.split("value", r"\s+"))
    number = lambda i: F.get("t", F.lit(i)).try_cast("double").try_cast("long")
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), "file", F.lit(": "), "value"))
    frame = F.coalesce(number(0), wrong("no frame number").cast("long"))
    if fmt == MULTIBOX:
        n = number(1)
        ok = F.coalesce(F.size("t") == 2 + fields * n, F.lit(False))
        out = rows.select(file_stem(F.col("file")).alias("video"), frame.alias("frame"), F.when(ok, n).otherwise(wrong("wrong number of fields").cast("long")).cast("int").alias("n"), "t", "line")
        last = Window.partitionBy("video", "frame").orderBy(F.desc("line"))
        out = out.withColumn("_rank", F.row_number().over(last)).where("_rank = 1")
        return out.select("video", "frame", "n", F.slice("t", 3, F.size("t")).alias("values"))
    box = F.when(F.size("t") >= fields, F.array(*(F.get("t", F.lit(i)) for i in range(1, fields + 1)))).otherwise(wrong("too few fields").cast("array<string>"))
    out = rows.select(file_stem(F.col("file")).alias("video"), frame.alias("frame"), F.struct("line", box.alias("box")).alias("b")).groupBy("video", "frame")
    boxes = F.array_sort(F.collect_list("b"))  # one frame's
    return out.agg(F.count("*").cast("int").alias("n"), F.flatten(F.transform(boxes, lambda b: b["box"])).alias("values"))


def boxes_of(frames: DataFrame, fields: int = 5) -> DataFrame:
    """(video, frame, idx, x, y, w, h, kind): a row per box, and one with nulls for a frame without."""
    at = lambda i, j: F.get("values", i * fields + j)
    box = lambda i: F.struct(*(at(i, j).cast("double").alias(c) for j, c in enumerate("xywh")), at(i, 4).alias("kind"))
    each = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), box))
    return frames.select("video", "frame", F.posexplode_outer(each).alias("idx", "b")).select("video", "frame", "idx", "b.*")


def box_counts(frames: DataFrame) -> DataFrame:
    """Per video: boxes, frames with a box, and frames without."""
    return frames.groupBy("video").agg(F.sum("n").alias("n_boxes"), F.count_distinct(F.when(F.col("n") > 0, F.col("frame"))).alias("annotated_frames"), F.count_if(F.col("n") == 0).alias("empty_frames"))


def json_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, with the file's stem."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("run", file_stem(F.col("_metadata.file_path")))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, suffix, bytes) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select("path", file_stem(F.col("path")).alias("stem"), file_suffix(F.col("path")).alias("suffix"), F.col("length").alias("bytes"))


def paired_stems(files: DataFrame, first: str, second: str) -> DataFrame:
    """Stems of two kinds of files with whether each kind is there."""
    a = files.where(F.col("suffix") == first).select("stem", F.lit(True).alias("has_first")).distinct()
    b = files.where(F.col("suffix") == second).select("stem", F.lit(True).alias("has_second")).distinct()
    return a.join(b, "stem", "full_outer").fillna(False)


def sniffed(spark: SparkSession, path: str, fields: int = 5) -> DataFrame:
    """(file, kind) by each file's first line: boxes, numbers, json, table, empty or text."""
    first = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), first_line(F.col("value")).alias("line"))
    return first.select(file_stem(F.col("file")).alias("file"), line_kind(F.col("line"), fields).alias("kind"))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def line_kind(line: Column, fields: int = 5) -> Column:
    """What a file's first line tells of it."""
    t = F.split(line, r"\s+")
    numbers = line.rlike(r"^[-+0-9.eE\s]+$")
    n = F.try_to_number(F.get(t, F.lit(1)), F.lit("999999"))
    boxes = F.coalesce(line.rlike(r"^\d+\s+\d+(\s|$)") & (F.size(t) == 2 + fields * n), F.lit(False))
    return F.when(F.length(line) == 0, "empty").when(boxes, "boxes").when(numbers, "numbers").when(line.rlike(r"^[\[{]"), "json").when(line.contains(","), "table").otherwise("text")


def proposals(spark: SparkSession, path: str, split: str, frames: DataFrame | None = None, allow_test: bool = False) -> DataFrame:
    """The proposals of one split behind the guard of `split_rows`, and only those of the (video, frame) rows given."""
    rows = split_rows(spark.read.parquet(path), [split], allow_test=allow_test)
    return rows if frames is None else rows.join(frames.select("video", "frame").distinct(), ["video", "frame"], "left_semi")
