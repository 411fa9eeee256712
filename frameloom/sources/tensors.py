"""A store of equally large records with random access: format "tensors".

Records lie one after the other in the order of their ids, in one data file per writing task, with an index file of
(id, place) pairs of 16 bytes. A table of the data files, with the number of records and the ids they lie between, is
written last, so a store appears as a whole or not at all: each task writes under names of its own, and
what failed or repeated tasks leave is in no table. A reader takes the files whose ids can match, finds ids by
halving the index and reads the bytes of those records alone; neighbours are read together.

Conditions on `id` (equality, lists, bounds) are pushed to the reader where
`spark.sql.python.filterPushdown.enabled` is set; without it the result is the same and more is read. Paths are read
by Arrow's file systems. Ids are whole numbers without nulls; an id that occurs twice is two records.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from frameloom.sources.video_stream import store_of

SCHEMA = "id long, data binary"
TABLE = "table.json"
ENTRY = struct.Struct("<qq")
#: Bytes of records that one partition reads, and that one batch holds.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    name: str
    n: int
    least: int
    most: int


class Tensors(DataSource):
    """Options: path, and for writing stride, the bytes of a record."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        if [f.name for f in schema.fields] != ["id", "data"]:
            raise ValueError("a tensor store takes the columns id and data")
        return TensorWriter(self.options["path"], int(self.options["stride"]), overwrite)


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, stride: int, overwrite: bool):
        self.path, self.stride, self.overwrite = path, stride, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One data and one index file; the records of a task come in order of id."""
        fs, root = store_of(self.path)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        ids: list[np.ndarray] = []
        try:
            with fs.open_output_stream(f"{root}/{name}.data") as out:
                for batch in batches:
                    if batch.column(0).null_count or batch.column(1).null_count or not pc.all(pc.equal(pc.binary_length(batch.column(1)), self.stride)).as_py():
                        raise ValueError(f"every record has an id and {self.stride} bytes")
                    ids.append(batch.column(0).to_numpy())
                    out.write(b"".join(batch.column(1).to_pylist()))
            every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            if not len(every):
                fs.delete_file(f"{root}/{name}.data")
                return Written(name, 0, 0, 0)
            order = np.argsort(every, kind="stable")
            with fs.open_output_stream(f"{root}/{name}.index") as out:
                out.write(np.stack([every[order], order], axis=1).astype("<i8").tobytes())
        except BaseException:
            remove(fs, root, [name])
            raise
        return Written(name, len(every), int(every[order[0]]), int(every[order[-1]]))

    def commit(self, messages: list[Written | None]) -> None:
        """Put the table in place, which makes the store visible; an older store's files go after that."""
        fs, root = store_of(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if fs.get_file_info(f"{root}/{TABLE}").type == pafs.FileType.NotFound else json.loads(fs.open_input_stream(f"{root}/{TABLE}").read())["files"]
        new = [m.__dict__ for m in messages if m is not None and m.n]
        keep = [] if self.overwrite else old
        with fs.open_output_stream(f"{root}/.{TABLE}") as out:
            out.write(json.dumps({"stride": self.stride, "files": keep + new}).encode())
        fs.move(f"{root}/.{TABLE}", f"{root}/{TABLE}")
        if self.overwrite:
            remove(fs, root, [x["name"] for x in old])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store_of(self.path)
        remove(fs, root, [m.name for m in messages if m is not None])


def remove(fs: pafs.FileSystem, root: str, names: Iterable[str]) -> None:
    for name in names:
        for end in ("data", "index"):
            if fs.get_file_info(f"{root}/{name}.{end}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/{name}.{end}")


@dataclass
class Wanted:
    """Ids between two bounds, inclusive, and of a list if there is one."""

    least: int = -(1 << 63)
    most: int = (1 << 63) - 1
    among: tuple[int, ...] | None = None

    def narrowed(self, f: Filter) -> Wanted | None:
        """With one more condition, or None if it is none that the store knows."""
        if getattr(f, "attribute", None) != ("id",):
            return None
        values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
        values = tuple(v for v in values if v is not None or not isinstance(f, In))
        if not all(isinstance(v, int) for v in values):
            return None
        if isinstance(f, (EqualTo, In)):
            return Wanted(self.least, self.most, tuple(sorted(set(values) if self.among is None else set(values) & set(self.among))))
        least, most = self.least, self.most
        if isinstance(f, GreaterThan):
            least = max(least, values[0] + 1)
        elif isinstance(f, GreaterThanOrEqual):
            least = max(least, values[0])
        elif isinstance(f, LessThan):
            most = min(most, values[0] - 1)
        elif isinstance(f, LessThanOrEqual):
            most = min(most, values[0])
        else:
            return None
        return Wanted(least, most, self.among)

    def ranges(self, least: int, most: int) -> list[tuple[int, int]]:
        """Ranges of ids that can be in a file that lies between two ids."""
        a, b = max(self.least, least), min(self.most, most)
        if self.among is None:
            return [(a, b)] if a <= b else []
        return [(v, v) for v in self.among if a <= v <= b]


class Records(InputPartition):
    """Ranges of ids of one file of records of some bytes; the places of its index between which they are looked for."""

    def __init__(self, name: str, n: int, stride: int, ranges: list[tuple[int, int]], first: int, last: int):
        super().__init__((name, first))
        self.name, self.n, self.stride, self.ranges, self.first, self.last = name, n, stride, ranges, first, last


class Counted:
    """A file with random access that counts the bytes it has read."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.bytes = fs.open_input_file(path), 0

    def read(self, at: int, n: int) -> bytes:
        self.bytes += n
        self.file.seek(at)
        return self.file.read(n)


@dataclass
class Index:
    """The sorted ids of a file as a sequence that reads an entry when it is asked for one."""

    file: Counted
    n: int
    seen: dict[int, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if i not in self.seen:
            self.seen[i] = ENTRY.unpack(self.file.read(i * ENTRY.size, ENTRY.size))[0]
        return self.seen[i]


class TensorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, Wanted()
        self.read_bytes = 0  # of the reads of this very object, for those who call it themselves

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def table(self) -> dict:
        fs, root = store_of(self.path)
        with fs.open_input_stream(f"{root}/{TABLE}") as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        table = self.table()
        step = max(1, PARTITION_BYTES // max(1, table["stride"]))
        out: list[InputPartition] = []
        for x in table["files"]:
            ranges = self.wanted.ranges(x["least"], x["most"])
            if ranges:
                out += [Records(x["name"], x["n"], table["stride"], ranges, a, min(a + step, x["n"])) for a in range(0, x["n"], step)]
        return out

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file can have the ids
            return
        fs, root = store_of(self.path)
        index = Index(Counted(fs, f"{root}/{partition.name}.index"), partition.n)
        data = Counted(fs, f"{root}/{partition.name}.data")
        try:
            for a, b in partition.ranges:
                first = bisect_left(index, a, partition.first, partition.last)
                last = bisect_right(index, b, first, partition.last)
                step = max(1, BATCH_BYTES // max(1, partition.stride))
                for at in range(first, last, step):
                    yield batch_of(index.file, data, partition.stride, at, min(at + step, last))
        finally:
            self.read_bytes += index.file.bytes + data.bytes
            index.file.file.close()
            data.file.close()


def batch_of(index: Counted, data: Counted, stride: int, first: int, last: int) -> pa.RecordBatch:
    """Records of neighbouring entries of the index; places that follow one another are one read."""
    entries = np.frombuffer(index.read(first * ENTRY.size, (last - first) * ENTRY.size), "<i8").reshape(-1, 2)
    cuts = np.flatnonzero(np.diff(entries[:, 1]) != 1) + 1
    body = b"".join(data.read(int(run[0, 1]) * stride, len(run) * stride) for run in np.split(entries, cuts))
    at = np.arange(len(entries) + 1, dtype=np.int32) * np.int32(stride)
    records = pa.Array.from_buffers(pa.binary(), len(entries), [None, pa.py_buffer(at), pa.py_buffer(body)])
    return pa.RecordBatch.from_arrays([pa.array(entries[:, 0].astype(np.int64)), records], ["id", "data"])


def write_tensors(records: DataFrame, path: str, stride: int, id_col: str = "id", data_col: str = "data", mode: str = "overwrite") -> None:
    """Write records of `stride` bytes in ranges of ids, so that a range of ids is in few files and in one piece."""
    spark = records.sparkSession
    spark.dataSource.register(Tensors)
    rows = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{data_col}`").alias("data"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("tensors").option("path", path).option("stride", stride).mode(mode).save()


def read_tensors(spark, path: str, condition=None) -> DataFrame:
    """(id, data) of the records that meet a condition on id, which is pushed into the reader."""
    spark.dataSource.register(Tensors)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("tensors").option("path", path).load()
    return df if condition is None else df.where(condition)
