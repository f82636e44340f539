"""Four flat files side by side as a Spark data source: row i is the i-th element of each.

Reading: partitions are ranges of rows, so a task seeks to one offset a file and hands the bytes on
as Arrow buffers.  Writing: a task puts its rows where their idx says, in files that get their names
when all rows are there; a task that runs again writes the same bytes to the same places.  Neither
rows nor pixels pass the driver, and nothing is shuffled.

Reading works in any file system of pyarrow; writing at offsets needs one with a POSIX interface
(local or mounted) that all tasks see.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names of the flat files, and the type of an element (native byte order); a frame's size is an option.
FLAT = {"hash": ("hashes.bin", np.dtype("=i8")), "video_id": ("video_id.bin", np.dtype("=i4")), "frame_id": ("frame_id.bin", np.dtype("=i4"))}
PAYLOAD = "raw_frame.bin"
SCHEMA = "idx long, video_id int, frame_id int, hash long, content binary"
#: Bytes of a partition, and of one batch of rows.
PARTITION_BYTES, BATCH_BYTES = 128 << 20, 16 << 20


def _store(folder: str):
    """The file system of a folder, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


@dataclass
class Rows(InputPartition):
    """Rows first to end - 1."""

    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    """Runs of consecutive idx, first and last, in order."""

    runs: list[tuple[int, int]]


def _joined(runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, those that touch made one; ValueError where two overlap."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            raise ValueError(f"idx {first} is there twice")
        if out and first == out[-1][1] + 1:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


class FlatReader(DataSourceReader):
    low, high, only = 0, None, None  # what filters leave of idx

    def __init__(self, folder: str, nbytes: int, content: bool, partition_bytes: int):
        self.folder, self.nbytes, self.content, self.partition_bytes = folder, nbytes, content, partition_bytes

    def _counts(self) -> int:
        """Rows of the files; ValueError if they disagree."""
        store, base = _store(self.folder)
        rows = {}
        for name, width in (*((f, k.itemsize) for f, k in FLAT.values()), (PAYLOAD, self.nbytes)):
            info = store.get_file_info(f"{base}/{name}")
            if not info.is_file:
                raise ValueError(f"{self.folder} lacks {name}")
            if info.size % width:
                raise ValueError(f"{name}: {info.size} bytes are no whole number of elements")
            rows[name] = info.size // width
        if len(set(rows.values())) > 1:
            raise ValueError(f"the files have different lengths: {rows}")
        return rows[PAYLOAD]

    def partitions(self) -> list[InputPartition]:
        n = self._counts()
        low, high = max(0, self.low), n if self.high is None else min(n, self.high)
        width = self.nbytes * self.content + sum(k.itemsize for _, k in FLAT.values())
        if self.only is not None:
            # A partition a run of the rows that are asked for.
            runs = _joined([(i, i) for i in self.only if low <= i < high])
        else:
            runs = [(low, high - 1)] if low < high else []
        each = max(1, self.partition_bytes // width)
        return [Rows(a, min(a + each, last + 1)) for first, last in runs for a in range(first, last + 1, each)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.folder)
        each = max(1, BATCH_BYTES // self.nbytes) if self.content else 1 << 16
        names = ["idx", "video_id", "frame_id", "hash", *["content"] * self.content]

        def read(name: str, width: int, first: int, n: int) -> pa.Buffer:
            with store.open_input_file(f"{base}/{name}") as f:
                f.seek(first * width)
                data = f.read_buffer(n * width)
            if len(data) != n * width:
                raise ValueError(f"{name} ends before row {first + n}")
            return data

        for first in range(partition.first, partition.end, each):
            n = min(each, partition.end - first)
            arrays = {c: pa.Array.from_buffers(pa.from_numpy_dtype(k), n, [None, read(name, k.itemsize, first, n)]) for c, (name, k) in FLAT.items()}
            arrays["idx"] = pa.array(np.arange(first, first + n))
            if self.content:
                offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(self.nbytes))
                arrays["content"] = pa.Array.from_buffers(pa.binary(), n, [None, offsets, read(PAYLOAD, self.nbytes, first, n)])
            yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names)


class FilteringReader(FlatReader):
    """For sessions that push filters to Python data sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of idx choose the ranges that are read; Spark checks every filter again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("idx",):
                if isinstance(f, (EqualTo, In)):
                    asked = set(f.value if isinstance(f, In) else [f.value]) - {None}
                    self.only = asked if self.only is None else self.only & asked
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    end = f.value + isinstance(f, LessThanOrEqual)
                    self.high = end if self.high is None else min(self.high, end)
            yield f


class FlatWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, nbytes: int, overwrite: bool):
        store, base = _store(folder)
        if store.type_name != "local":
            raise ValueError(f"rows are written at offsets, which {folder} does not allow")
        self.base, self.nbytes, self.overwrite = base, nbytes, overwrite
        if not overwrite and os.path.exists(f"{base}/{PAYLOAD}"):
            raise ValueError(f"{folder} has flat files already")
        self.job = uuid.uuid4().hex
        os.makedirs(base, exist_ok=True)
        for name in self._names():
            open(self._open_name(name), "wb").close()

    def _names(self) -> list[str]:
        return [*(name for name, _ in FLAT.values()), PAYLOAD]

    def _open_name(self, name: str) -> str:
        return f"{self.base}/.{name}.{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        runs: list[tuple[int, int]] = []
        files = {name: open(self._open_name(name), "r+b") for name in self._names()}
        try:
            for b in iterator:
                if not len(b):
                    continue
                if any(b.column(c).null_count for c in ("idx", *FLAT, "content")):
                    raise ValueError("a row of flat files has no nulls")
                at = b.column("idx").to_numpy()
                lengths = pa.compute.binary_length(b.column("content")).to_numpy()
                if at.min() < 0 or (lengths != self.nbytes).any():
                    raise ValueError(f"a frame has {lengths[lengths != self.nbytes][:1]} bytes of {self.nbytes}, or an idx is under 0")
                ends = np.append((np.diff(at) != 1).nonzero()[0] + 1, len(at)).tolist()
                for s, e in zip([0, *ends[:-1]], ends, strict=True):
                    runs.append((int(at[s]), int(at[e - 1])))
                    part = b.slice(s, e - s)
                    for c, (name, kind) in FLAT.items():
                        self._put(files[name], at[s], kind.itemsize, np.ascontiguousarray(part.column(c).to_numpy(), kind))
                    content = part.column("content")
                    begin = np.frombuffer(content.buffers()[1], np.int32 if content.type == pa.binary() else np.int64, 1, content.offset * (4 if content.type == pa.binary() else 8))[0]
                    self._put(files[PAYLOAD], at[s], self.nbytes, memoryview(content.buffers()[2])[begin : begin + (e - s) * self.nbytes])
        finally:
            for f in files.values():
                f.close()
        return Written(_joined(runs))

    @staticmethod
    def _put(f, first: int, width: int, data) -> None:
        f.seek(int(first) * width)
        f.write(data)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Give the files their names if idx is 0 to n - 1, pixels first, so that a reader who finds all sizes equal has all rows."""
        try:
            runs = _joined([r for m in messages if m is not None for r in m.runs])
            n = runs[-1][1] + 1 if runs else 0
            if runs and runs != [(0, n - 1)]:
                raise ValueError(f"idx is not 0 to {n - 1}: it has {runs[:3]}")
            for name, width in [(PAYLOAD, self.nbytes), *((f, k.itemsize) for f, k in FLAT.values())]:
                if os.path.getsize(self._open_name(name)) != n * width:
                    raise ValueError(f"{name} has another size than {n} rows")
            for name in [PAYLOAD, *self._names()[:-1]]:
                os.replace(self._open_name(name), f"{self.base}/{name}")
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in self._names():
            if os.path.exists(self._open_name(name)):
                os.remove(self._open_name(name))


class FlatFrames(DataSource):
    """Format flat_frames: path, nbytes (of a frame); content=false leaves the pixels, partition_bytes cuts the rows of a task, pushdown=true takes filters of idx."""

    @classmethod
    def name(cls) -> str:
        return "flat_frames"

    def schema(self) -> str:
        return SCHEMA if self._content() else SCHEMA.removesuffix(", content binary")

    def _content(self) -> bool:
        return self.options.get("content", "true").lower() != "false"

    def _nbytes(self) -> int:
        n = int(self.options.get("nbytes", 0))
        if n <= 0:
            raise ValueError("nbytes must be over 0")
        return n

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else FlatReader
        return kind(self.options["path"], self._nbytes(), self._content(), int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        lacks = {"idx", *FLAT, "content"} - set(schema.names)
        if lacks:
            raise ValueError(f"the rows lack {sorted(lacks)}")
        return FlatWriter(self.options["path"], self._nbytes(), overwrite)


def read_flat(spark: SparkSession, folder: str, nbytes: int, content: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """idx, video_id, frame_id, hash and, if asked for, content of the flat files of a folder; sizes that disagree raise when Spark plans the scan.

    Comparisons of idx with constants choose the ranges that are read where spark.sql.python.filterPushdown.enabled is set.
    """
    spark.dataSource.register(FlatFrames)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("flat_frames").option("pushdown", pushdown).option("nbytes", nbytes).option("content", str(content).lower()).option("partition_bytes", partition_bytes).load(folder)


def write_flat(table: DataFrame, folder: str, nbytes: int) -> None:
    """Write rows (idx, video_id, frame_id, hash, content) as flat files, replacing those of the folder when all are there; idx must be 0 to n - 1 in any order."""
    table.sparkSession.dataSource.register(FlatFrames)
    rows = table.select("idx", "video_id", "frame_id", "hash", "content")
    rows.write.format("flat_frames").option("nbytes", nbytes).mode("overwrite").save(folder)
