"""Listing and opening of files in tasks, whatever their names: Spark's own sources pass over names that begin with a dot or an underscore."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch of names; bytes of a batch of contents, or one file.
ROWS, BYTES = 1 << 14, 16 << 20


def odd(path: Column) -> Column:
    """Whether Spark's file sources may pass over a file right under a folder of a tree, for its name or the folder's."""
    return path.rlike(r"(?s)(/[._][^/]*(/[^/]*)?|\._COPYING_(/[^/]*)?)\z")


def reachable(root: str) -> bool:
    """Whether Python tasks can open the store of root."""
    try:
        _store(root)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def _store(path: str):
    """A file system and a path in it; None for the local one."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        return None, path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (None, path)


def _under(folder: str, folders: bool) -> Iterator[tuple[str, int, int]]:
    """Name, length and milliseconds of change of the folders or the files right under a folder; one that is gone has none."""
    store, at = _store(folder)
    if store is None:
        try:
            found = os.scandir(at)
        except FileNotFoundError:
            return
        with found:
            for e in found:
                if folders and e.is_dir():
                    yield e.name, 0, 0
                elif not folders and e.is_file():
                    s = e.stat()
                    yield e.name, s.st_size, s.st_mtime_ns // 1_000_000
        return
    from pyarrow import fs

    for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if i.type == (fs.FileType.Directory if folders else fs.FileType.File):
            yield i.base_name, i.size or 0, (i.mtime_ns or 0) // 1_000_000


def tasks(spark: SparkSession) -> int:
    """Tasks that folders, and files to open, are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def folders(spark: SparkSession, root: str) -> DataFrame:
    """video: names of the folders right under root, listed as a stream by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            for name, _, _ in _under(root, True) if len(b) else []:
                held.append(name)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["video"])
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["video"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "video string")


def files(named: DataFrame, root: str) -> DataFrame:
    """path, length, modificationTime of the files right under the folders of root that `named` (video) has; folders are dealt to tasks."""

    def batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        paths, sizes, times = zip(*rows, strict=True) if rows else ((), (), ())
        changed = pa.array([t * 1000 for t in times], pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), changed], ["path", "length", "modificationTime"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        for b in batches:
            for video in b.column(0).to_pylist():
                for name, size, time in _under(f"{root}/{video}", False):
                    held.append((f"{root}/{video}/{name}", size, time))
                    if len(held) == ROWS:
                        yield batch(held)
                        held = []
        yield batch(held)

    return named.select("video").repartition(tasks(named.sparkSession), "video").mapInArrow(run, "path string, length long, modificationTime timestamp")


def opened(paths: DataFrame) -> DataFrame:
    """The rows of paths (path first) with content (all bytes of the file); a file that is gone is an error."""
    kept = paths.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, held, size = 0, [], 0
            for i, path in enumerate(b.column(0).to_pylist()):
                store, at = _store(path)
                with open(at, "rb") if store is None else store.open_input_stream(at) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BYTES or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(begin, i + 1 - begin).columns, pa.array(held, pa.binary())], [*kept, "content"])
                    begin, held, size = i + 1, [], 0

    return paths.mapInArrow(run, paths.withColumn("content", F.lit(None).cast("binary")).schema)


def put(rows: DataFrame, root: str) -> None:
    """Write content of each row (video, file, content) as a file of the tree under root, in the task that has it; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple] = {}
        for b in batches:
            for video, file, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if video not in made:
                    store, at = made[video] = _store(f"{root}/{video}")
                    if store is None:
                        os.makedirs(at, exist_ok=True)
                    else:
                        store.create_dir(at)
                store, at = made[video]
                with open(f"{at}/{file}", "wb") if store is None else store.open_output_stream(f"{at}/{file}") as out:
                    out.write(content)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["n"])

    context = rows.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(folder)
    rows.select("video", "file", "content").mapInArrow(run, "n int").count()
