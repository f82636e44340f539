"""The raw frame tree: one folder a video, one file a frame, in any store that Hadoop reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Geometry
from ..operators.sequence import number
from . import listing


def _status(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, root: str) -> str:
    """root as a scan's paths begin; ValueError if it is no folder."""
    path, fs = _status(spark, root)
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"{root} is not a folder")
    return fs.makeQualified(path).toString()


def videos(spark: SparkSession, root: str) -> DataFrame:
    """video: names of the folders right under root, empty ones and those that begin with a dot or an underscore too; ValueError if root is no folder.

    A task lists them.  In stores that Python tasks cannot open, the driver does.
    """
    whole = _qualified(spark, root)
    if listing.reachable(whole):
        return listing.folders(spark, whole)
    path, fs = _status(spark, root)
    return spark.createDataFrame([(s.getPath().getName(),) for s in fs.listStatus(path) if s.isDirectory()], "video string")


def files(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """path, length, modificationTime of the files right under the folders of root, or under those named, whatever their names; a file right under root is none.

    Tasks list the folders.  In stores that Python tasks cannot open Spark's listing stands in, which passes
    over odd names (files or folders that begin with a dot or an underscore).
    """
    whole = _qualified(spark, root)
    if not listing.reachable(whole):
        return _seen(spark, root, folders, ["path", "length", "modificationTime"]).where(~listing.odd(F.col("path")))
    return listing.files(spark.createDataFrame([(x,) for x in folders], "video string") if folders else videos(spark, root), whole)


def _seen(spark: SparkSession, root: str, folders: list[str] | None, columns: list[str]) -> DataFrame:
    """Columns of the files under the folders that Spark's own parallel listing finds; columns that are not asked for, content above all, are not read."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    deep = len(_qualified(spark, root).split("/")) + 2  # a folder that the pattern finds is listed by Spark in turn
    try:
        found = spark.read.format("binaryFile").load([f"{root}/{_literal(x)}/*" for x in folders] if folders else f"{root}/*/*").select(*columns)
        return found.where(F.size(F.split("path", "/")) == deep).select(*columns)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long, content binary, modificationTime timestamp").select(*columns)  # no file in any folder


def scan(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """path, length, content of the files right under the folders of root, or under those named.

    Tasks list and open them, whatever their names: Spark's source would find each file through the driver
    and deal so few small ones to a task that a tree of a million has tens of thousands.  It stands in where
    Python tasks cannot open the store, and passes over odd names there.
    """
    if not listing.reachable(_qualified(spark, root)):
        return _seen(spark, root, folders, ["path", "length", "content"]).where(~listing.odd(F.col("path")))
    return listing.opened(files(spark, root, folders).select("path", "length").repartition(listing.tasks(spark)))


def _literal(path: str) -> str:
    """A path that names one file, whatever signs of a pattern are in it."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, content of the files named, as a listing gives their paths, in that order as far as Spark deals equal files; no other file is listed.

    Files with odd names come last, in their order, and are opened in tasks.
    """
    named = {k: [p for p in paths if _is_odd(p) == k] for k in (False, True)}
    parts = []
    if named[False]:
        parts.append(spark.read.format("binaryFile").load([_literal(p) for p in named[False]]).select("path", "length", "content"))
    if named[True]:
        rest = listing.opened(spark.createDataFrame([(p,) for p in named[True]], "path string"))
        parts.append(rest.select("path", F.length("content").cast("long").alias("length"), "content"))
    if not parts:
        return spark.createDataFrame([], "path string, length long, content binary")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _is_odd(path: str) -> bool:
    """listing.odd of one path; never in a store that only Spark's listing reaches."""
    folder, name = path.rsplit("/", 2)[-2:]
    return any(x.startswith((".", "_")) or x.endswith("._COPYING_") for x in (folder, name))


def manifest(spark: SparkSession, root: str, chunk_frames: int) -> DataFrame:
    """path, length, modified, video, video_id, frame_id, seq, chunk_id of every frame, from names; no pixel is read."""
    names = files(spark, root).select("path", "length", F.col("modificationTime").alias("modified"), F.element_at(F.split("path", "/"), -2).alias("video"), F.element_at(F.split("path", "/"), -1).alias("file"))
    return number(names, "video", ["file"], chunk_frames, videos(spark, root)).select("path", "length", "modified", "video", "video_id", "frame_id", "seq", "chunk_id")


def exact(content: Column, length: Column, geometry: Geometry) -> Column:
    """The first bytes of a stored frame: a shorter file is an error, what a longer one has beyond is left."""
    return F.when(length < geometry.nbytes, F.raise_error(F.concat(F.lit("a frame has "), length.cast("string"), F.lit(f" bytes of {geometry.nbytes}")))).otherwise(F.substring(content, 1, geometry.nbytes))


def read_query(spark: SparkSession, path: str, geometry: Geometry) -> bytes:
    """The bytes of a query frame, whose length must fit exactly."""
    rows = spark.read.format("binaryFile").load(path).select("length", "content").limit(2).collect()
    if len(rows) != 1 or rows[0]["length"] != geometry.nbytes:
        raise ValueError(f"{path} is not one frame of {geometry.nbytes} bytes")
    return bytes(rows[0]["content"])
