"""Pixels: the one place where bytes of frames are opened, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..config import Geometry

#: The sampling grid of the change detector, columns and rows.
GRID = (32, 18)
#: Frames of one Arrow batch, as a frame may take megabytes.
BATCH_FRAMES = 32


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_FRAMES rows for what runs or starts within; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_FRAMES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def luma_plane(content: bytes | np.ndarray, g: Geometry) -> np.ndarray:
    """Luma of each pixel, as height by width."""
    a = np.frombuffer(content, np.uint8, g.nbytes).reshape(g.height, g.width, g.channels)
    if g.channels == 1:
        return a[:, :, 0]
    # Weights of 256 in all: no sum leaves 16 bits.
    total = a[:, :, 0] * np.uint16(77)
    total += a[:, :, 1] * np.uint16(150)
    total += a[:, :, 2] * np.uint16(29)
    return (total >> np.uint16(8)).astype(np.uint8)


def samples(plane: np.ndarray) -> np.ndarray:
    """Luma at the grid's points, row by row; a point lies at the floor of its share of the side."""
    h, w = plane.shape
    return plane[np.ix_(np.arange(GRID[1]) * h // GRID[1], np.arange(GRID[0]) * w // GRID[0])].ravel()


def cell_means(plane: np.ndarray, edge: str) -> np.ndarray:
    """Floored mean luma of 8 by 8 cells, row by row; see Config for edge."""
    h, w = plane.shape
    if edge == "truncate" or h % 8 == w % 8 == 0:
        sums = plane[: h // 8 * 8, : w // 8 * 8].reshape(8, h // 8, 8 * (w // 8)).sum(1, dtype=np.uint32).reshape(8, 8, w // 8).sum(2, dtype=np.int64)
        return (sums // (h // 8 * (w // 8))).ravel()
    rows, cols = np.arange(8) * (h // 8), np.arange(8) * (w // 8)
    sums = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), rows, axis=0), cols, axis=1)
    size = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
    return (sums // size).ravel()


def _views(contents: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each row, where they lie in the Arrow buffer."""
    wide = pa.types.is_large_binary(contents.type)
    ends = np.frombuffer(contents.buffers()[1], np.int64 if wide else np.int32, len(contents) + 1, contents.offset * (8 if wide else 4))
    data = np.frombuffer(contents.buffers()[2] or b"", np.uint8)
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield data[begin:end]


def with_features(frames: DataFrame, geometry: Geometry, edge: str) -> DataFrame:
    """frames (with content) plus sig (576 lumas) and cells (64 means), and without content; pixels are not copied out of Arrow."""
    kept = [c for c in frames.columns if c != "content"]
    at = frames.columns.index("content")
    carried = [i for i, c in enumerate(frames.columns) if c != "content"]

    def lists(rows: np.ndarray) -> pa.Array:
        n, k = rows.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, cells = np.zeros((len(b), GRID[0] * GRID[1]), np.int32), np.zeros((len(b), 64), np.int32)
            for i, view in enumerate(_views(b.column(at)) if len(b) else []):
                plane = luma_plane(view, geometry)
                sig[i], cells[i] = samples(plane), cell_means(plane, edge)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in carried), lists(sig), lists(cells)], [*kept, "sig", "cells"])

    schema = StructType([frames.schema[c] for c in kept]).add("sig", ArrayType(IntegerType())).add("cells", ArrayType(IntegerType()))
    return frames.mapInArrow(run, schema)


def byte_sad(content: Column, query: bytes) -> Column:
    """Sum of absolute differences of all bytes to those of one query frame; a shorter side counts as zeros."""
    held = np.frombuffer(query, np.uint8).astype(np.int16)

    @F.pandas_udf("long")
    def sad(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            out = []
            for c in contents:
                a = np.frombuffer(c, np.uint8)
                n = min(len(a), len(held))
                out.append(int(np.abs(a[:n] - held[:n]).sum(dtype=np.int64)) + int(a[n:].sum(dtype=np.int64)) + int(held[n:].sum(dtype=np.int64)))
            yield pd.Series(out, dtype="int64")

    return sad(content)
