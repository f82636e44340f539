"""Temporal dedup of a stream: decisions come out micro-batch by micro-batch, as a batch run over all frames makes them.

A chunk's state is the last frame decided and the frames that came before their turn; it goes when
the chunk is full, so at most chunk_frames signatures of each open chunk are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import Config
from ..functions.pixels import small_batches, with_features
from ..session import cut
from ..sources import frames, listing

_STATE = "next long, held binary"
#: The schema of a stream of files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def array_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of absolute differences, as in functions.bits."""
    return float(np.abs(np.asarray(a, np.int64) - np.asarray(b, np.int64)).sum())


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _step(signature: str, threshold: float, distance: Callable, chunk_frames: int, chunk: str, order: str, reset: str | None, columns: list[str]):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = int(key[0]) * chunk_frames
        at, parts = first, [*batches]
        if state.exists:
            at, held = state.get
            parts.insert(0, pa.ipc.open_stream(bytes(held)).read_pandas())
        # A frame that comes again, or was decided before, is left out.
        rows = pd.concat(parts, ignore_index=True).drop_duplicates(order).sort_values(order, ignore_index=True)
        rows = rows[rows[order] >= at - (at > first)].reset_index(drop=True)
        places = rows[order].to_numpy(np.int64)
        begin = int(np.searchsorted(places, at))
        n = int((places[begin:] == at + np.arange(len(places) - begin)).sum())  # frames whose turn it is
        out = rows.iloc[begin : begin + n].copy()
        sads, keep = [], []
        for i in range(begin, begin + n):
            if places[i] == first:
                sads.append(None)
                keep.append(True)
                continue
            a, b = rows[signature].iloc[i], rows[signature].iloc[i - 1]
            gone = any(x is None or np.isscalar(x) and pd.isna(x) for x in (a, b))
            sads.append(None if gone else float(distance(a, b)))
            other = reset is not None and not (rows[reset].iloc[i] == rows[reset].iloc[i - 1] or pd.isna(rows[reset].iloc[i]) and pd.isna(rows[reset].iloc[i - 1]))
            keep.append(gone or sads[-1] > threshold or other)
        out["sad"], out["keep"] = pd.array(sads, "Float64"), np.array(keep, bool)
        if at + n == first + chunk_frames:
            state.remove()
        else:
            state.update((at + n, _packed(rows.iloc[max(begin + n - 1, 0) :] if at + n > first else rows)))
        yield out[[*columns, "sad", "keep"]]

    return run


def temporal_dedup(stream: DataFrame, signature: str, threshold: float, distance: Callable, chunk_frames: int, chunk: str = "chunk_id", order: str = "seq", reset: str | None = None) -> DataFrame:
    """stream plus sad (double) and keep, by the rule of operators.dedup; rows may come in any order.

    order must number the frames from 0 without gaps, and chunk be order div chunk_frames: a frame is
    decided once all before it in its chunk have come.  distance: over two signatures, in Python.
    """
    schema = StructType.fromJson(stream.schema.jsonValue()).add("sad", "double").add("keep", "boolean")
    run = _step(signature, threshold, distance, chunk_frames, chunk, order, reset, stream.columns)
    return stream.groupBy(chunk).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def decide(spark: SparkSession, root: str, to: str, cfg: Config, checkpoint: str) -> StreamingQuery:
    """Append path, video_id, frame_id, seq, chunk_id, cells, sad, keep of frames that are new under root to the table `to`/decided; ends when all are read.

    New frames must sort behind those of earlier calls, whose numbers stand in the state; ValueError if one does not, or if a frame has a name that streams of files pass over.
    """
    names = cut(frames.manifest(spark, root, cfg.chunk_frames).select("path", "video_id", "frame_id", "seq", "chunk_id"))
    if unseen := names.where(listing.odd(F.col("path"))).count():
        raise ValueError(f"{unseen} frames have names that begin with a dot or an underscore, or stand in such a folder: streams of files pass over them")
    path, fs = frames._status(spark, f"{to}/decided")
    if fs.exists(path) and (moved := decided(spark, to).select("path", "seq").join(names.select("path", F.col("seq").alias("now")), "path", "left").where("now is null or now <> seq").count()):
        raise ValueError(f"{moved} frames that were decided have gone or moved: a new frame sorts before them")
    arrived = spark.readStream.format("binaryFile").schema(FILES).load(f"{root}/*/*")
    read = arrived.select("path", frames.exact(F.col("content"), F.col("length"), cfg.geometry).alias("content"))
    with small_batches(spark):
        known = with_features(read, cfg.geometry, cfg.index_edge).join(names, "path")
        out = temporal_dedup(known, "sig", cfg.dedup_threshold, array_distance, cfg.chunk_frames, reset="video_id" if cfg.reset_on_video else None).drop("sig")
        return out.writeStream.format("parquet").option("path", f"{to}/decided").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark: SparkSession, to: str) -> DataFrame:
    return spark.read.parquet(f"{to}/decided")
