"""Token-id output: documents in the order of their ids, as coded frames of tokens in Parquet.

A file's rows are frames: whole documents, FRAME_IDS ids or a little more or a single longer
document, with the documents' ids and lengths beside their ids in coded blocks (see token_codec).
A frame, and each of its blocks, can be read alone, so a lost task is simply run again; where a
frame begins in the whole sequence follows from the counts of the frames before, which are summed
from the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_codec
from .common import released

FRAME_IDS = 1 << 23
#: Characters of the texts that are encoded at once.
BATCH_CHARS = 1 << 22
_FRAME = "part int, frame int, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"
_READ = "part int, frame int, doc_id long, before long, n_tokens long, ids_crc32 long"


@cache
def _encoder(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from .tokenise import Encoder

    return Encoder(path)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = _encoder(path), TaskContext.get().partitionId()
        vocab = max(encode.vocab, end_id + 1)
        frame, docs, pieces, held = 0, [], [], 0
        end = np.uint16(end_id)

        def row() -> pa.RecordBatch:
            flat = np.concatenate(pieces)
            rows = [[part], [frame], [len(flat)], [docs], [[len(p) for p in pieces]], [token_codec.encode(flat, vocab)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["part", "frame", "n_ids", "doc_ids", "lengths", "blocks"])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in _batches(texts):
                for d, tokens in zip(ids[lo:hi], encode(texts[lo:hi]), strict=True):
                    docs.append(d)
                    pieces.append(np.append(tokens.astype(np.uint16), end))
                    held += len(tokens) + 1
                    if held >= FRAME_IDS:
                        yield row()
                        frame, docs, pieces, held = frame + 1, [], [], 0
        if docs:
            yield row()

    return run


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode each text of docs with the tokenizer file, append end_id, and write frames to the folder `to`.

    Order: ascending doc_id, nulls first, equal ids by a hash of the text.  Null texts are empty:
    the end id alone.  Equal rows are all written.  The text is shuffled once.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tx", F.xxhash64("text"))
    # Adaptive execution joins small partitions, as long frames code better and faster.
    own = own.repartitionByRange(F.asc_nulls_first("doc_id"), "tx").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tx")
    own.select("doc_id", "text").mapInArrow(released(_frames(tokenizer, end_id)), _FRAME).write.option("compression", "none").option("parquet.block.size", 1 << 20).parquet(to)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            part, frame, docs, sizes, blocks = (b.column(k)[i].as_py() for k in range(5))
            ids = token_codec.decode(blocks)
            ends = np.cumsum(sizes)
            begins = ends - np.array(sizes)
            if sum(sizes) != len(ids):
                raise ValueError(f"frame {frame} of part {part} holds {len(ids)} ids of {ends[-1]}")
            sums = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(begins, ends, strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([frame] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(begins), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["part", "frame", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the folder, from its decoded frames; damaged blocks raise."""
    stored = spark.read.schema(_FRAME).parquet(path)
    frames = stored.select("part", "frame", "n_ids")
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row a written partition.
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = frames.select("part", "frame", own.alias("own")).join(parts, "part").select("part", "frame", (F.col("own") + F.col("first")).alias("first"))
    decoded = stored.select("part", "frame", "doc_ids", "lengths", "blocks").mapInArrow(released(_decode), _READ)
    return decoded.join(starts, ["part", "frame"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def decoded_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of each document in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, sizes, blocks in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = token_codec.decode(blocks).astype(np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([ids[e - n : e] for e, n in zip(ends, sizes, strict=True)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.schema(_FRAME).parquet(path).select("doc_ids", "lengths", "blocks").mapInArrow(run, "doc_id long, ids array<long>")
