"""Line dedup: lines found in many documents lose all their occurrences, or all but the first.

Line keys are hashed (128 bits) and range-partitioned with the document behind the hash, so one
very common line spreads over many tasks.  Each task reads its rows sorted by hash, document and
position and streams: it holds back a bit a line of the first few documents of one line.  A
line that spans tasks is settled by two counts a task, all that the driver sees.  The result is a
compressed keep bitmap for each document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

#: Fixed value: white space stripped from both ends of a line.
STRIP = b" \t\n\x0b\x0c\r"

_LINE = "h1 long, h2 long, doc_id long, tx long, pos int"
_COLS = ("h1", "h2", "doc_id", "tx", "pos")


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tx (hash of the text) and text: the first two identify a row, whatever else repeats."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tx"), body.alias("text"))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        ids, txs, texts = b.column(0), b.column(1).to_pylist(), b.column(2)
        digests, row, pos = [], [], []
        for i in range(len(b)):
            for p, line in enumerate(texts[i].as_py().encode().split(b"\n")):
                if key := line.strip(STRIP).lower():
                    digests.append(xxhash.xxh3_128_digest(key))
                    row.append(i)
                    pos.append(p)
        h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), ids.take(at), pa.array(txs, pa.int64()).take(at), pa.array(pos, pa.int32())], list(_COLS)
        )


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    """h1, h2, doc_id (null as 0), whether it is null, tx, pos."""
    doc = b.column(2)
    return [b.column(0).to_numpy(False), b.column(1).to_numpy(False), doc.fill_null(0).to_numpy(False), doc.is_null().to_numpy(False), b.column(3).to_numpy(False), b.column(4).to_numpy(False)]


def _starts(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where a line's rows begin, and where a document's rows in it begin (as flags)."""
    differs = lambda a: np.concatenate(([True], a[1:] != a[:-1]))
    line = differs(cols[0]) | differs(cols[1])
    return line, line | differs(cols[2]) | differs(cols[3]) | differs(cols[4])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a partition's first and last line."""
    from pyspark import TaskContext

    first: list | None = None
    last: list | None = None
    before = None
    for b in batches:
        if not len(b):
            continue
        cols = _columns(b)
        line, doc = _starts(cols)
        key = tuple(int(c[0]) for c in cols[:5])
        if before == key:
            doc[0] = False
        at = np.flatnonzero(line)
        counts = np.add.reduceat(doc.astype(np.int64), at)
        keys = [(int(cols[0][i]), int(cols[1][i])) for i in (at[0], at[-1])]
        if last is not None and last[0] == keys[0]:
            last[1] += int(counts[0])
            if len(at) > 1:
                if first is None:
                    first = last
                last = [keys[1], int(counts[-1])]
        else:
            if last is not None and first is None:
                first = last
            if first is None and len(at) > 1:
                first = [keys[0], int(counts[0])]
            last = [keys[1], int(counts[-1])]
        before = tuple(int(c[-1]) for c in cols[:5])
    rows = [x for x in (first, last) if x is not None]
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([x[0][0] for x in rows], pa.int64()), pa.array([x[0][1] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["part", "h1", "h2", "docs"])


def _runs(cols: list[np.ndarray], begin: int, doc: np.ndarray) -> Iterator[tuple]:
    """Of rows of one line from begin on, each document (doc_id, whether it is null, tx) with its positions: numbers, or bits from a byte on where that is shorter."""
    starts = np.union1d(np.flatnonzero(doc[begin:]), [0]) + begin
    for i, j in zip(starts, np.append(starts[1:], len(doc)), strict=True):
        pos = np.unique(cols[5][i:j])
        at = int(pos[0]) >> 3
        if (int(pos[-1]) >> 3) - at < 4 * len(pos):
            bits = np.zeros((int(pos[-1]) >> 3) - at + 1, np.uint8)
            np.bitwise_or.at(bits, (pos >> 3) - at, (128 >> (pos & 7)).astype(np.uint8))
            pos = None
        else:
            bits = None
        yield cols[2][i].item(), cols[3][i].item(), cols[4][i].item(), at, bits, pos


def _gone(doc_id: np.ndarray, null: np.ndarray, tx: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64(), mask=null), pa.array(tx, pa.int64()), pa.array(pos, pa.int32())], ["doc_id", "tx", "pos"])


def _dropped(batches: Iterator[pa.RecordBatch], part: int, min_docs: int, keep_first: bool, spanning: dict[tuple[int, int], tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """doc_id, tx, pos of the lines to drop of a partition's sorted rows.

    Between batches stay the last line's count of documents, its first row, and, until it is known
    to be common, the positions it has in its documents so far: under min_docs of them, a bit a
    line of those documents at most.
    """
    key = doc_key = head = None
    docs = 0
    waiting: list[tuple] = []
    for b in batches:
        if not len(b):
            continue
        cols = _columns(b)
        line, doc = _starts(cols)
        at = np.flatnonzero(line)
        ends = np.append(at[1:], len(line))
        row = lambda i: tuple(c[i].item() for c in cols)  # noqa: B023, E731
        goes_on = row(0)[:2] == key
        if goes_on and row(0)[2:5] == doc_key:
            doc[0] = False
        counts = np.add.reduceat(doc.astype(np.int64), at)
        if goes_on:
            counts[0] += docs
        common = counts >= min_docs
        firsts = np.logical_and.reduce([c == c[np.repeat(at, ends - at)] for c in cols[2:]])
        if goes_on:
            firsts[: ends[0]] = False if head is None else np.logical_and.reduce([c[: ends[0]] == x for c, x in zip(cols[2:], head, strict=True)])
        for j in {0, len(at) - 1}:
            if (told := spanning.get(row(at[j])[:2])) is not None:
                common[j] = told[0] >= min_docs
                if told[1] != part:
                    firsts[at[j] : ends[j]] = False
        if goes_on and common[0]:
            for doc_id, null, tx, begin, bits, pos in waiting:
                pos = np.flatnonzero(np.unpackbits(bits)) + 8 * begin if pos is None else pos
                if keep_first and (doc_id, null, tx) == head[:3]:
                    pos = pos[pos != head[3]]
                yield _gone(np.full(len(pos), doc_id), np.full(len(pos), null), np.full(len(pos), tx), pos)
            waiting = []
        drop = np.repeat(common, ends - at)
        rows = np.flatnonzero(drop & ~firsts if keep_first else drop)
        yield _gone(cols[2][rows], cols[3][rows], cols[4][rows], cols[5][rows])
        if not (goes_on and len(at) == 1):
            key, waiting = row(at[-1])[:2], []
            head = None if spanning.get(key, (0, part))[1] != part else row(at[-1])[2:]
        docs, doc_key = int(counts[-1]), row(-1)[2:5]
        if not common[-1] and key not in spanning:
            waiting.extend(_runs(cols, at[-1], doc))


def _dropper(min_docs: int, keep_first: bool, spanning: dict[tuple[int, int], tuple[int, int]]):
    """spanning: of lines that lie in several partitions, all their documents and the first partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _dropped(batches, TaskContext.get().partitionId(), min_docs, keep_first, spanning)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, dropped = [], []
        for n, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[gone or []] = False
            kept.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "tx", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tx, n_lines, n_dropped, keep_bitmap (zlib over bits, most significant first) of each document.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased; empty keys
    are never dropped.  Lines whose key min_docs documents have are dropped, but for the first
    occurrence (smallest doc_id, nulls first, then position) if keep_first.  A null text is one
    empty line.  Rows with the same doc_id and text are one document; tx tells apart different
    texts under one doc_id.  An empty table gives no rows.
    """
    if min_docs < 2 and keep_first:
        raise ValueError("with keep_first, min_docs is at least 2")
    spark = docs.sparkSession
    own = _documents(docs, doc_id, text)
    lines = own.mapInArrow(_hash_lines, _LINE)
    n = partitions(spark)
    order = ("h1", "h2", "doc_id", "tx")
    lines = cut(lines.repartitionByRange(n, *order).sortWithinPartitions(*order, "pos"))
    parts: dict[tuple[int, int], dict[int, int]] = {}
    for r in lines.mapInArrow(_edges, "part int, h1 long, h2 long, docs long").collect():  # two rows a partition
        parts.setdefault((r.h1, r.h2), {})[r.part] = r.docs
    spanning = {k: (sum(v.values()), min(v)) for k, v in parts.items() if len(v) > 1}
    gone = lines.mapInArrow(_dropper(min_docs, keep_first, spanning), "doc_id long, tx long, pos int")
    gone = gone.groupBy("doc_id", "tx").agg(F.collect_set("pos").alias("gone"))
    lite = own.select("doc_id", "tx", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")).dropDuplicates(["doc_id", "tx"])
    match = lite["doc_id"].eqNullSafe(gone["doc_id"]) & (lite["tx"] == gone["tx"])
    both = lite.join(gone, match, "left").select(lite["doc_id"], lite["tx"], "n_lines", "gone")
    return both.mapInArrow(_bitmaps, "doc_id long, tx long, n_lines long, n_dropped long, keep_bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, n, bits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n)
            out.append(text if keep.all() else "\n".join(x for x, k in zip(text.split("\n"), keep, strict=True) if k))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2), b.column(3)], ["doc_id", "kept_text", "n_lines", "n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for each row of docs."""
    own = _documents(docs, doc_id, text)
    match = own["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (own["tx"] == bitmaps["tx"])
    both = own.join(bitmaps, match).select(own["doc_id"], "text", "n_lines", "n_dropped", "keep_bitmap")
    return both.mapInArrow(_apply, "doc_id long, kept_text string, n_lines long, n_dropped long")
