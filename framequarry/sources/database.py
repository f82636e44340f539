"""The deduplicated database: immutable segments of Parquet files, and numbered snapshots that name them.

path/segments/<id>/features    a row for each frame that the segment decided: ids, sad, keep, sig, cells
                  /signatures  idx, video_id, frame_id, hash, path of kept frames, sorted by idx
                  /frames      idx, video_id, frame_id, hash, content of kept frames
                  /layout      of each file of those two: name, bytes, rows, first and last idx
                  /videos      video_id, video
path/snapshots/<number>.json   segments with the ranges of seq and idx that count of each

A commit writes one segment and then puts its snapshot in place by a rename; the snapshot with the
highest number is the database.  So a build that fails leaves the database as it was, and readers
of an older snapshot keep their files until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURES = "idx long, video_id int, frame_id int, hash long"
_FRAMES = f"{_SIGNATURES}, content binary"
_LAYOUT = "kind string, file string, bytes long, n long, first long, last long"
_FEATURES = "path string, length long, modified timestamp, video string, video_id int, frame_id int, seq long, chunk_id long, sad long, keep boolean, sig array<int>, cells array<int>"


@dataclass(frozen=True)
class Segment:
    """name: its folder; rows seq_from to seq_to - 1 and idx_from to idx_to - 1 of it count; rows: kept frames that were written."""

    name: str
    seq_from: int
    seq_to: int
    idx_from: int
    idx_to: int
    rows: int

    def until(self, seq: int, idx: int) -> Segment | None:
        """What lies before a place in the sequence, and the idx that begins there."""
        return replace(self, seq_to=min(self.seq_to, seq), idx_to=min(self.idx_to, idx)) if self.seq_from < min(self.seq_to, seq) else None

    @property
    def cut(self) -> bool:
        return self.idx_to - self.idx_from < self.rows


@dataclass(frozen=True)
class Snapshot:
    """settings: what decisions depend on; videos: the segment whose table of videos holds."""

    number: int = -1
    settings: tuple[tuple[str, str], ...] = ()
    segments: tuple[Segment, ...] = ()
    videos: str = ""

    @property
    def frames_total(self) -> int:
        return self.segments[-1].seq_to if self.segments else 0

    @property
    def kept(self) -> int:
        return self.segments[-1].idx_to if self.segments else 0


def _store(spark: SparkSession, path: str):
    """Hadoop's path, and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _store(spark, f"{path}/snapshots")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def _named(path: str, number: int) -> str:
    return f"{path}/snapshots/{number:012d}.json"


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot | None:
    """A snapshot, the last one if no number is given; None if there is none."""
    numbers = _numbers(spark, path)
    if not numbers or number is not None and number not in numbers:
        return None
    number = numbers[-1] if number is None else number
    held = json.loads(spark.read.text(_named(path, number), wholetext=True).first()[0])
    return Snapshot(number, tuple((k, v) for k, v in held["settings"]), tuple(Segment(**s) for s in held["segments"]), held["videos"])


def current(spark: SparkSession, path: str) -> Snapshot:
    if (found := snapshot(spark, path)) is None:
        raise ValueError(f"{path} is no database: it has no snapshot")
    return found


def publish(spark: SparkSession, path: str, snap: Snapshot) -> Snapshot:
    """Put a snapshot in place under the next number; ValueError if another writer took that number first."""
    held = {k: v for k, v in asdict(snap).items() if k != "number"}
    open_name, fs = _store(spark, f"{path}/snapshots/.{uuid.uuid4().hex}")
    out = fs.create(open_name, False)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    final, _ = _store(spark, _named(path, snap.number))
    if fs.exists(final) or not fs.rename(open_name, final):
        fs.delete(open_name, False)
        raise ValueError(f"{path}: snapshot {snap.number} was written by another")
    return snap


def new_segment(path: str) -> str:
    return uuid.uuid4().hex


def folder(path: str, segment: str, kind: str) -> str:
    return f"{path}/segments/{segment}/{kind}"


def _read(spark: SparkSession, path: str, kind: str, schema: str, key: str, snap: Snapshot | None) -> DataFrame:
    """The rows of a table that count: whole segments in one scan, each segment that was cut with a filter of its key."""
    snap = snap or current(spark, path)
    bound = {"idx": lambda s: s.idx_to, "seq": lambda s: s.seq_to}[key]
    # A segment whose frames were all dropped has no rows of a key of kept frames.
    whole = [s for s in snap.segments if not s.cut and not (key == "seq" and s is not snap.segments[-1])]
    cut = [s for s in snap.segments if s not in whole]
    parts = [spark.read.schema(schema).parquet(folder(path, s.name, kind)).where(F.col(key) < bound(s)) for s in cut]
    if whole:
        parts.append(spark.read.schema(schema).parquet(*(folder(path, s.name, kind) for s in whole)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def signatures(spark: SparkSession, path: str, snap: Snapshot | None = None) -> DataFrame:
    """idx, video_id, frame_id, hash, without pixels."""
    return _read(spark, path, "signatures", _SIGNATURES, "idx", snap)


def frames(spark: SparkSession, path: str, snap: Snapshot | None = None) -> DataFrame:
    """idx, video_id, frame_id, hash, content."""
    return _read(spark, path, "frames", _FRAMES, "idx", snap)


def features(spark: SparkSession, path: str, snap: Snapshot | None = None) -> DataFrame:
    """Every frame's file, ids, decision and features."""
    return _read(spark, path, "features", _FEATURES, "seq", snap)


def videos(spark: SparkSession, path: str) -> DataFrame:
    """video_id, video."""
    return spark.read.schema("video_id int, video string").parquet(folder(path, current(spark, path).videos, "videos"))


def layout(spark: SparkSession, path: str, snap: Snapshot | None = None) -> DataFrame:
    """segment, kind, file, bytes, n, first, last of each file of signatures and frames that holds a row that counts; a row a file."""
    snap = snap or current(spark, path)
    parts = [spark.read.schema(_LAYOUT).parquet(folder(path, s.name, "layout")).where(F.col("first") < s.idx_to).withColumn("segment", F.lit(s.name)) for s in snap.segments]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{_LAYOUT}, segment string")


def files_of(spark: SparkSession, path: str, ids: Iterable[int], snap: Snapshot | None = None) -> dict[str, list[str]]:
    """By segment, the files of pixels that may hold one of the ids: as many as ids at most in all, unless files overlap."""
    snap = snap or current(spark, path)
    held = layout(spark, path, snap).where("kind = 'frames'")
    # An id belongs to the segment whose range it lies in, whatever other segments have under it.
    asked = {s.name: sorted(i for i in ids if s.idx_from <= i < s.idx_to) for s in snap.segments}
    near = [(F.col("segment") == name) & F.exists(F.array(*map(F.lit, own)), lambda i: i.between(F.col("first"), F.col("last"))) for name, own in asked.items() if own]
    out: dict[str, list[str]] = {}
    for r in held.where(reduce(lambda a, b: a | b, near)).select("segment", "file").collect() if near else []:
        out.setdefault(r["segment"], []).append(f"{folder(path, r['segment'], 'frames')}/{r['file']}")
    return out


def payload(spark: SparkSession, path: str, ids: Iterable[int], snap: Snapshot | None = None) -> DataFrame:
    """The rows of frames of a few ids: the layout names the files, no other is listed or opened, and row groups without an id are skipped."""
    snap, ids = snap or current(spark, path), list(ids)
    files = files_of(spark, path, ids, snap)
    parts = [spark.read.schema(_FRAMES).parquet(*files[s.name]).where(F.col("idx").isin([i for i in ids if s.idx_from <= i < s.idx_to])) for s in snap.segments if s.name in files]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _FRAMES)


def write_layout(spark: SparkSession, path: str, segment: str, idx_from: int, n: int) -> None:
    """Note the files of a segment, from their idx columns; ValueError unless both tables hold idx_from and the n - 1 that follow."""
    parts = []
    for kind in ("signatures", "frames"):
        rows = spark.read.schema("idx long").parquet(folder(path, segment, kind)).select("idx", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        parts.append(rows.groupBy(F.lit(kind).alias("kind"), "file", "bytes").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")))
    parts[0].union(parts[1]).coalesce(1).write.parquet(folder(path, segment, "layout"))
    held = spark.read.schema(_LAYOUT).parquet(folder(path, segment, "layout")).groupBy("kind").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
    for r in held:
        if (r["n"], r["first"], r["last"]) != (n, idx_from, idx_from + n - 1):
            raise ValueError(f"{path}: {r['n']} {r['kind']} ({r['first']} to {r['last']}) were written of {n}")
    if n and len(held) != 2:
        raise ValueError(f"{path}: signatures or frames of a segment are missing")


def store(spark: SparkSession, path: str, rows: DataFrame, keep: int = 0) -> Snapshot:
    """Add rows (idx, video_id, frame_id, hash, content), idx from `keep` on without gaps, behind the first `keep` of the database; a row counts as a frame of its own."""
    old, name = snapshot(spark, path) or Snapshot(), new_segment(path)
    if keep > old.kept:
        raise ValueError(f"{path} has {old.kept} rows, not {keep}")
    rows.select("idx", "video_id", "frame_id", "hash", "content").sortWithinPartitions("idx").write.parquet(folder(path, name, "frames"))
    written = spark.read.schema(_FRAMES).parquet(folder(path, name, "frames")).drop("content")
    written.write.parquet(folder(path, name, "signatures"))
    n = written.count()
    write_layout(spark, path, name, keep, n)
    before = [s for x in old.segments if (s := x.until(keep, keep))]
    return publish(spark, path, Snapshot(old.number + 1, old.settings, (*before, Segment(name, keep, keep + n, keep, keep + n, n)), old.videos))


def validate(spark: SparkSession, path: str, nbytes: int | None = None) -> int:
    """Rows of the database; ValueError if a file that its snapshot names is missing or has another size, or if the segments leave a gap.

    Names and sizes come from a listing and from the layout, a row a file; no row group is read
    and no idx is shuffled.  nbytes: all pixels are read besides, and each frame must have as many.
    """
    snap = current(spark, path)
    at = 0
    for s in snap.segments:
        if s.idx_from != at or s.idx_to < at:
            raise ValueError(f"{path}: idx {at} to {s.idx_from - 1} is in no segment")
        at = s.idx_to
    if snap.segments:
        tables = [folder(path, s.name, kind) for s in snap.segments for kind in ("signatures", "frames")]
        part = lambda i: F.element_at(F.split("path", "/"), i)
        there = spark.read.format("binaryFile").load(tables).select(part(-3).alias("segment"), part(-2).alias("kind"), part(-1).alias("file"), F.col("length").alias("bytes"))
        lost = layout(spark, path, snap).join(there, ["segment", "kind", "file", "bytes"], "left_anti").agg(F.count("*"), F.sum("n")).first()
        if lost[0]:
            raise ValueError(f"{path}: {lost[0]} files with {lost[1]} rows are missing or changed, of {snap.kept} signatures and as many frames")
    if nbytes and (wrong := frames(spark, path, snap).where(F.length("content") != nbytes).count()):
        raise ValueError(f"{path}: {wrong} of another size")
    return snap.kept


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete what only snapshots before the last `keep` name, and what failed builds left; returns the number of segments deleted.  No build may run."""
    numbers = _numbers(spark, path)
    kept = [snapshot(spark, path, n) for n in numbers[-keep:]]
    named = {s.name for k in kept for s in k.segments} | {k.videos for k in kept}
    _, fs = _store(spark, path)
    for n in numbers[:-keep]:
        fs.delete(_store(spark, _named(path, n))[0], False)
    root, gone = _store(spark, f"{path}/segments")[0], 0
    for s in fs.listStatus(root) if fs.exists(root) else []:
        if s.getPath().getName() not in named:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone
