"""SimHash near-duplicates by multi-index hashing.

Each distinct 64-bit fingerprint is entered in two tables, by its lower and its upper 32 bits.
Of two fingerprints at most 3 bits apart, one half differs in at most 1 bit, so a fingerprint
probes each table with its half and with that half with one clear bit set (a pair whose halves
differ in one bit is met once, from the side where the bit is clear).  Matches are verified on all
64 bits inside the join, and only verified links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

HALF = 32
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed fingerprint of one text: majority bits of the XXH64 (seed 42) of its word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.append(0, ends[:-1] + 1).tolist()
    ends = ends.tolist()
    if len(parts) < words:
        begins, ends = [0], [len(whole)]
    else:
        ends = ends[words - 1 :]
    n, ones = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(whole[b:e], 42) for b, e in zip(begins[at : at + CHUNK], ends[at : at + CHUNK], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def majority(parts: Iterator[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the words, of any number of fingerprints side by side.

    parts: arrays of uint64, whose first axis is counted over and whose values are lost; sizes: how many words count, for the
    other axes.  Counts are held bitwise, a plane a power of two, and added by full adders.
    """
    planes: list[np.ndarray] = []
    for rows in parts:
        level = 0
        while len(rows):
            if level == len(planes):
                planes.append(np.zeros(rows.shape[1:], np.uint64))
            # Each adder leaves one row of three here and a carry for the next plane.
            m, at = len(rows), 0
            carries, spare = np.empty((m // 2 + 1, *rows.shape[1:]), np.uint64), np.empty((m // 3 + 1, *rows.shape[1:]), np.uint64)
            while m > 1:
                k = max(1, m // 3)
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k] if m > 2 else planes[level][None]
                carry, odd = carries[at : at + k], spare[:k]
                np.bitwise_xor(a, b, out=odd)
                np.bitwise_and(a, b, out=carry)
                np.bitwise_and(odd, c, out=a)
                carry |= a
                np.bitwise_xor(odd, c, out=a)
                if m == 2:
                    planes[level][...] = 0
                rows[k : m - 2 * k] = rows[3 * k : m]
                at, m = at + k, max(1, m - 2 * k)
            np.bitwise_and(rows[0], planes[level], out=carries[at])
            planes[level] ^= rows[0]
            rows, level = carries[: at + bool(carries[at].any())], level + 1
    # A count is over half if it is over the whole part of the half.
    half, every = sizes // 2, np.uint64((1 << 64) - 1)
    over, same = (np.full(planes[0].shape, x, np.uint64) for x in (0, every))
    for level in reversed(range(max(len(planes), int(half.max()).bit_length()))):
        bit = planes[level] if level < len(planes) else np.uint64(0)
        of_half = np.where(half >> level & 1, every, np.uint64(0))
        over |= same & bit & ~of_half
        same &= ~(bit ^ of_half)
    return over


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) for each row; null and blank texts have fp 0, shorter texts are one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """u, v: pairs of different fingerprints (distinct column fp) at most radius bits apart, each pair at least once; radius up to 3."""
    if not 0 < radius <= 3:
        raise ValueError("two halves serve a radius of 1 to 3")
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned("fp", HALF)
    halves = F.array(F.struct(F.lit(0).alias("part"), low.alias("half")), F.struct(F.lit(1).alias("part"), high.alias("half")))
    each = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.part", "h.half")
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(HALF)))
    clear = F.filter(bits, lambda b: F.col("half").bitwiseAND(b) == 0)
    ball = F.concat(F.array("half"), F.transform(clear, lambda b: F.col("half").bitwiseOR(b)))
    probes = each.select(F.col("fp").alias("u"), "part", F.posexplode(ball).alias("i", "half"))
    table = each.select(F.col("fp").alias("v"), "part", "half")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    # Equal halves would meet twice: keep the ordered pair.
    found = probes.join(table, ["part", "half"]).where((apart <= radius) & ((F.col("i") > 0) | (F.col("u") < F.col("v"))))
    return found.select("u", "v")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    component_id is the smallest doc_id of the documents that links join, itself included; null
    ids take part but name a component only if it has no other (then it is null).  Equal
    fingerprints are grouped before any probe, so copies cost one row.  Empty table: no rows.
    """
    fps = cut(fingerprints(docs, words, doc_id, text))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut(components(links(nodes.select("fp"), radius)))
    own = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    of = own.where("root <> fp").join(named, "root").select("fp", "component_id").union(named.select(F.col("root").alias("fp"), "component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")
