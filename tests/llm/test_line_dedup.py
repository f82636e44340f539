import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framequarry.llm import line_dedup

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, min_docs, keep_first):
    """rows: doc_id, text."""
    docs = {(d is not None, d or 0, t or "") for d, t in rows}
    where = {}
    for null, d, t in docs:
        for p, line in enumerate(t.split("\n")):
            if key(line):
                where.setdefault(key(line), []).append((null, d, line_hash(t), p, t))
    drop = set()
    for places in where.values():
        if len({(a, b, t) for a, b, _, _, t in places}) >= min_docs:
            drop |= {(a, b, t, p) for a, b, _, p, t in sorted(places)[keep_first:]}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if (d is not None, d or 0, t or "", p) not in drop]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_against_brute_force(spark, min_docs, keep_first):
    rnd = random.Random(min_docs)
    common = ["License MIT", "  license mit\t", "", "shared É", "SHARED É", "shared é", "x"]
    rows = [(i, "\n".join(rnd.choice(common) if rnd.random() < 0.4 else f"own {rnd.random()}" for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (None, "x\nx\nlicense mit"), (None, None), rows[0], rows[0], (rows[0][0], "other\nx"), (2000, "hot\n" * 3000)]
    rows += [(3000 + i, "hot\nhot\nvery hot line\n") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs, keep_first)
    got = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)
    assert got == brute(rows, min_docs, keep_first)
    for r in bitmaps.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=r.n_lines)
        assert int((bits == 0).sum()) == r.n_dropped


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, pos int, tx long")
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == 0


def rows_as_batches(rows, size):
    cols = [np.array(c) for c in zip(*rows, strict=True)]
    for i in range(0, len(rows), size):
        h1, h2, doc, tx, pos = (c[i : i + size] for c in cols)
        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(doc), pa.array(tx), pa.array(pos.astype(np.int32))], list(line_dedup._COLS))


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [2, 3])
@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_batches_of_any_size(size, min_docs, keep_first):
    """Lines, documents and copies of a row may go on over any number of batches."""
    rnd = random.Random(size)
    rows = sorted((rnd.randint(0, 5), 0, rnd.randint(0, 3), 9, p) for p in [rnd.randint(0, 90) for _ in range(60)])
    rows = sorted(rows + rows[:9] * 3)
    want = set()
    for h in range(6):
        mine = [r for r in rows if r[0] == h]
        if len({r[2] for r in mine}) >= min_docs:
            want |= {r[2:] for r in mine if not keep_first or r != mine[0]}
    got = {(r["doc_id"], r["tx"], r["pos"]) for b in line_dedup._dropped(rows_as_batches(rows, size), 0, min_docs, keep_first, {}) for r in b.to_pylist()}
    assert got == want


def test_a_line_five_million_times_in_one_document_is_held_as_bits():
    n, step = 5_000_000, 10_000

    def batches():
        for i in range(0, n + step, step):
            doc = np.full(step, 1 if i < n else 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(step, 7)), pa.array(np.full(step, 7)), pa.array(doc), pa.array(doc), pa.array(np.arange(i, i + step, dtype=np.int32))], list(line_dedup._COLS))

    for min_docs, want in ((2, n + step), (3, 0)):
        tracemalloc.start()
        got, before = 0, 0
        for b in line_dedup._dropped(batches(), 0, min_docs, False, {}):
            before = before or (tracemalloc.get_traced_memory()[1] if len(b) else 0)  # the most until rows come out
            got += len(b)
        held = tracemalloc.get_traced_memory()[1] if not want else before
        tracemalloc.stop()
        assert got == want and held < 8 << 20
