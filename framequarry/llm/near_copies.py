"""Near copies: several SimHash fingerprints of word shingles find the pairs to compare, exact Jaccard similarity links them.

One 64-bit SimHash of two texts at similarity 0.8 differs in about 10 bits and at times in 20, which
no ball around its segments reaches.  So each text has FINGERPRINTS of them, from as many hashes of its
shingles, and each is entered by its four 16-bit segments (multi-index hashing, with more tables in
place of balls).  At 0.8 a bit differs with a chance of 0.15, a segment agrees with one of 0.07, and
all SEGMENTS fail with one of 7 in 100,000; more similar texts agree more surely.  Texts in a
bucket are matched on CHECKS more fingerprints within RADIUS bits (missed at 0.8: 5 in a
million, let through though unlike: 4 in a million), and what is left is verified on whole shingle sets.

A bucket is read in order of its key, so its rows pass one task in a stream.  In a bucket of up to
FEW texts all pairs are matched.  In a larger one, or one with over MANY near pairs a text, each text is
matched with leaders alone, the first text within RADIUS; after these links are verified, pairs of different
components are matched, on all fingerprints: in their buckets, or, where their buckets hold nearly the same texts over
and over, by pairs of a few blocks of all texts that are left, so that a text moves once a block and not once a bucket.  So a large group costs a row a member, and pairs inside a
component, which change nothing, are left out, as are buckets that have become one component.

Pairs leave the task that finds them as lists, a row a text and not a row a pair, and are verified in groups that share texts: those whose lower text has one
smallest neighbour, cut into blocks by size.  A text moves once a group that compares it, not once a
pair, and as text, which is smaller on disk than its hashes.  Inside a group a pair that is joined
already is skipped; before its texts are read its sizes must allow the similarity, and all FINGERPRINTS
must lie within FINE_RADIUS bits (at 0.8: 310 in the mean, deviation 16), unless a set is SMALL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, released
from .components import components
from .simhash import majority

WORDS = 5
THRESHOLD = 0.8
#: 64-bit fingerprints that are cut into segments, and those that a pair of a bucket is matched on.
FINGERPRINTS, CHECKS = 32, 2
SEGMENTS = FINGERPRINTS * 4
#: Bits of the CHECKS fingerprints in which texts of a pair differ at most.
RADIUS = 38
#: Texts of a bucket whose pairs are all matched at once.
FEW = 512
#: Near pairs a text of a bucket that are all named.
MANY = 2
#: Blocks of the texts that the second pass compares, where that costs less than their buckets do: a text moves so often at most.
BLOCKS = 8
#: Ordered pairs of texts that are compared at about the cost of a row that moves.
MET = 512
#: Bits of the FINGERPRINTS in which a pair differs at most whose texts are read, and the least set that they tell of.
FINE_RADIUS, SMALL = 400, 32
#: Words of shingle hashes that are counted at once.
CHUNK = 1 << 17
#: Shingles that texts of a block of a group have in all, more or less, and those that a text counts for at least.
BLOCK, LIGHT = 1 << 20, 1 << 10
#: Pairs that are gathered to lists at once, and lists that are read at once.
GATHERED, LISTS = 1 << 18, 1 << 11
#: log2 of the bits of the table that tells which texts are to be compared; rows that it lets through besides cost room alone.
WANTED = 25

_RANDOM = np.random.Generator(np.random.PCG64(20))
_TIMES = _RANDOM.integers(0, 1 << 64, FINGERPRINTS + CHECKS, np.uint64, False) | np.uint64(1)
_HALF = np.uint64(32)


def shingles(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """The hash of the text in normal form (ASCII lower case, single spaces) and the sorted distinct hashes of its word shingles; shorter texts are one shingle, blank ones the empty one."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    whole = b" ".join(parts)
    if len(parts) <= words:
        found = [digest(whole, 42)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        found = [digest(whole[b : e - 1], 42) for b, e in zip([0, *ends[:-words].tolist()], ends[words - 1 :].tolist(), strict=True)]
    return digest(whole, 7), np.unique(np.array(found, np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """FINGERPRINTS + CHECKS SimHashes, a row a set of shingle hashes."""
    wide = FINGERPRINTS + CHECKS
    out = np.zeros((len(sets), wide), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")

    at = 0
    while at < len(order):
        # Sets of like size side by side; shorter ones are filled up with zeros, which set no bit.
        upto = at + 1
        while upto < len(order) and sizes[order[upto]] * wide * (upto + 1 - at) <= CHUNK and sizes[order[upto]] <= 16 + sizes[order[at]] * 5 // 4:
            upto += 1
        own = order[at:upto]
        most, step = int(sizes[own[-1]]), max(1, CHUNK // wide)

        def parts(own=own, most=most, step=step) -> Iterator[np.ndarray]:
            for low in range(0, most, step):
                n = min(step, most - low)
                rows = np.zeros((n, len(own), wide), np.uint64)
                for k, i in enumerate(own):
                    held = sets[i][low : low + n, None]
                    np.multiply(held, _TIMES, out=rows[: len(held), k])
                rows ^= rows >> _HALF
                yield rows

        out[own] = majority(parts(), sizes[own][:, None])
        at = upto
    return out


def _quarters(found: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words as rows of 16-bit words, lowest first."""
    return np.ascontiguousarray(found.astype("<u8")).view("<u2")


def _segments(found: np.ndarray) -> np.ndarray:
    """The keys of rows of fingerprints: which segment it is, then its bits."""
    return _quarters(found[:, :FINGERPRINTS]).astype(np.int32) + (np.arange(SEGMENTS, dtype=np.int32) << 16)


def bands(found: np.ndarray) -> np.ndarray:
    """The SEGMENTS keys of a set of shingle hashes."""
    return _segments(fingerprints([found]))[0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                both = [shingles(t.as_py(), words) for t in b.column(2)]
                found = fingerprints([s for _, s in both])
                flat = pa.array(_signed(np.ascontiguousarray(found[:, :FINGERPRINTS])).ravel())
                fps = pa.ListArray.from_arrays(pa.array(np.arange(len(both) + 1, dtype=np.int32) * FINGERPRINTS), flat)
                node, size = pa.array(_signed(np.array([n for n, _ in both], np.uint64))), pa.array([len(s) for _, s in both], pa.int64())
                checks = [pa.array(_signed(np.ascontiguousarray(found[:, FINGERPRINTS + k]))) for k in range(CHECKS)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, size, fps, *checks], ["doc_id", "tx", "node", "size", "fps", *_CHECKS])

    return run


_CHECKS = [f"check{k}" for k in range(CHECKS)]
_SKETCH = f"doc_id long, tx long, node long, size long, fps array<long>, {', '.join(f'{c} long' for c in _CHECKS)}"


def entries(rows: DataFrame) -> DataFrame:
    """key, node and checks: each row (node, fps, checks) by its SEGMENTS keys."""
    each = rows.select("node", *_CHECKS, F.posexplode("fps").alias("i", "fp"))
    keys = (((F.col("i") * 4 + k) * (1 << 16)).bitwiseOR(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")) for k in range(4))
    return each.select("node", *_CHECKS, F.explode(F.array(*keys)).alias("key"))


def _needed(size_a, size_b, threshold: float):
    """Shingles that two sets of these sizes have in common at the threshold."""
    return np.ceil((size_a + size_b) * (threshold / (1 + threshold)) - 1e-9)


def _allowed(size_a, prints_a, size_b, prints_b, threshold: float):
    """Whether the sizes and all fingerprints of two sets allow the threshold."""
    least = np.minimum(size_a, size_b)
    apart = np.bitwise_count(prints_a ^ prints_b).sum(-1, dtype=np.int64)
    return (least >= _needed(size_a, size_b, threshold)) & ((least < SMALL) | (apart <= FINE_RADIUS))


def _links(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """u, v of rows (g, a, b, u, vs, size, fps, text) in order: the texts of a group (vs null), then its pairs."""
        group, place, texts, sets, above = None, {}, [], {}, []
        sizes: list | np.ndarray = []
        prints: list | np.ndarray = []

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        def held(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(texts[i], words)[1]
            return sets[i]

        for whole in batches:
            for at in range(0, len(whole), 512):
                links: list[tuple[int, int]] = []
                for *own, u, vs, size, fps, text in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns), strict=True):
                    if own != group:
                        group, place, texts, sets, above, sizes, prints = own, {}, [], {}, [], [], []
                    if vs is None:
                        place[u] = len(texts)
                        above.append(len(texts))
                        texts.append(text)
                        sizes.append(size)
                        prints.append(fps)
                        continue
                    if isinstance(sizes, list):
                        sizes, prints = np.array(sizes), np.array(prints, np.int64).view(np.uint64)
                    i, j = place[u], np.array([place[v] for v in vs])
                    need = _needed(sizes[j], sizes[i], threshold)
                    for k in _allowed(sizes[j], prints[j], sizes[i], prints[i], threshold).nonzero()[0].tolist():
                        x, y = top(i), top(int(j[k]))
                        if x != y and len(np.intersect1d(held(i), held(int(j[k])), assume_unique=True)) >= need[k]:
                            above[y] = x
                            links.append((u, vs[k]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["u", "v"])

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16) <= RADIUS


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole buckets of rows in order of their first column: the columns in numpy."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not len(b):
            continue
        new = [c.flatten().to_numpy().reshape(len(b), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        last = int(np.searchsorted(new[0], new[0][-1]))  # where the bucket begins that may go on
        if held and (last or held[0][0][0] != new[0][0]):
            held.append([c[:last] for c in new])
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held = []
        elif last:
            yield tuple(c[:last] for c in new)
        held.append([c[last:] for c in new])
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _pairs_of_few(key: np.ndarray, fp: np.ndarray, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near pairs in buckets, i being places of the rows to match with those behind them."""
    d = 0
    while len(i):
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        hit = i[_near(fp[i], fp[i + d])]
        if len(hit):
            yield hit, hit + d


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, u, v: near pairs of nodes (key null), or v null: a member of a bucket where not all pairs were matched."""
    names = ["key", "u", "v"]

    def rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int32()), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names)

    for key, node, *checks in _buckets(batches):
        fp = np.stack(checks, 1).view(np.uint64)
        begins = np.append(0, (key[1:] != key[:-1]).nonzero()[0] + 1)
        sizes = np.diff(np.append(begins, len(key)))
        both = [*_pairs_of_few(key, fp, np.repeat(sizes <= FEW, sizes).nonzero()[0])]
        u, v = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*both, strict=True)) if both else (np.zeros(0, np.int64),) * 2
        of = np.searchsorted(begins, u, "right") - 1
        dense = np.bincount(of, minlength=len(begins)) > MANY * sizes
        yield rows(node[u[~dense[of]]], node[v[~dense[of]]])
        # Texts that are near no other in the bucket are in no pair of it.
        near_another = np.zeros(len(key), bool)
        near_another[u] = near_another[v] = True
        for k in (dense | (sizes > FEW)).nonzero()[0]:
            i = np.arange(begins[k], begins[k] + sizes[k])
            i = own = i[near_another[i]] if dense[k] else i
            while len(i) > 1:
                near = _near(fp[i[1:]], fp[i[0]])
                hit = i[1:][near]
                yield rows(node[hit], np.full(len(hit), node[i[0]]))
                i = i[1:][~near]
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(node[own]), pa.nulls(len(own), pa.int64())], names)


def _outside(r: np.ndarray, n: np.ndarray, f: np.ndarray, s: np.ndarray, p: np.ndarray, threshold: float, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts outside the commonest root with all that they may reach the threshold with, of another root (and another side), and the first segment that they share; 0, if none."""
    _, kind, many = np.unique(r, return_inverse=True, return_counts=True)
    common = many.argmax()
    for i in (kind != common).nonzero()[0]:
        # A pair of two such texts is met once.
        near = _near(f, f[i]) & (r != r[i]) & ((kind == common) | (n > n[i]))
        j = (near if side is None else near & (side != side[i])).nonzero()[0]
        j = j[_allowed(s[j], p[j], s[i], p[i], threshold)]
        if len(j):
            yield i, j, (_quarters(p[j] ^ p[i]) == 0).argmax(1)


def _named(n: np.ndarray, i: int, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(n[i], n[j])), pa.array(np.maximum(n[i], n[j]))], ["u", "v"])


def _other_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """u, v: near pairs of different roots that may reach the threshold; in each bucket, texts outside its commonest root against all.

        A pair is named in the first bucket that it shares: where all pairs of that one were matched, it is named already.
        """
        for key, node, root, size, prints, *checks in _buckets(batches):
            fp, prints = np.stack(checks, 1).view(np.uint64), prints.view(np.uint64)
            begins = np.append(0, (key[1:] != key[:-1]).nonzero()[0] + 1).tolist()
            for b, e in zip(begins, [*begins[1:], len(key)], strict=True):
                r, n, f, s, p = (x[b:e] for x in (root, node, fp, size, prints))
                for i, j, segment in _outside(r, n, f, s, p, threshold):
                    j = j[segment == key[b] >> 16]
                    if len(j):
                        yield _named(n, i, j)

    return run


def _block_pairs(threshold: float, mixed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same pairs from rows of a pair of blocks (key; equal for one block with itself), with each text's block: those whose first bucket that they share is in the table of mixed ones."""
        for key, node, root, block, size, prints, *checks in _buckets(batches):
            fp, prints = np.stack(checks, 1).view(np.uint64), prints.view(np.uint64)
            begins = np.append(0, (key[1:] != key[:-1]).nonzero()[0] + 1).tolist()
            for b, e in zip(begins, [*begins[1:], len(key)], strict=True):
                r, n, k, f, s, p = (x[b:e] for x in (root, node, block, fp, size, prints))
                two = key[b] % BLOCKS != key[b] // BLOCKS
                for i, j, segment in _outside(r, n, f, s, p, threshold, k if two else None):
                    quarter = _quarters(p[i : i + 1])[0][segment]
                    j = j[(_quarters(p[j])[np.arange(len(j)), segment] == quarter) & _has(mixed, segment << 16 | quarter)]
                    if len(j):
                        yield _named(n, i, j)

    return run


def _has(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    return (table[key >> 6] >> (key & 63) & 1).astype(bool)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, a, z, n: the least and the largest root of each bucket and its texts, over rows (node, root, keys) of a batch."""
    for b in batches:
        row, key = _ends(b)
        if len(key):
            root = b.column(1).to_numpy()[row]
            order = np.lexsort((root, key))
            key, root = key[order], root[order]
            begins = np.append(0, (key[1:] != key[:-1]).nonzero()[0] + 1)
            ends = np.append(begins[1:], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[begins]), pa.array(root[begins]), pa.array(root[ends - 1]), pa.array(ends - begins)], ["key", "a", "z", "n"])


def _left(mixed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, root, keys) with the keys of mixed buckets alone; without one, none."""
        for b in batches:
            row, key = _ends(b)
            held = _has(mixed, key)
            rows, begins = np.unique(row[held], return_index=True)
            if len(rows):
                keys = pa.ListArray.from_arrays(pa.array(np.append(begins, held.sum()), pa.int32()), pa.array(key[held]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), keys], b.schema.names)

    return run


def _lists(u: np.ndarray, v: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], pa.ListArray]:
    """The distinct keys and u of rows, and the list of the v of each."""
    columns = [*keys, u]
    order = np.lexsort((v, *columns[::-1]))
    columns = [c[order] for c in columns]
    new = np.ones(len(u), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    begins = new.nonzero()[0]
    return [c[begins] for c in columns], pa.ListArray.from_arrays(pa.array(np.append(begins, len(u)), pa.int32()), pa.array(v[order]))


def _listed(named):
    """key, u, vs for the rows (key, u, v) or (u, v) of `named`: those without v as they are (vs null), and the texts of pairs with those that they are named with, on both sides, GATHERED pairs at once."""
    names = ["key", "u", "vs"]

    def lists(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(side) for side in zip(*held, strict=True))
        (ends,), vs = _lists(np.concatenate((u, v)), np.concatenate((v, u)))
        return pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int32()), pa.array(ends), vs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0
        for b in named(batches):
            if b.column("v").null_count:
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("u"), pa.nulls(len(b), pa.list_(pa.int64()))], names)
            elif len(b):
                held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
                many += len(b)
            if many >= GATHERED:
                yield lists(held)
                held, many = [], 0
        if held:
            yield lists(held)

    return run


_LISTED = "key int, u long, vs array<long>"


def _ends(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element of the lists in the last column, and the elements."""
    vs = b.column(b.num_columns - 1)
    return np.repeat(np.arange(len(b)), vs.value_lengths().to_numpy()), vs.flatten().to_numpy()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys and texts of rows (keys, u, vs), LISTS rows at once; a text comes once for all pairs of a key in them."""
    for whole in batches:
        for at in range(0, len(whole), LISTS):
            b = whole.slice(at, LISTS)
            *keys, u = (c.to_numpy() for c in b.columns[:-1])
            row, v = _ends(b)
            columns = [np.concatenate((c, c[row])) for c in keys] + [np.concatenate((u, v))]
            (*columns,), _ = _lists(columns[-1], columns[-1], *columns[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*b.schema.names[:-2], "node"])


def _place(node: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The block of a text in a group of n."""
    return ((node.view(np.uint64) * _TIMES[0] >> _HALF) % n.astype(np.uint64)).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, a, b, u, vs of rows (g, n, u, vs): the list of a text by the blocks of its group, of which there are n."""
    for whole in batches:
        for at in range(0, len(whole), LISTS):
            batch = whole.slice(at, LISTS)
            g, n, u = (c.to_numpy() for c in batch.columns[:-1])
            row, v = _ends(batch)
            a, b = _place(u[row], n[row]), _place(v, n[row])
            columns, vs = _lists(u[row], v, g[row], np.minimum(a, b), np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), vs], ["g", "a", "b", "u", "vs"])


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with all of a key in one task, in its order."""
    return rows.select("key", *columns, *_CHECKS).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "node")


def _grouped(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, a, b, u, vs: the pairs of u with texts above it, in blocks of those whose u has one smallest neighbour; near: u, vs, lists of neighbours on both sides."""
    ends = near.groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs"))
    ends = ends.select(F.least("u", F.array_min("vs")).alias("g"), "u", F.filter("vs", lambda v: v > F.col("u")).alias("vs")).where(F.size("vs") > 0)
    # Lists of a group lie together, so that its texts are told from them without a row a pair.
    ends = cut(ends.repartition(partitions(near.sparkSession), "g").sortWithinPartitions("g"))
    members = ends.mapInArrow(_members, "g long, node long").distinct().join(nodes.select("node", "size"), "node")
    parts = members.groupBy("g").agg(F.ceil(F.sum(F.greatest("size", F.lit(LIGHT))) / BLOCK).alias("n"))
    return cut(ends.join(parts, "g").select("g", "n", "u", "vs").mapInArrow(_blocks, "g long, a int, b int, u long, vs array<long>"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """u, v: links that join all of the pairs (u, v; repeated or not) at the threshold; nodes: node, tx, size, fps; texts: tx, text."""
    return _verified(pairs.select("u", "v").mapInArrow(_listed(iter), _LISTED), nodes, texts, words, threshold)


def _verified(near: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The same for lists of pairs: u, vs, on both sides of a pair."""
    dealt, key = _grouped(near, nodes), ["g", "a", "b"]
    known = nodes.select("node", "tx", "size", "fps")
    members = cut(dealt.mapInArrow(_members, "g long, a int, b int, node long").distinct().join(known, "node"))
    # Only texts that are to be compared are shuffled, and a few whose hash falls on the same bit.
    slot = F.col("tx").bitwiseAND(F.lit((1 << WANTED) - 1))
    at, bit = F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")
    bits = members.select(at, bit).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    held = texts.select("tx", "text", at, bit).join(F.broadcast(bits), "at").where(F.getbit("bits", "bit") == 1).select("tx", "text").dropDuplicates(["tx"])
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = members.join(held, "tx").select(*key, F.col("node").alias("u"), none("vs", "array<long>"), "size", "fps", "text")
    rows = rows.union(dealt.select(*key, "u", "vs", none("size", "long"), none("fps", "array<long>"), none("text", "string")))
    rows = rows.repartition(partitions(near.sparkSession), *key).sortWithinPartitions(*key, F.col("vs").isNotNull())
    return cut(rows.mapInArrow(released(_links(words, threshold)), "u long, v long"))


def links(rows: DataFrame, texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """u, v: verified pairs that join all candidates of rows (node, tx, size, fps, checks; node distinct) at the threshold; texts: tx, text."""
    found = cut(_dealt(entries(rows), "node").mapInArrow(released(_listed(_first_pairs)), _LISTED))
    first = _verified(found.where("vs is not null"), rows, texts, words, threshold)
    members = found.where("vs is null")
    if members.isEmpty():
        return first
    # A text with the keys of the buckets in which it was matched with leaders alone, a row a text.
    members = members.groupBy(F.col("u").alias("node")).agg(F.collect_list("key").alias("keys"))
    roots = cut(members.join(cut(components(first)), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "keys"))
    # Of these buckets those that hold several components yet, as a bit each.
    kinds = roots.mapInArrow(_kinds, "key int, a long, z long, n long").groupBy("key").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n")).where("a < z")
    told = kinds.groupBy(F.shiftright("key", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, key & 63))").alias("bits"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).toArrow()
    mixed = np.zeros(SEGMENTS << 10, np.int64)
    mixed[told["at"].to_numpy()] = told["bits"].to_numpy()
    left = cut(roots.mapInArrow(_left(mixed), "node long, root long, keys array<int>"))
    many = left.count()
    if not many:
        return first
    named = left.join(rows.select("node", "size", "fps", *_CHECKS), "node")
    blocks = min(BLOCKS, -(-many // FEW))
    if many * blocks + many**2 / MET <= sum(told["n"].to_pylist()) + sum(told["pairs"].to_pylist()) / MET:
        # The buckets hold nearly the same texts over and over: blocks of texts meet each other.
        block = F.pmod(F.col("node"), F.lit(blocks)).cast("int")
        pairs = [F.least(block, F.lit(k)) * BLOCKS + F.greatest(block, F.lit(k)) for k in range(blocks)]
        dealt = _dealt(named.select(F.explode(F.array(*pairs)).alias("key"), "node", "root", block.alias("block"), "size", "fps", *_CHECKS), "node", "root", "block", "size", "fps")
        more = dealt.mapInArrow(released(_listed(_block_pairs(threshold, mixed))), _LISTED)
    else:
        dealt = _dealt(named.select(F.explode("keys").alias("key"), "node", "root", "size", "fps", *_CHECKS), "node", "root", "size", "fps")
        more = dealt.mapInArrow(released(_listed(_other_pairs(threshold))), _LISTED)
    return first.union(_verified(more, rows, texts, words, threshold))


def near_copies(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tx (hash of the text), component for each row of docs.

    Rows have one component if a chain of texts joins theirs, each at least threshold similar to
    the next by the Jaccard similarity of their sets of word shingles; segments and radius are made for
    a threshold of 0.8 or more.  Texts that differ in ASCII case and white space alone are equal;
    null and blank texts are one text.  Empty table: no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tx"), F.col(text).alias("text"))
    rows = cut(own.mapInArrow(released(_sketches(words)), _SKETCH))
    nodes = cut(rows.drop("doc_id").dropDuplicates(["node"]))
    roots = cut(components(links(nodes, own.select("tx", "text"), words, threshold)))
    # Rows in a component are found by their text; all others are their own.
    return rows.select("doc_id", "tx", "node").join(roots, "node", "left").select("doc_id", "tx", F.coalesce("root", "node").alias("component"))
