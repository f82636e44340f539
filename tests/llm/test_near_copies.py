import random

import corpus_pipeline
from framequarry.llm import near_copies


def shingle_set(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)} or {" ".join(ws)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_components(texts):
    sets, ids = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if ids[i] != ids[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def groups(of):
    by = {}
    for i, c in of.items():
        by.setdefault(c, set()).add(i)
    return {frozenset(x) for x in by.values()}


def texts():
    """Copies with one to many changed words, chains of edits, and one passage in many texts."""
    rnd = random.Random(15)
    vocab = [f"word{i}" for i in range(500)]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    out, passage = [None, "", " \t", "one", "One TWO", "a b c d e", "A b c d\ne", "a b c d e f"], make(60)
    for _ in range(25):
        base = make(rnd.randint(20, 400))
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(copy) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append(" ".join(copy))
    chain = make(200)
    for i in range(12):
        chain = list(chain)
        chain[10 * i : 10 * i + 3] = make(3)
        out.append(" ".join(chain))
    out += [" ".join(make(20) + passage + make(20)) for _ in range(20)]
    return out


def test_components_against_brute_force(spark):
    rows = list(enumerate(texts()))
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()}
    want = dict(enumerate(brute_components([t for _, t in sorted(rows)])))
    assert groups(got) == groups(want)


def test_every_pair_at_the_threshold_is_a_candidate():
    rnd, met, least = random.Random(2), 0, 1.0
    for _ in range(3000):
        n = rnd.randint(40, 120)
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = a[: -(-8 * n // 9)]
        b += [rnd.getrandbits(64) for _ in range(n - len(b))]
        x, y = (near_copies.np.array(v, near_copies.np.uint64) for v in (a, b))
        least = min(least, similarity(set(a), set(b)))
        met += bool((near_copies.bands(x) == near_copies.bands(y)).any())
    assert met == 3000 and 0.8 <= least < 0.81


def test_the_stage_drops_copies_that_simhash_leaves(spark):
    """Similarity just above 0.8 goes, just below stays."""
    rnd = random.Random(4)
    rows, words = [], 204  # 200 shingles
    for k in range(12):
        base = [f"w{rnd.getrandbits(40)}" for _ in range(words)]
        near, far = list(base), list(base)
        for i in range(4):
            near[20 + 40 * i] = "changed"
        for i in range(5):
            far[20 + 40 * i] = "else"
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far))]
    a, b, c = (shingle_set(t) for _, t in rows[:3])
    assert 0.8 <= similarity(a, b) < 0.83 and similarity(a, c) < 0.8 and similarity(b, c) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(i for i, _ in rows if i % 10 != 1)


def test_survivors_by_component(spark):
    """Null ids, and one id with two texts: each component keeps one row, and no other goes."""
    rnd = random.Random(6)
    text = lambda: " ".join(f"w{rnd.getrandbits(40)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (None, c.upper()), (7, c), (5, d), (5, e), (5, e + " more"), (3, d), (None, f + " x"), (None, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == 6
    for want in ([(None, a)], [(None, b)], [(7, c)], [(3, d)], [(5, e), (5, e + " more")], [(None, f), (None, f + " x")]):
        assert sum(x in want for x in got) == 1, want


def test_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_are_majorities_of_bits():
    rng = near_copies.np.random.default_rng(3)
    np = near_copies.np
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 2, 3, 8, 101, 100, 5000)]
    for s, got in zip(sets, near_copies.fingerprints(sets), strict=True):
        x = s[:, None] * near_copies._TIMES
        x ^= x >> np.uint64(32)
        ones = sum(np.unpackbits(x[i : i + 1].view(np.uint8), bitorder="little").astype(int) for i in range(len(x)))
        assert (np.packbits(ones * 2 > len(s), bitorder="little").view("<u8") == got).all()


def cut_up(columns):
    """The columns as batches that end inside a bucket."""
    pa = near_copies.pa
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [str(k) for k in range(len(columns))])
    return iter([whole.slice(0, 7), whole.slice(7, 20), whole.slice(27)])


def test_large_buckets_lose_no_pair(monkeypatch):
    """Leaders first, then all pairs of different roots; a bucket may lie in several batches."""
    np, pa = near_copies.np, near_copies.pa
    fps = np.zeros((40, 2), np.uint64)
    fps[:, 0] = [(1 << i) - 1 for i in range(0, 60, 3)] + [(1 << 60) - (1 << i) for i in range(0, 60, 3)]
    near = lambda i, j: sum(bin(int(a ^ b)).count("1") for a, b in zip(fps[i], fps[j], strict=True)) <= near_copies.RADIUS
    want = {(i, j) for j in range(40) for i in range(j) if near(i, j)}

    def batches(*more):
        columns = [np.full(40, 5, np.int32), np.arange(40), *more, *(np.ascontiguousarray(c).view(np.int64) for c in fps.T)]
        return cut_up(columns)

    pairs = lambda found: {p for b in found for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True) if p[1] is not None}
    monkeypatch.setattr(near_copies, "MANY", 40)
    assert 40 < len(want) < 780 and pairs(near_copies._first_pairs(batches())) == want
    monkeypatch.setattr(near_copies, "FEW", 4)
    found = list(near_copies._first_pairs(batches()))
    assert pairs(found) < want and sum(b.column("v").null_count for b in found) == 40
    other = near_copies._other_pairs(0.8)
    rest = [np.full(40, 10), [[0] * near_copies.FINGERPRINTS] * 40]
    assert pairs(other(batches(np.arange(40), *rest))) == want
    root = np.arange(40) % 3
    assert pairs(other(batches(root, *rest))) == {(i, j) for i, j in want if root[i] != root[j]}


def test_pairs_that_all_fingerprints_or_sizes_rule_out_are_not_named():
    """Nor are pairs named again that share an earlier bucket; without any of these rules, every pair of different roots is."""
    np = near_copies.np
    rng = np.random.default_rng(5)
    n, wide = 60, near_copies.FINGERPRINTS
    segment = 6
    prints = np.repeat(rng.integers(0, 1 << 64, (3, wide), np.uint64), n // 3, 0)
    flip = rng.random((n, wide, 64)) < rng.uniform(0.02, 0.16, n)[:, None, None]
    prints ^= np.packbits(flip, axis=2, bitorder="little").view("<u8")[:, :, 0]
    prints[:, segment // 4] &= ~np.uint64(0xFFFF << 16 * (segment % 4))  # the bucket's own segment: no bit set
    size, root = rng.integers(28, 60, n), rng.integers(0, 12, n)
    columns = [np.full(n, segment << 16, np.int32), np.arange(n), root, size, prints.view(np.int64).tolist(), *[np.zeros(n, np.int64)] * near_copies.CHECKS]
    got = [p for b in near_copies._other_pairs(0.8)(cut_up(columns)) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]

    def named(i, j):
        apart = [int(a) ^ int(b) for a, b in zip(prints[i], prints[j], strict=True)]
        first = next(k for k in range(near_copies.SEGMENTS) if not apart[k // 4] >> 16 * (k % 4) & 0xFFFF)
        least = min(size[i], size[j])
        fine = least < near_copies.SMALL or sum(x.bit_count() for x in apart) <= near_copies.FINE_RADIUS
        return root[i] != root[j] and first == segment and fine and 9 * least >= 4 * (size[i] + size[j])

    want = [(i, j) for j in range(n) for i in range(j) if named(i, j)]
    assert 10 < len(want) < 1000 and sorted(got) == sorted(want)


def sketched(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as tx", "text")
    return docs, near_copies.cut(docs.mapInArrow(near_copies._sketches(5), near_copies._SKETCH))


def edits(rnd, n, words, changes):
    """Texts with so many changed words of one base."""
    base, out = [f"w{rnd.getrandbits(40)}" for _ in range(words)], []
    for _ in range(n):
        copy = list(base)
        for i in rnd.sample(range(words), changes):
            copy[i] = f"x{rnd.getrandbits(40)}"
        out.append(" ".join(copy))
    return out


def test_entries_are_the_segments(spark):
    docs, rows = sketched(spark, edits(random.Random(1), 3, 50, 2))
    got = {}
    for r in near_copies.entries(rows).collect():
        got.setdefault(r.node, []).append(r.key)
    for r in docs.collect():
        node, found = near_copies.shingles(r.text)
        assert sorted(got[int(near_copies.np.uint64(node).view("i8"))]) == sorted(near_copies.bands(found).tolist())


def test_pairs_of_blocks_are_verified_like_all(spark, monkeypatch):
    """Small blocks lose no link between texts that blocks part."""
    texts = [t for k in range(3) for t in edits(random.Random(k), 12, 100, 1)] + edits(random.Random(9), 12, 100, 3)
    docs, rows = sketched(spark, texts)
    pairs = rows.select(near_copies.F.col("node").alias("u")).crossJoin(rows.select(near_copies.F.col("node").alias("v"))).where("u < v")
    ids = {r.node: r.doc_id for r in rows.collect()}
    for block in (near_copies.BLOCK, near_copies.LIGHT * 5):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        found = {i: i for i in range(len(texts))}
        for r in near_copies.verified(pairs, rows, docs).collect():
            a, b = found[ids[r.u]], found[ids[r.v]]
            found = {i: min(a, b) if c in (a, b) else c for i, c in found.items()}
        assert groups(found) == groups(dict(enumerate(brute_components(texts))))


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_pairs_move_no_text_of_their_own(spark):
    """120 texts that are all candidates of each other but no near copies: 7,140 pairs, which must not cost a set of hashes each."""
    docs, rows = sketched(spark, edits(random.Random(5), 120, 600, 16))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        before = shuffled(spark)
        assert near_copies.links(rows, docs.select("tx", "text")).count() == 0
        assert shuffled(spark) - before < 4_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_a_dense_bucket_names_leaders():
    """Copies in a small bucket cost a row each; the texts that are near none are not met again."""
    np, pa = near_copies.np, near_copies.pa
    rng = np.random.default_rng(1)
    fps = np.concatenate((np.zeros((100, 2), np.uint64), rng.integers(0, 1 << 64, (20, 2), np.uint64)))
    columns = [np.full(120, 5, np.int32), np.arange(120), *(np.ascontiguousarray(c).view(np.int64) for c in fps.T)]
    got = [r for b in near_copies._first_pairs(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list("abcd"))])) for r in b.to_pylist()]
    assert sorted((r["u"], r["v"]) for r in got if r["v"] is not None) == [(0, i) for i in range(1, 100)]
    assert sorted(r["u"] for r in got if r["v"] is None) == list(range(100))


def test_pairs_travel_as_lists(spark, monkeypatch):
    """120 texts that are all candidates of each other: no step of Spark's has a row a pair."""
    docs, rows = sketched(spark, edits(random.Random(5), 120, 600, 16))
    plans, cut = [], near_copies.cut
    monkeypatch.setattr(near_copies, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    near_copies.links(rows, docs.select("tx", "text"))
    assert len(plans) > 5 and "Generate" in "".join(plans)
    assert not any(x in p for p in plans for x in ("explode(vs", "explode(concat"))


def rows_of(batches):
    return [r for b in batches for r in b.to_pylist()]


def test_lists_hold_each_pair_once_and_blocks_its_texts(monkeypatch):
    np, pa = near_copies.np, near_copies.pa
    rng = np.random.default_rng(8)
    u = rng.integers(-50, 49, 900)
    v = u + rng.integers(1, 30, 900)
    pairs = pa.RecordBatch.from_arrays([pa.nulls(900, pa.int32()), pa.array(u), pa.array(v)], ["key", "u", "v"])
    member = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([7]), pa.nulls(1, pa.int64())], ["key", "u", "v"])
    want = {(int(a), int(b)) for a, b in zip(u, v, strict=True)}
    for many in (near_copies.GATHERED, 100):
        monkeypatch.setattr(near_copies, "GATHERED", many)
        found = rows_of(near_copies._listed(iter)(iter([pairs.slice(0, 500), member, pairs.slice(500)])))
        assert [r for r in found if r["vs"] is None] == [{"key": 3, "u": 7, "vs": None}]
        found = [(r["u"], x) for r in found for x in r["vs"] or []]
        assert set(found) == want | {(b, a) for a, b in want}
    lists = {}
    for a, b in sorted(want):
        lists.setdefault(a, []).append(b)
    columns = [[x // 20 for x in lists], [1 + x % 4 for x in (y // 20 for y in lists)], list(lists), list(lists.values())]
    given = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64()))], ["g", "n", "u", "vs"])
    monkeypatch.setattr(near_copies, "LISTS", 7)
    blocks = [*near_copies._blocks(iter([given.slice(2), given.slice(0, 2)]))]
    dealt = rows_of(blocks)
    assert sorted((r["u"], x) for r in dealt for x in r["vs"]) == sorted(want)
    assert all(r["a"] <= r["b"] < 1 + r["g"] % 4 and r["g"] == r["u"] // 20 for r in dealt)
    of = {}
    for r in dealt:
        for x in (r["u"], *r["vs"]):
            of.setdefault((r["g"], x), set()).add((r["a"], r["b"]))
    got = {}
    for r in rows_of(near_copies._members(iter(blocks))):
        got.setdefault((r["g"], r["node"]), set()).add((r["a"], r["b"]))
    assert got == of and len({b for x in of.values() for b in x}) > 4


def test_blocks_name_the_pairs_of_the_buckets():
    """Texts that share many buckets: the pairs of blocks are those of the mixed buckets, each once."""
    np, pa = near_copies.np, near_copies.pa
    rng = np.random.default_rng(11)
    n, wide = 90, near_copies.FINGERPRINTS
    prints = np.repeat(rng.integers(0, 1 << 64, (3, wide), np.uint64), n // 3, 0)
    flip = rng.random((n, wide, 64)) < rng.uniform(0.02, 0.14, n)[:, None, None]
    prints ^= np.packbits(flip, axis=2, bitorder="little").view("<u8")[:, :, 0]
    node, size, root = rng.permutation(n) - 40, rng.integers(28, 60, n), rng.integers(0, 12, n)
    checks = [np.zeros(n, np.int64)] * near_copies.CHECKS
    batch = lambda columns: iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [str(k) for k in range(len(columns))])])
    pairs = lambda found: sorted(p for b in found for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True))
    held = {}
    for i, keys in enumerate(near_copies._segments(prints).tolist()):
        for k in keys:
            held.setdefault(k, []).append(i)
    chosen = sorted(k for k, x in held.items() if len(x) > 1 and k % 3)  # the others stand for buckets whose pairs are all matched
    mixed = np.zeros(near_copies.SEGMENTS << 10, np.int64)
    for k in chosen:
        mixed[k >> 6] |= np.int64(1) << np.int64(k & 63)
    key, i = np.repeat(np.array(chosen, np.int32), [len(held[k]) for k in chosen]), np.concatenate([held[k] for k in chosen])
    want = pairs(near_copies._other_pairs(0.8)(batch([key, node[i], root[i], size[i], prints[i].view(np.int64).tolist(), *(c[i] for c in checks)])))
    assert 50 < len(want) == len(set(want))
    block, most = node % 4, near_copies.BLOCKS
    rows = sorted((a * most + b, i) for a in range(4) for b in range(a, 4) for i in range(n) if block[i] in (a, b))
    key, i = (np.array(c) for c in zip(*rows, strict=True))
    got = near_copies._block_pairs(0.8, mixed)(batch([key, node[i], root[i], block[i], size[i], prints[i].view(np.int64).tolist(), *(c[i] for c in checks)]))
    assert pairs(got) == want


def test_a_text_moves_once_a_block_and_not_once_a_bucket(spark, monkeypatch):
    """Texts of one cloud, whose buckets hold nearly the same ones over and over: neither joins nor the second pass have a row a bucket of a text."""
    texts = edits(random.Random(7), 150, 300, 10) + edits(random.Random(8), 40, 300, 1)
    docs, rows = sketched(spark, texts)
    dealt, deal = [], near_copies._dealt
    monkeypatch.setattr(near_copies, "_dealt", lambda df, *c: dealt.append(df) or deal(df, *c))
    found = near_copies.links(rows, docs.select("tx", "text"))
    assert len(dealt) == 2 and dealt[1].count() <= 8 * len(texts)
    ids, of = {r.node: r.doc_id for r in rows.collect()}, list(range(len(texts)))
    for r in found.collect():
        a, b = of[ids[r.u]], of[ids[r.v]]
        of = [min(a, b) if c in (a, b) else c for c in of]
    assert groups(dict(enumerate(of))) == groups(dict(enumerate(brute_components(texts))))
