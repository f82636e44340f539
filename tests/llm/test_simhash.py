import random

import pytest
import xxhash

from framequarry.llm import components, simhash
from framequarry.llm.queries import op4_simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def texts():
    rnd = random.Random(5)
    vocab = [f"word{i}" for i in range(300)]
    out = [None, "", " \t", "one", "One TWO", "É é  x y", "a b c"]
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(50, 400))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
        out += [" ".join(base), "\n".join(base).upper()]
    return out


def test_contract(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, root int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_simhash(spark, str(tmp_path)).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i, _ in rows] == brute_components(fps)


def test_links_find_every_pair(spark):
    rnd = random.Random(9)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for n in (1, 2, 3, 4):
            g = f
            for b in rnd.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {frozenset(r) for r in simhash.links(df).collect()}
    assert got == want and len(want) > 100
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 6), (300, -5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: -5, -5: -5}


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "e f g h i")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(0, 5), (0, None), (5, 5), (5, 5)]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
