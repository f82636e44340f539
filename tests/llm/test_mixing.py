import random

import pytest

from framequarry.llm import mixing
from framequarry.llm.queries import op9_mixing


def brute_targets(size):
    """size: by source; reshare until no target is above three times its source."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 3 * size[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        capped |= {s: 3.0 * size[s] for s in over}


def case(n=400):
    rnd = random.Random(4)
    names = ["a", "b", "B", "é", "zz", None, ""]
    rows = [(i, " ".join(["w"] * rnd.choice([1, 5, 30, 200])), rnd.choice(names) if i % 3 else "hot") for i in range(n)]
    return rows + [(9000, None, "empty"), (9001, " \n", "a"), (None, "x y z", "a"), (None, "x y z", "a"), (9002, "w " * 30000, "b")]


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_against_brute_force(spark, tmp_path, monkeypatch, block):
    if block:
        monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
        monkeypatch.setattr(mixing, "SLOTS", 1)
    rows = case()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, src int, size int").repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    of = {d: s for d, _, s in rows if d is not None} | {None: "a"}
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[of[r.doc_id]]
        assert r.target == pytest.approx(want[of[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(8 * (block or 1), 0.002 * want[s]), s
    again = sorted((str(r.doc_id), r.size, r.taken) for r in op9_mixing(spark, str(tmp_path)).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_pieces_are_equal_blocks_and_lie_in_their_documents(spark):
    docs = spark.createDataFrame(case(), "doc_id long, text string, source string")
    _, pieces = mixing.schedule(mixing.sizes(docs), 10)
    per = {}
    for p in pieces.collect():
        assert 0 <= p.from_word and p.from_word + p.n_words <= p.size and p.n_words > 0
        per[p.slot] = per.get(p.slot, 0) + p.n_words
    assert set(per.values()) <= set(range(1, 11)) and sum(v == 10 for v in per.values()) > 0.98 * len(per)


def test_every_stretch_is_near_the_mix(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    _, pieces = mixing.schedule(mixing.sizes(docs), 10)
    rows = pieces.select("slot", "src").distinct().collect()
    share = {0: 1 / 7, 1: 2 / 7, 2: 3 / 7, 3: 1 / 7}
    for begin in range(0, 2000, 200):
        part = [r.src for r in rows if begin <= r.slot < begin + 200]
        assert all(abs(part.count(s) - 200 * p) < 6 for s, p in share.items())


def test_small_and_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None)], schema)).collect()] == [0]
    assert [(r.target, r.taken) for r in mixing.mix(spark.createDataFrame([(1, "a b c", None)], schema)).collect()] == [(3.0, 3)]


def test_a_tiny_source_beside_a_large_corpus(spark):
    """Blocks are far longer than what a small source gives; each source ends at its target all the same."""
    rows = [(i, "w " * 500, "a" if i % 2 else "z") for i in range(400)] + [(1000 + i, "x " * 10, f"m{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    want = brute_targets({"a": 100_000, "z": 100_000} | {f"m{i}": 10 for i in range(12)})
    of = {d: s for d, _, s in rows}
    for block in (None, 300, 4096):
        taken = dict.fromkeys(want, 0)
        for r in mixing.mix(docs, block_words=block).collect():
            taken[of[r.doc_id]] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want), block
