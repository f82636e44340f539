import math
import random
import re
from collections import Counter

import pytest

from framequarry.llm import lexical_search as ls
from framequarry.llm.queries import op11_lexical_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return PATTERN.findall((t or "").translate(LOWER))


def brute(rows, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // n_terms if n else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def corpus(n=300):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(120)] + ["Été", "ünï", "日本", "a1", "B2", "c_d", "e.f"]
    text = lambda k: " ".join(vocab[min(int(rnd.expovariate(0.05)), len(vocab) - 1)] for _ in range(k))
    items = [(i, text(rnd.randint(1, 15))) for i in range(20)] + [(50, None), (51, " .,-"), (52, "nowhere else"), (None, "w3 w3 W3"), (3, "w1"), (4, "w2 w2"), (4, "w2 w2")]
    rows = [(i, text(rnd.choice([0, 1, 5, 60, 200]))) for i in range(n)]
    rows += [(1000 + i, f"pad {items[i % 5][1]} pad") for i in range(40)] + [(None, "w1 w2"), (None, "w1 w2"), (2000, None), (7, "w1 w1"), (7, "w1 w1")]
    return rows, items


@pytest.mark.parametrize("block,first,size", [(1, 1, 2048), (4, 2, 7), (16, 16, 2048), (10**6, 1, 2048)])
def test_against_brute_force(spark, tmp_path, monkeypatch, block, first, size):
    """For all sizes of blocks, and with queries in several slices."""
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "FIRST_BLOCKS", first)
    monkeypatch.setattr(ls, "SLICE", size)
    rows, items = corpus()
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row int, term string, item int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in op11_lexical_search(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows, items)


def test_blocks_below_the_threshold_are_not_scored(spark, tmp_path, monkeypatch):
    """One query has ten documents that hold all of it; blocks that hold its common word alone are left out."""
    monkeypatch.setattr(ls, "BLOCK", 8)
    scored = []
    whole = ls._scored
    monkeypatch.setattr(ls, "_scored", lambda impacts, asked, chosen, *a: scored.append(chosen.count()) or whole(impacts, asked, chosen, *a))
    rows = [(i, ("common " if i % 3 or i < 12 else "") + ("rare thing here " if i < 12 else "filler ") + f"u{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ls.search(docs, spark.createDataFrame([(1, "rare common thing")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10))
    assert scored[0] == ls.FIRST_BLOCKS and sum(scored) < 30, scored  # of 500 blocks


def test_small_tables_and_long_texts(spark):
    d, i = "doc_id long, text string", "item_id long, text string"
    none, some = spark.createDataFrame([], d), spark.createDataFrame([(1, "a b"), (2, "b")], d)
    for docs, items in ((none, [(1, "a")]), (some, []), (some, [(1, "zzz")]), (spark.createDataFrame([(1, None), (2, "--")], d), [(1, "a")])):
        assert ls.search(docs, spark.createDataFrame(items, i)).count() == 0
    long = spark.createDataFrame([(1, "hot " * 1_000_000 + "x"), (2, "x hot"), (3, "y")], d)
    got = sorted(tuple(r) for r in ls.search(long, spark.createDataFrame([(5, "hot x")], i)).collect())
    assert got == brute([(1, "hot " * 1_000_000 + "x"), (2, "x hot"), (3, "y")], [(5, "hot x")])


def test_plan_is_native_and_gathers_no_rows(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    plan = ls.search(docs, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert "WindowGroupLimit" in plan
