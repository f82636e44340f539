import random
from itertools import permutations

import pytest

from framequarry.llm import filter_audit
from framequarry.llm.queries import op13_filter_audit

BLANK = " \t\n\x0b\x0c\r"


def words(t):
    for c in BLANK[1:]:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def fails(t, doc_id, rows):
    w = words(t)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
        "E": doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows),
    }


def brute(rows, labels):
    """rows: doc_id, text, lang; every document goes through every order of the filters."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    failed = [(d, lang or "", fails(t or "", d, rows)) for d, t, lang in rows]
    out, shares = {}, {}
    for part in {p for _, p, _ in failed}:
        mine = [(d, f) for d, p, f in failed if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [d for d, f in left if f[k]]
                left = [(d, f) for d, f in left if not f[k]]
                shares[part, k] = shares.get((part, k), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[k] for _, f in mine) - len(gone), sum(f[k] and sum(f.values()) == 1 for _, f in mine), sum(d in good for d in gone), sum(d in toxic for d in gone)]
    return sorted((*key, *v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def corpus(n=150):
    rnd = random.Random(3)
    texts = ["", "ONE two", "a # b", *(" ".join(rnd.choice(["x", "Y", "z\tw", "é", f"u{rnd.random()}"]) for _ in range(rnd.choice([3, 199, 200, 201, 400]))) for _ in range(40))]
    texts += [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i % 150}" for i in range(300)), " ".join(f"w{i % 149}" for i in range(300)), "A" * 3 + "b" * 97, "A" * 3 + "b" * 96]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(n)] + [(None, texts[3], "en"), (None, texts[3], "en"), (900, None, "fr"), (901, None, "de"), (5, texts[4], "en"), (5, texts[4], "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame([(*r, True, "x", 1) for r in rows], "doc_id long, text string, lang string, A boolean, part string, mask int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in op13_filter_audit(spark, str(tmp_path)).collect())
    assert got == brute(rows, labels) and len(got) == 4 * 600


def test_shares_add_up_and_equal_the_mean_over_orders():
    rnd = random.Random(1)
    counts = {m: rnd.randrange(50) for m in range(32)}
    p = filter_audit.Removal(counts, 5)
    for s in range(32):
        assert p.corner(s) == sum(n for m, n in counts.items() if m & s)
    assert sum(p.shapley(i) for i in range(5)) == p.corner(31)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(i)])
            total += p.corner(before | 1 << i) - p.corner(before)
        assert p.shapley(i) * 120 == total


def test_empty_and_hot_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.masks(filter_audit.failures(docs, "lang"), labels)).count() == 0
    hot = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) as text", "'en' as lang")
    failed = filter_audit.failures(hot, "lang")
    assert failed.where("E").count() == 2999
    assert "Window" not in failed._jdf.queryExecution().executedPlan().toString()
    top = filter_audit.audit(filter_audit.masks(failed, labels)).where("filter_order = 'EABCD' and step = 1").first()
    assert (top.removed, top.kept, top.unique_fails) == (2999, 6001, 0)


@pytest.mark.parametrize("n", [1_000_000])
def test_a_very_long_text(spark, n):
    docs = spark.createDataFrame([(1, "word " * n, "en")], "doc_id long, text string, lang string")
    r = filter_audit.failures(docs, "lang").first()
    assert (r.A, r.B, r.C, r.D, r.E) == (False, True, False, False, False)
