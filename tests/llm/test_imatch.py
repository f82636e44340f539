import hashlib
import random
import struct
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from framequarry.llm import imatch, neighbours
from framequarry.llm.queries import op6_imatch

VOCAB = [f"term{i}" for i in range(2000)]


def case():
    rnd = random.Random(2)
    rows = [(rnd.randint(-1000, 1000) * 7 + i, " ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 300)))) for i in range(200)]
    rows = list(dict(rows).items())
    return rows + [(90001, None), (90002, ""), (90003, "é"), (90004, "\U0001f600 abc def ghi"), (90005, rows[0][1]), (90006, " ".join(VOCAB * 20))]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_terms(text):
    return list(dict.fromkeys(signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.findall(r"[\p{L}\p{N}]+", text.lower())))


def brute_lexicon(texts):
    df = Counter(s for t in texts for s in {h & (1 << 20) - 1 for h in brute_terms(t)})
    return {s for s, n in df.items() if 0.002 * len(texts) <= n <= max(1, int(0.2 * len(texts)))}


def brute_hash(terms):
    acc = 42
    for h in terms:
        acc = xxhash.xxh64_intdigest(struct.pack("<q", h), acc)
    return acc >> 32 | 1 if terms else 0


def brute_fingerprint(text, lexicon):
    kept = sorted(h for h in brute_terms(text) if h & (1 << 20) - 1 in lexicon)
    out = [brute_hash(kept)]
    for j in range(12):
        part = kept
        for rate in (4, 16, 64, 256):
            part = [h for h in part if (h >> 20 + 3 * j) % rate == 0]
            out.append(brute_hash(part))
    return out


def brute_likeness(a, b):
    used = [(x == y, i % 4) for i, (x, y) in enumerate(zip(a[1:], b[1:], strict=True)) if x or y]
    rates = [[same for same, rate in used if rate == k] for k in range(4)]
    if best := [sum(x) / len(x) for x in rates if 2 * len(x) >= 12]:
        return max(best)
    whole = [x == y for x, y in zip(a, b, strict=True) if x or y]
    return sum(whole) / len(whole) if whole else 1.0


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, next_text string, bucket int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")


def test_contract(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours.with_next, "__defaults__", (5000,))  # many buckets
    rows = case()
    write(spark, tmp_path, rows)
    df = op6_imatch(spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
    got = {r.doc_id: r for r in df.collect()}
    order = sorted((d, t or "") for d, t in rows)
    by_text, words = {}, brute_lexicon([t for _, t in order])
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[1][:k]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        mine, its, next_ = (brute_fingerprint(x, words) for x in (t, edited, nxt[1]))
        assert (got[d].fingerprint, got[d].edited_fingerprint) == tuple("".join(f"{x:08x}" for x in f) for f in (mine, its))
        assert abs(got[d].near_edited - brute_likeness(mine, its)) < 1e-12 and abs(got[d].near_next - brute_likeness(mine, next_)) < 1e-12
        if edited == t:
            assert got[d].near_edited == 1.0 and got[d].edited_fingerprint == got[d].fingerprint
        if nxt[1] == t:
            assert got[d].near_next == 1.0
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert len(set(by_text.values())) > 150
    mean = lambda k: sum(getattr(r, k) for r in got.values()) / len(got)
    assert mean("near_edited") > 0.2 > mean("near_next")


def test_fingerprint_is_of_the_band(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} only{i}") for i in range(40)], "doc_id long, text string")
    table = imatch.lexicon(docs)
    out = spark.createDataFrame([("word1 only1",), ("common word1 only1",), ("ONLY1, word1 word1",), ("common",), (None,)], "text string")
    got = [r[0] for r in out.select(imatch.fingerprint(F.col("text"), table)).collect()]
    assert got[0] == got[1] == got[2] != got[3] == got[4] and set(got[3]) == {0}


def test_next_with_nulls_ties_and_one_row(spark):
    rows = [(None, "b"), (None, "a"), (3, "x"), (3, "x"), (4, "y")]
    df = neighbours.with_next(spark.createDataFrame(rows, "doc_id long, text string"), {"n": F.length("text")}, bucket_chars=1)
    got = df.collect()
    assert len(got) == 5 and sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    assert [r.next_text for r in got if r.doc_id == 4][0] in "ab" and sorted(r.next_text for r in got if r.doc_id == 3) == ["x", "y"]
    one = neighbours.with_next(spark.createDataFrame([(1, "q")], "doc_id long, text string"), {})
    assert [tuple(r) for r in one.collect()] == [(1, "q", "q")]
    none = neighbours.with_next(spark.createDataFrame([], "doc_id long, text string"), {})
    assert none.count() == 0


def test_next_where_ids_are_null_or_equal(spark):
    """Null ids, and one id on a third of the rows, fill buckets of their own, many of them; the order over them is one."""
    rows = [(None, f"n{i}") for i in range(150)] + [(7, f"s{i}") for i in range(150)] + [(7, "same")] * 9 + [(i, f"t{i}") for i in range(8, 158)] + [(-3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    df = neighbours.with_next(docs, {}, bucket_chars=400)
    assert sorted(tuple(r) for r in df.where("doc_id is not null").collect()) == sorted((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order) if r[0] is not None)
    assert sorted(r[1:] for r in df.where("doc_id is null").collect()) == sorted((r[1], order[i + 1][1]) for i, r in enumerate(order) if r[0] is None)
