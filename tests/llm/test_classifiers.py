import random

import numpy as np
import pytest

from framequarry.llm import language_id, toxicity
from framequarry.llm.queries import op8_toxicity, op10_language_id

LANGS = {"aa": "the of and ing tion", "bb": "der die und ung keit", "cc": "los que ción mente"}
BAD = ["scumbag", "idiotic"]


def corpus(n=400):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(LANGS))
        words = ["".join(rnd.choice(LANGS[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 60))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(bad)))
    return rows, labels


def write(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    odd = [(None, "und die keit der", None, None), (5000, None, "aa", "s"), (5001, "123 !? 456", "bb", "s"), (5002, "", None, "s"), rows[0]]
    write(spark, tmp_path, rows + odd, [*labels, (None, 1), (0, None), (1, labels[1][1]), (7777, 1)])
    langs = {r.doc_id: r for r in op10_language_id(spark, str(tmp_path)).collect()}
    assert len(langs) == len(rows) + 4
    held = [r for r in rows if langs[r[0]].held_out]
    assert len(held) > 50 and all(langs[d].lang_pred == lang for d, _, lang, _ in held)
    assert [langs[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3
    assert langs[None].lang_pred == "bb" and langs[None].held_out is False
    assert all(0 <= r.score <= 1 for r in langs.values())
    tox = {r.doc_id: r for r in op8_toxicity(spark, str(tmp_path)).collect()}
    held = [(d, y) for d, y in labels if tox[d].held_out]
    assert len(held) > 50 and sum(tox[d].predicted == y for d, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in tox.values())


def test_long_text_equals_its_repetition(spark):
    docs = spark.createDataFrame([(1, "und die keit " * 60000, "bb"), (2, "the of and", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got == {1: "bb", 2: "aa"}


def test_more_languages_than_a_block(spark, monkeypatch):
    """Every language is learned, rare ones too, and blocks change nothing."""
    rnd = random.Random(7)
    words = {f"l{k}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for k in range(9)}
    rows = [(100 * k + i, " ".join(rnd.choice(words[x]) for _ in range(20)), x) for k, x in enumerate(words) for i in range(12 - k)]
    rows += [(9000, "12 -", "l0"), (9001, None, "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    for most in (256, 4):
        monkeypatch.setattr(language_id, "MAX_LANGS", most)
        got.append({r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.predict(docs, language_id.fit(docs)).collect()})
        assert all(got[-1][d][0] == x for d, _, x in rows if d < 9000)
        assert got[-1][9000] == got[-1][9001] == ("und", 0.0)
    assert all(abs(got[0][d][1] - got[1][d][1]) < 1e-9 for d in got[0])


def test_nothing_to_learn_from(spark, tmp_path):
    write(spark, tmp_path, [(1, "abc", None, None)], [])
    assert [r.lang_pred for r in op10_language_id(spark, str(tmp_path)).collect()] == ["und"]
    assert [r.predicted for r in op8_toxicity(spark, str(tmp_path)).collect()] == [0]


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert op10_language_id(spark, str(tmp_path)).count() == 0
    assert op8_toxicity(spark, str(tmp_path)).count() == 0


TEXTS = ["abc déf", "xyz", "", "ÀB\n1 c" * 3, "abc déf", "q" * 40]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_grams_are_the_same_wherever_the_text_stands_and_is_cut(size):
    """Against n-grams of each text by itself."""
    from framequarry.llm.ngrams import grams, segments

    clean = [" " + "".join(c if c.isalpha() else " " for c in t.lower()) + "    " for t in TEXTS]
    for n in (1, 2, 3, 4, 5):
        code = lambda x: int(grams(np.array([ord(c) for c in x], np.uint32), n, 20)[0])  # noqa: B023, E731
        want = [sorted(code(c[i : i + n]) for i in range(len(c) - 4)) for c in clean]
        got = [[] for _ in TEXTS]
        for flat, begins, ends, owner in segments(TEXTS, 4, size):
            g = grams(flat, n, 20)
            for s, e, i in zip(begins, ends, owner, strict=True):
                got[i] += g[s:e].tolist()
        assert [sorted(x) for x in got] == want


def test_language_scores_against_plain_python(spark, monkeypatch):
    """Counts, log-probabilities and posteriors by dictionaries of n-grams, hashed as the operator hashes them."""
    import math
    from collections import Counter

    from framequarry.llm.ngrams import grams

    rows, _ = corpus(60)
    docs = spark.createDataFrame([(d, t, x) for d, t, x, _ in rows], "doc_id long, text string, lang string")

    def features(text):
        clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        codes = np.array([ord(c) for c in clean], np.uint32)
        return [(n, int(b)) for n in language_id.ORDERS for b in grams(codes, n, language_id.BITS)[: len(clean) - 2]]

    counts = {x: Counter(f for _, t, y, _ in rows if y == x for f in features(t)) for x in LANGS}
    total = {(x, n): sum(c for (m, _), c in counts[x].items() if m == n) + 0.5 * (1 << language_id.BITS) for x in LANGS for n in language_id.ORDERS}
    prior = Counter(y for _, _, y, _ in rows)
    asked = [t for _, t, _, _ in rows] + ["the und", "mente d", "z"]
    want = []
    for t in asked:
        z = {x: math.log(prior[x] / len(rows)) + sum(math.log((counts[x][f] + 0.5) / total[x, f[0]]) for f in features(t)) for x in LANGS}
        best = max(z, key=z.get)
        want.append((best, 1 / sum(math.exp(v - z[best]) for v in z.values())))
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for gather in (1 << 22, 30):
        monkeypatch.setattr(language_id, "GATHER", gather)
        got = [(r.lang_pred, r.lang_score) for r in language_id.predict(frame, language_id.fit(docs)).orderBy("doc_id").collect()]
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(abs(g[1] - w[1]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_toxicity_against_plain_python(spark):
    """Ratios by dictionaries of n-grams, the fit by another solver's conditions, and scores by hand."""
    import math
    from collections import Counter

    from framequarry.llm.ngrams import grams

    rows, labels = corpus(80)
    learned = [(d, y, t) for (d, t, _, _), (_, y) in zip(rows, labels, strict=True)]

    def features(text):
        clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + "    "
        codes = np.array([ord(c) for c in clean], np.uint32)
        return {int(b) + (k << toxicity.BITS) for k, n in enumerate(toxicity.ORDERS) for b in grams(codes, n, toxicity.BITS)[: len(clean) - 4]}

    has = [features(t) for _, _, t in learned]
    y = [y for _, y, _ in learned]
    pos, neg = sum(y), len(y) - sum(y)
    p, q = (Counter(g for f, z in zip(has, y, strict=True) if z == v for g in f) for v in (1, 0))
    ratio = {g: math.log(((p[g] + 1) / (pos + 2)) / ((q[g] + 1) / (neg + 2))) for g in set(p) | set(q)}
    apart = {g: abs(p[g] / pos - q[g] / neg) / math.sqrt((p[g] + q[g] + 1) / (pos + neg)) for g in ratio}
    model = toxicity.fit(spark.createDataFrame(learned, "doc_id long, toxic int, text string"))
    kept = np.flatnonzero(model.weight)
    assert 0 < len(kept) <= toxicity.SELECT and min(apart[g] for g in kept) >= sorted(apart.values())[-toxicity.SELECT] - 1e-9
    score = [1 / (1 + math.exp(-(model.bias + sum(float(model.weight[g]) for g in f if g in set(kept.tolist()))))) for f in has]
    # At the least penalised loss the gradient of each weight vanishes.
    ridge = toxicity.RIDGE / len(y) * 10
    for g in kept.tolist():
        slope = sum((s - z) * ratio[g] for s, z, f in zip(score, y, has, strict=True) if g in f) / len(y)
        assert abs(slope + ridge * float(model.weight[g]) / ratio[g]) < 2e-3
    assert abs(sum(score) - pos) < 0.05 * len(y)
    frame = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(learned)], "doc_id long, text string")
    got = [r.toxic_score for r in toxicity.score(frame, model).orderBy("doc_id").collect()]
    assert all(abs(a - b) < 1e-5 for a, b in zip(got, score, strict=True))


def test_a_very_long_text_takes_bounded_memory():
    """20 M characters in pieces: the same result as in one, in less memory than its n-grams take."""
    import resource

    text = "und die keit der " * 1_200_000
    block = language_id.Block(("a", "b"), np.zeros(2), np.random.default_rng(0).normal(size=(3 << language_id.BITS, 2)).astype(np.float32))
    short = language_id._predict(["a"], block, [""], np.full(1, -np.inf), np.zeros(1))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    one = language_id._predict([text, "a"], block, ["", ""], np.full(2, -np.inf), np.zeros(2))
    assert one[1][1] == short[1][0] and one[0][1] == short[0][0]
    found = [x for x in toxicity._present([text, "scumbag"]) if len(x)]
    assert len({int(v) for x in found for v in x}) == sum(map(len, found))
    assert {int(v) & 0xFFFFFFFF for x in found for v in x if v >> 32 == 1} == {int(v) for x in toxicity._present(["scumbag"]) for v in x}
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400


def test_one_id_on_many_texts_does_not_grow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 50)
    rows = [(1, f"text {i % 900}") for i in range(2000)] + [(i, f"other {i}") for i in range(2, 30)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)], "doc_id long, toxic int")
    got = [r.toxic for r in toxicity.sample(docs, labels, lambda i: i > 0).collect()]
    assert 15 < sum(got) < 120 and len(got) - sum(got) == 28


def test_scores_follow_the_words(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("nice words here today", 0)] * 30 + [("you scumbag words today", 1)] * 30)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(learned)
    got = [r.toxic_score for r in toxicity.score(learned, model).orderBy("doc_id").collect()]
    assert max(got[:30]) < 0.5 < min(got[30:])
