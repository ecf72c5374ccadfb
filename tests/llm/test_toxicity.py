import math
import random

import numpy as np

from tracklake.llm.toxicity import Features, fit_logistic, fit_toxicity, op1_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def texts(n, seed=1):
    r = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "ti", "en", "al", "st", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(20, 80))], int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["gruxbad", "vilquok", "zznasty"])
        yield i, " ".join(words), toxic


def test_learns_marked_words_and_ignores_other_columns(spark):
    rows = list(texts(600))
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(7, None), (None, 1), (10_000, 1), (8, 5)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "gruxbad " * 50_000)], "doc_id long, text string")
    got = {g.doc_id: g for g in score_toxicity(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows[400:]]) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())
    odd = {g.doc_id: g for g in score_toxicity(more, model).collect()}
    assert odd[-1].score == odd[-2].score < 0.5 < odd[-3].score


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    no = spark.createDataFrame([], "doc_id long, toxic int")
    assert [g.score for g in score_toxicity(docs, fit_toxicity(docs, no)).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert all(g.predicted == 1 for g in score_toxicity(docs, fit_toxicity(docs, ones)).collect())
    assert score_toxicity(docs.limit(0), fit_toxicity(docs, ones)).collect() == []


def test_features_are_distinct():
    f = Features((3, 4), 18)
    x = f.of("aaaa aaaa AAAA")
    assert len(x) == len(set(x.tolist())) and len(f.of(None)) == 0


def test_held_out_rows(spark):
    import zlib

    got = op1_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000 and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    own = [g for g in got if g.held_out and g.doc_id in labels]
    assert np.mean([g.predicted == labels[g.doc_id] for g in own]) > 0.93


def grams(text, sizes, bits):
    """Numbers of the n-grams of a text, in plain Python."""
    t, out, m = f" {' '.join((text or '').lower().split())} ", set(), 2**32 - 1
    for n in sizes:
        for i in range(len(t) - n + 1):
            h = n
            for c in t[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B1 & m
                h ^= h >> 15
            out.add((h * 0x85EBCA77 & m) >> (32 - bits))
    return out


def test_against_brute_force(spark):
    """Document counts, log-count ratios, chosen n-grams and scores, worked out again without Spark and numpy arrays."""
    sizes, bits, kept, least = (3, 4), 16, 300, 3
    rows = [*texts(160, seed=4), (500, None, 0), (501, "", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, sizes=sizes, bits=bits, kept=kept, least=least)
    counts, size = {}, [sum(y == k for *_, y in rows) for k in (0, 1)]
    for _, text, y in rows:
        for f in grams(text, sizes, bits):
            counts.setdefault(f, [0, 0])[y] += 1
    ratio = {f: math.log((c[1] + 1) / (size[1] + 2)) - math.log((c[0] + 1) / (size[0] + 2)) for f, c in counts.items() if sum(c) >= least}
    sure = {f: abs(r) / math.sqrt(1 / (counts[f][1] + 1) + 1 / (counts[f][0] + 1)) for f, r in ratio.items()}
    bar = sorted(sure.values())[-kept]
    used = set(np.flatnonzero(model.weights).tolist())
    assert {f for f, v in sure.items() if v > bar + 1e-9} <= used | {f for f in ratio if not ratio[f]} and all(sure[f] >= bar - 1e-9 for f in used)
    # the regression on these n-grams, of the documents in the order of their ids; calibration multiplies all weights by one slope
    chosen = sorted(used)
    place = {f: k for k, f in enumerate(chosen)}
    x = [np.array([place[f] for f in grams(t, sizes, bits) if f in place], np.int32) for _, t, _ in rows]
    w, _ = fit_logistic(x, np.array([y for *_, y in rows], float), np.ones(len(rows)), np.array([ratio[f] for f in chosen]), 1e-3, 200)
    assert np.corrcoef(w, model.weights[chosen])[0, 1] > 0.999
    for g in score_toxicity(docs, model).collect():
        z = model.bias + sum(float(model.weights[f]) for f in grams(g.text, sizes, bits))
        assert abs(g.score - 1 / (1 + math.exp(-z))) < 1e-6


def test_logistic_regression_reaches_the_optimum():
    r = np.random.default_rng(6)
    x = [np.flatnonzero(r.random(12) < 0.4) for _ in range(120)]
    y, weight, scale = (r.random(120) < 0.4).astype(float), r.uniform(0.5, 2, 120), r.normal(size=12)
    w, bias = fit_logistic(x, y, weight, scale, 0.01, 3000)
    dense = np.zeros((120, 12))
    for i, v in enumerate(x):
        dense[i, v] = scale[v]
    e = weight * (1 / (1 + np.exp(-(dense @ (w / scale) + bias))) - y) / weight.sum()
    assert abs(dense.T @ e + 0.01 * w / scale).max() < 1e-5 and abs(e.sum()) < 1e-5


def test_a_repeated_id_teaches_once(spark):
    from pyspark.sql import functions as F

    rows = list(texts(200))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    copies = [(3, f"{rows[3][1]} v{k}") for k in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows if i != 3] + copies, "doc_id long, text string")
    least = spark.createDataFrame(copies, "doc_id long, text string").orderBy(F.xxhash64("text")).first().text
    once = spark.createDataFrame([(i, least if i == 3 else t) for i, t, _ in rows], "doc_id long, text string")
    a, b = fit_toxicity(docs.repartition(5), labels), fit_toxicity(once, labels)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)
