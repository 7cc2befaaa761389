import zlib

import numpy as np
import pytest

from cubeloom.llm import quality, toxicity
from cubeloom.llm._common import read


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def accuracy(spark, frame, labels, target):
    got = frame.join(labels, "doc_id").where("held_out").toPandas()
    return (got["predicted"] == got[target]).mean(), len(got)


@pytest.mark.parametrize("run,target", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_accuracy(spark, run, target):
    sf = "/root/testdata/sf0.1"
    out = run(read(spark, sf, "documents"), read(spark, sf, "labels"))
    right, n = accuracy(spark, out, read(spark, sf, "labels"), target)
    assert n > 1000 and right > 0.97


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_every_row_is_scored(spark, run):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "some idiot text", 0.5), (4, "word " * 200_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = run(docs, labels).collect()
    assert len(rows) == 5
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] in (0, 1) for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] == 1} == {held_out(1)}
    assert run(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"{'zap' if i % 2 else 'calm'} word{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, (i % 2) ^ held_out(i)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert np.mean([got[i] == i % 2 for i in range(200)]) > 0.95


def test_repeated_words_are_one_feature():
    a, _ = quality.vector("ha ha ha", 20)
    b, _ = quality.vector("ho ho ho", 20)
    assert len(set(a) & set(b)) == 1


def sample(n, seed):
    import random

    draw = random.Random(seed)
    say = lambda y: " ".join(draw.choice(["calm", "plain", "river", "stone", "paper"] if not y or draw.random() < 0.6 else ["idiot", "vile", "scum", "rot"]) + draw.choice(["", "s", ","]) for _ in range(draw.randint(0, 30)))
    y = np.array([float(draw.random() < 0.4) for _ in range(n)])
    return [say(v) for v in y], y


def test_quality_fit_equals_a_plain_loop():
    """FTRL-proximal coordinate by coordinate."""
    texts, y = sample(80, 1)
    alpha, beta, l1, l2, bits = 1.0, 1.0, 0.02, 0.05, 12
    got = quality.fit(texts, y, bits=bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=3)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    draw = np.random.default_rng(5)
    for _ in range(3):
        for k in draw.permutation(len(texts)):
            ids, values = quality.vector(texts[k], bits)
            row = [*zip(ids.tolist(), values.tolist(), strict=True), ("one", 1.0)]
            w = {i: weight(i) for i, _ in row}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in row)))
            for i, v in row:
                g = (p - y[k]) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    assert abs(got.intercept - weight("one")) < 1e-9
    assert np.allclose([got.weight[i] for i in z if i != "one"], [weight(i) for i in z if i != "one"], atol=1e-6)
    assert np.count_nonzero(got.weight) == sum(weight(i) != 0 for i in z if i != "one")


def test_toxicity_fit_equals_a_plain_loop():
    """Log-count ratios and the regularised logistic loss, feature by feature."""
    texts, y = sample(60, 2)
    bits, l2, rounds = 14, 0.01, 40
    got = toxicity.fit(texts, y, bits=bits, l2=l2, rounds=rounds, min_df=2, keep=0.3)
    rows = [{g for w in set(toxicity.WORD.findall(t.lower())) for g in toxicity.ngrams(w, bits)} for t in texts]
    df = {}
    for r, v in zip(rows, y, strict=True):
        for g in r:
            df.setdefault(g, [0, 0])[int(v)] += 1
    size = [sum(y == 0), sum(y == 1)]
    ratio = {g: np.log((c[1] + 1) / (size[1] + 2)) - np.log((c[0] + 1) / (size[0] + 2)) for g, c in df.items() if sum(c) >= 2}
    ratio = {g: r for g, r in ratio.items() if abs(r) >= 0.3}
    rows = [sorted(r & ratio.keys()) for r in rows]
    norms = [sum(ratio[g] ** 2 for g in r) for r in rows]
    step = len(y) ** 0.5 / (0.25 * np.percentile(norms, 95) + l2 + 1.0)
    w, b, k = dict.fromkeys(ratio, 0.0), 0.0, 1.0
    wv, bv = dict(w), b
    for _ in range(rounds):
        gw, gb = {g: l2 / len(y) * wv[g] for g in ratio}, 0.0
        for r, v in zip(rows, y, strict=True):
            e = (1 / (1 + np.exp(-(bv + sum(ratio[g] * wv[g] for g in r)))) - v) / len(y)
            gb += e
            for g in r:
                gw[g] += e * ratio[g]
        w2, b2, k2 = {g: wv[g] - step * gw[g] for g in ratio}, bv - step * gb, (1 + (1 + 4 * k * k) ** 0.5) / 2
        wv, bv = {g: w2[g] + (k - 1) / k2 * (w2[g] - w[g]) for g in ratio}, b2 + (k - 1) / k2 * (b2 - b)
        w, b, k = w2, b2, k2
    assert len(ratio) > 20 and abs(got.intercept - b) < 1e-5
    want = {g: w[g] * ratio[g] for g in ratio if abs(w[g] * ratio[g]) > 1e-4}
    assert want.keys() == got.weight.keys() and all(abs(got.weight[g] - x) < 1e-5 for g, x in want.items())


def test_sample_is_bounded(spark):
    from cubeloom.llm._common import labelled_sample

    docs = spark.createDataFrame([(i % 50, f"text {i}" if i else "x" * 1000) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic", 10, 1, 100)
    assert len(texts) <= 20 and max(map(len, texts)) <= 100 and set(y) == {0.0, 1.0}
