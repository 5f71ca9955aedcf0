import random

import numpy as np

from orrery.llm import toxicity

BAD = ["zorf", "grumk", "blatz"]


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(30, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out(spark):
    rows = corpus(900, 5)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows if a % 2], "doc_id long, toxic int")
    # Ids that are odd are never toxic here, so half of the toxic ones get labels too.
    labels = labels.union(spark.createDataFrame([(a, y) for a, _, y in rows if a % 12 == 0], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    assert np.all(np.diff(model.theta) >= 0)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == len(rows)
    wrong = [a for a, _, y in rows if found[a]["is_toxic"] != bool(y)]
    assert len(wrong) <= 9
    clean = np.mean([found[a]["severity"] for a, _, y in rows if not y])
    assert np.mean([found[a]["severity"] for a, _, y in rows if y]) > clean + 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "zorf zorf", "z"), (2, "", "y")], "doc_id long, text string, severity string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.flag(docs, none)
    assert got.count() == 4 and got.filter("is_toxic or severity > 0").count() == 0
    rows = corpus(120, 6)
    labels = spark.createDataFrame([(a, y) for a, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    known = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    model = toxicity.train(known, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r["severity"] <= toxicity.GRADES for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ordinal_matches_brute_force():
    model = toxicity.Ordinal({"wbad": 2.0}, np.array([1.0, 2.0, 4.0]), fitted=True)
    eta = np.array([0.0, 2.0])
    want = [[1 / (1 + np.exp(t - e)) for t in (1.0, 2.0, 4.0)] for e in eta]
    assert np.allclose(model.exceed(eta), want)


def test_cut():
    p = np.array([0.9, 0.8, 0.7, 0.2, 0.1])
    toxic = np.array([True, True, False, False, False])
    assert 0.7 < toxicity.best_cut(p, toxic) < 0.8


def likelihood(w, theta, x, grade, weight):
    total = 0.0
    for d, g, own in zip(x, grade, weight, strict=True):
        eta = sum(w[c] * v for c, v in d.items())
        at = [0.0, *(1 / (1 + np.exp(eta - t)) for t in theta), 1.0]
        total -= own * np.log(at[g + 1] - at[g])
    return total


def test_slopes_against_differences():
    rng = np.random.default_rng(3)
    eta, theta = rng.normal(size=40) * 2, np.array([-0.5, 0.7, 1.9])
    grade, weight = rng.integers(0, 4, 40), rng.random(40)
    value, by_eta, by_theta = toxicity.loss_and_slopes(eta, theta, grade, weight)
    plain = likelihood({0: 1.0}, theta, [{0: e} for e in eta], grade, weight)
    assert np.isclose(value, plain)
    for i in range(40):
        step = np.zeros(40)
        step[i] = 1e-6
        d = (toxicity.loss_and_slopes(eta + step, theta, grade, weight)[0] - toxicity.loss_and_slopes(eta - step, theta, grade, weight)[0]) / 2e-6
        assert np.isclose(d, by_eta[i], atol=1e-6)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        d = (toxicity.loss_and_slopes(eta, theta + step, grade, weight)[0] - toxicity.loss_and_slopes(eta, theta - step, grade, weight)[0]) / 2e-6
        assert np.isclose(d, by_theta[k], atol=1e-6)


def test_fit_against_a_grid():
    # One feature, no penalty to speak of: no point of a grid around the result is better.
    rng = np.random.default_rng(4)
    value = rng.integers(0, 6, 300)
    grade = np.minimum(3, np.maximum(0, np.rint(value * 0.8 + rng.logistic(size=300) - 1))).astype(int)
    x = [{0: int(v)} for v in value]
    rows, vals = np.arange(300), value.astype(float)
    weight = np.full(300, 1 / 300)
    w, theta = toxicity._minimise((rows, np.zeros(300, int), vals), grade, weight, 1, 0.0, 0.0, 2000)
    best = likelihood(w, theta, x, grade, weight)
    assert np.all(np.diff(theta) > 0)
    for dw in (-0.1, 0, 0.1):
        for d in np.ndindex(3, 3, 3):
            assert likelihood(w + dw, theta + (np.array(d) - 1) * 0.1, x, grade, weight) >= best - 2e-3
    # Thresholds drawn apart, the weight shared: a wrong order can't come out.
    assert likelihood(w, theta, x, grade, weight) < likelihood(w * 0, theta, x, grade, weight)


def test_very_long_text(spark):
    rows = corpus(300, 9)
    long = " ".join(["plain words of no harm"] * 60_000)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(1000, long), (1001, long + " zorf grumk blatz zorf")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.flag(docs, labels).collect()}
    assert not got[1000]["is_toxic"] and got[1001]["severity"] > got[1000]["severity"]
