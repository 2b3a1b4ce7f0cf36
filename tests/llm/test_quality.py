import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import quality


def _corpus(n=900):
    rnd, rows, labels = random.Random(12), [], []
    for i in range(n):
        words = ["".join(rnd.choice(["th", "er", "on", "ble", "ing"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 120))]
        kind = i % 9
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w for w in words for _ in range(6)]
        elif kind in (2, 3):
            words[rnd.randrange(len(words))] = rnd.choice(["slur", "insulto"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind > 1), int(kind in (2, 3))))
    return rows, labels


def test_held_out_grades(spark, docs_of):
    rows, labels = _corpus()
    docs, rated = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, rated.where("doc_id % 4 > 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs, model).join(rated, "doc_id").where("doc_id % 4 = 0").collect()
    right = [r.keep == (r.quality == 1 and r.toxic == 0) for r in got]
    assert np.mean(right) > 0.97
    mean = lambda q, t: np.mean([r.expected_grade for r in got if (r.quality, r.toxic) == (q, t)])
    assert mean(0, 0) < mean(1, 1) < mean(1, 0)


def test_edges(spark, docs_of):
    rows, labels = _corpus(300)
    labels += [(None, 1, 0), (10**6, 0, 0), (5, None, None), (5, None, None)]
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs_of(rows + [(5000, None)]), rated)
    odd = docs_of([(1, None), (2, ""), (3, "x" * 500000), (4, "###"), (4, "###"), (None, "a b")]).withColumn("keep", F.lit("mine"))
    got = quality.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert got[3][4:] == got[4][4:] and got[0].tail_probability == got[1].tail_probability
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.learn(docs_of(rows), rated.limit(0))
    assert {r.keep for r in quality.score(docs_of(rows[:5]), none).collect()} == {True}
    for only in ("quality = 1 AND toxic = 0", "quality = 1 AND toxic = 1", "quality = 0"):
        same = quality.learn(docs_of(rows), rated.where(only))
        assert {r.keep for r in quality.score(docs_of(rows[:5]), same).collect()} == {True}, only
    # two grades that nothing tells apart
    alike = quality.learn(docs_of([(i, "same words here") for i in range(60)]), spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    assert {r.keep for r in quality.score(docs_of(rows[:5]), alike).collect()} == {True}


def test_fit_reaches_the_optimum_of_an_independent_likelihood():
    """The penalised likelihood of the fitted model, written anew with plain loops, is not improved by any small step."""
    rnd = np.random.default_rng(4)
    n, width = 240, 4
    x = rnd.integers(0, 2, (n, width))
    latent = x @ np.array([2.0, -1.5, 0.7, 0.0]) + rnd.logistic(size=n)
    grades = np.where(latent < -0.5, 0, np.where(latent < 1.0, 1, 2))
    owner, place = np.nonzero(x)
    weights, thresholds = quality.fit(owner, place, grades, width, penalty=1.0, steps=2000)

    def likelihood(w, t):
        total = -0.5 * float(w @ w)
        for row, g in zip(x, grades, strict=True):
            below = lambda k: 0.0 if k < 0 else 1.0 if k >= 2 else 1 / (1 + np.exp(-(t[k] - row @ w)))  # noqa: B023, E731
            total += np.log(below(g) - below(g - 1))
        return total

    best = likelihood(weights, thresholds)
    assert thresholds[0] < thresholds[1] and weights[0] > 1 and weights[1] < -0.7
    for i in range(width + 2):
        for step in (-0.05, 0.05):
            w, t = weights.copy(), np.array(thresholds, float)
            (w if i < width else t)[i if i < width else i - width] += step
            assert likelihood(w, t) < best + 1e-4


def test_scores_equal_the_formula(docs_of):
    model = quality.Model(np.sort(quality.features(raw := np.frombuffer(b"good bad", np.uint8), np.array([0, len(raw)]))[1]), np.zeros(0), np.array([-1.0, 0.5]))
    model.weights = np.linspace(-1, 1, len(model.hashes))
    for text, r in zip(texts := ["good bad", "bad", "other", ""], quality.score(docs_of(list(enumerate(texts))).coalesce(1), model).orderBy("doc_id").collect(), strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        known = set(quality.features(data, np.array([0, len(data)]))[1].tolist()) if text else set()
        z = sum(w for h, w in zip(model.hashes.tolist(), model.weights.tolist(), strict=True) if h in known)
        if text:
            assert abs(r.tail_probability - (1 - 1 / (1 + np.exp(-(0.5 - z))))) < 1e-9
            assert abs(r.expected_grade - sum(1 - 1 / (1 + np.exp(-(t - z))) for t in (-1.0, 0.5))) < 1e-9


def test_repeated_rows_do_not_swell_the_sample(spark, docs_of):
    rows, labels = _corpus(200)
    many = rows + [(5, f"other text {i}") for i in range(500)]
    rated = spark.createDataFrame(labels + [labels[5]] * 500, "doc_id long, quality int, toxic int")
    kept = []
    plain = quality.written
    quality.written = lambda frame, what: kept.append(plain(frame, what)) or kept[-1]
    try:
        quality.learn(docs_of(many), rated)
    finally:
        quality.written = plain
    assert kept[0].count() == len(rows)


def test_samples_are_bounded_and_reruns_agree(spark, docs_of):
    rows, labels = _corpus(600)
    docs, rated = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = quality.learn(docs, rated, sample=200), quality.learn(docs.repartition(5), rated.repartition(3), sample=200)
    assert (one.hashes == two.hashes).all() and (one.weights == two.weights).all()


def test_features_by_hand():
    data = "Ab ab, x\nx x\nÉé"
    raw = np.frombuffer(data.encode(), np.uint8)
    own, hashes = quality.features(raw, np.array([0, len(raw)]))
    assert set(own.tolist()) == {0}
    other = np.frombuffer(b"aB|ab", np.uint8)
    _, more = quality.features(other, np.array([0, 5]))
    assert hashes[0] == hashes[1] == more[0] == more[2]
