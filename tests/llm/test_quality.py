import random

import numpy as np
from pyspark.sql import functions as F

from skeinbase.llm import quality

from .helpers import empty, frame, sentence, texts


def labelled(spark, n=300):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = ". ".join(sentence(rng, 9).capitalize() for _ in range(8))
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", ""]) for w in text.split()) if rng.random() < 0.5 else "again " * 80
        docs.append((i, text))
        labels.append((i, int(good)))
    labels += [(0, None), (None, 1), (1, 7), (5, labels[5][1]), (9999, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.where("quality in (0, 1) and doc_id is not null").collect()}
    scores = {r.id: r.score for r in quality.classify(frame(spark, docs), labels, F.col("id") % 3 != 1).collect()}
    held = [i for i in scores if i % 3 == 1]
    assert len(held) == 100 and sum((scores[i] >= 0.5) == truth[i] for i in held) >= 97


def test_every_row_has_a_score_between_zero_and_one(spark):
    docs, labels = labelled(spark)
    rows = docs + [(i if i is None else i + 5000, t) for i, t in texts(1)]
    found = quality.classify(frame(spark, rows), labels, F.lit(True)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)


def test_without_labels_of_both_classes_scores_are_the_prior(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in quality.classify(frame(spark, docs), labels.limit(0), F.lit(True)).collect()} == {0.5}
    ones = quality.classify(frame(spark, docs), labels.where("quality = 1"), F.lit(True)).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5
    assert quality.classify(empty(spark), labels, F.lit(True)).collect() == []


def test_dropping_keeps_columns(spark):
    docs, labels = labelled(spark)
    kept = quality.drop_rejected(frame(spark, docs), labels)
    assert kept.columns == frame(spark, docs).columns
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len({r.doc_id for r in kept.collect()} & bad) <= 5


def test_density_is_that_of_a_gaussian():
    rng = np.random.RandomState(0)
    x = [rng.normal(size=(400, 3)) @ np.diag([1, 2, 3]), rng.normal(size=(300, 3)) + 1]
    model = quality.fit(np.array([400.0, 300.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), shrinkage=0.0, ridge=0.0)
    at = rng.normal(size=(5, 3))
    density = []
    for a in x:
        c = np.cov(a.T, bias=True)
        d = at - a.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)))
    odds = density[1] - density[0] + np.log(model.prior / (1 - model.prior))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(-odds)))


def test_scores_of_all_rows_against_brute_force(spark):
    """Densities worked out anew, with covariances, solves and determinants of numpy."""
    docs, labels = labelled(spark, 120)
    truth = dict(docs and [(r.doc_id, r.quality) for r in labels.where("quality in (0, 1) and doc_id is not null").collect()])
    rows = docs + [(5000 + k, t) for k, (_, t) in enumerate(texts(2))]
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in rows}
    taught = [(x[i], truth[i]) for i, _ in docs if i % 3 != 1]
    by = [np.array([a for a, y in taught if y == k]) for k in (0, 1)]
    prior = (len(by[1]) + 1) / (len(taught) + 2)
    own = [np.cov(a.T, bias=True) for a in by]
    pooled = sum(len(a) * c for a, c in zip(by, own)) / len(taught)
    size = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    middle = (by[0].mean(0) + by[1].mean(0)) / 2

    def density(at, k):
        c = (1 - quality.SHRINKAGE) * own[k] / np.outer(size, size) + quality.SHRINKAGE * np.diag(np.diag(pooled) / size**2) + quality.RIDGE * np.eye(len(size))
        d = (at - middle) / size - (by[k].mean(0) - middle) / size
        return -0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(c)[1]

    expected = {i: density(at, 1) - density(at, 0) + np.log(prior / (1 - prior)) for i, at in x.items()}
    found = quality.classify(frame(spark, rows), labels, F.col("id") % 3 != 1).collect()
    assert len(found) == len(rows)
    assert all(abs(r.score - 1 / (1 + np.exp(-np.clip(expected[r.id], -500, 500)))) < 1e-5 for r in found)
