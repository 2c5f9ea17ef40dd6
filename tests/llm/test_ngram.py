import math
from collections import Counter

import numpy as np
import pytest

from skeinbase.llm import ngram
from skeinbase.llm.common import crc_mod

from .helpers import empty, frame, texts


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def pairs(rows):
    return Counter(p for t in rows for p in zip([b"", *tokens(t)], tokens(t)))


def brute(rows):
    """id -> (tokens, known, N, base score, score), with plain dictionaries."""
    kept = pairs(t for i, t in rows if crc_mod(i, 5) not in (1, 2))
    held = pairs(t for i, t in rows if crc_mod(i, 5) == 2)
    train = kept + held

    def words(counts):
        out = Counter()
        for (_, w), n in counts.items():
            out[w] += n
        return out

    few, c = words(kept), words(train)
    n, v = sum(c.values()), len(c)
    seen = [p for p in held]
    columns = ([f(p) for p in seen] for f in (lambda p: kept[p], lambda p: held[p], lambda p: few[p[0]], lambda p: few[p[1]]))
    lam = ngram.mixture(*ngram.cells(*(np.array(x, np.int64) for x in columns), sum(few.values())), v)

    def log10(u, w):
        a = lam[c[u].bit_length()]
        return math.log10(a[0] / (v + 1) + a[1] * c[w] / n + a[2] * (train[u, w] / c[u] if c[u] else 0))

    def row(t):
        own = tokens(t)
        return len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 5), round(sum(log10(u, w) for u, w in zip([b"", *own], own)), 5)

    return sorted((str(i), *row(t)) for i, t in rows)


@pytest.mark.parametrize("head,common", [(4, 2), (12, 0), (2**20, 2**20), (0, 0)])
def test_scores_against_brute_force(spark, monkeypatch, head, common):
    monkeypatch.setattr(ngram, "HEAD", head)
    monkeypatch.setattr(ngram, "PAIRS", common)
    monkeypatch.setattr(ngram, "PAIRS_PER_TASK", 900)
    monkeypatch.setattr(ngram, "TEXTS", 7)
    rows = texts(3, 60)
    found = ngram.score_texts(frame(spark, rows), *ngram.by_crc(5, 1, 2)).collect()
    assert sorted((str(r.id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in found) == brute(rows)


def test_probabilities_after_each_word_sum_to_one():
    rng = np.random.RandomState(1)
    kept, held = rng.poisson(0.3, (2, 30, 30))
    kept[3] = held[3] = 0  # a word that was never seen before another
    both = kept + held
    before = both.sum(1)
    word = before.copy()  # a word is counted as often as something comes after it
    n = int(word.sum())
    lam = ngram.mixture(*ngram.cells(kept.ravel(), held.ravel(), np.repeat(kept.sum(1), 30), np.tile(kept.sum(1), 30), n), 30)
    model = ngram.Model(lam, n, 30)
    for i in range(30):
        p = 10 ** model.log10(both[i], np.full(30, before[i]), word)
        unknown = lam[ngram.bucket(before[i : i + 1])[0], 0] / 31
        assert math.isclose(p.sum() + unknown, 1, rel_tol=1e-9)


def test_expectation_maximisation_raises_the_held_out_likelihood():
    rng = np.random.RandomState(2)
    kept, held = rng.poisson(2.0, (2, 20, 20))
    seen, alone = kept.sum(1), kept.sum(0)
    cell, n = ngram.cells(kept.ravel(), held.ravel(), np.repeat(seen, 20), np.tile(alone, 20), kept.sum())

    def likelihood(passes):
        lam = ngram.mixture(cell, n, 20, passes)[ngram.bucket(seen)]
        p = lam[:, 2:] * kept / seen[:, None] + lam[:, 1:2] * alone / kept.sum() + lam[:, :1] / 21
        return (held * np.log(p)).sum()

    assert likelihood(1) < likelihood(4) <= likelihood(30) + 0.5


def test_pairs_tell_held_out_texts_apart(spark):
    """Of texts of the same words, those in the order that training texts have them score higher."""
    rows = [(i, f"red {'green blue' if i % 2 else 'green grey'} end{i % 3}") for i in range(300)]
    asked = [i for i in range(1000, 1100) if crc_mod(i, 5) == 1]
    rows += [(i, ("red green blue end1", "blue red green end1")[i % 2]) for i in asked]
    found = {r.id: r.score for r in ngram.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), *ngram.by_crc(5, 1, 2)).collect()}
    right, wrong = ([found[i] for i in asked if i % 2 == k] for k in (0, 1))
    assert right and wrong and min(right) > max(wrong) + 1


def test_empty_tables(spark):
    assert ngram.score_texts(empty(spark), *ngram.by_crc(5, 1, 2)).collect() == []
