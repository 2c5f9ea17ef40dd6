import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from skeinbase.llm import components, simhash

from .helpers import empty, frame, texts


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(nodes, linked):
    parent = list(range(len(nodes)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(nodes))]


def test_whole_operator_matches_brute_force(spark):
    rows = texts()
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.id is None, r.id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    fps = [fingerprint(t, 3) for _, t in rows]
    roots = least_reachable(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    expected = sorted((fps[k], min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None), default=None)) for k in range(len(rows)))
    assert sorted((r.fp % 2**64, r.component) for r in found) == expected


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.drop_near_copies(empty(spark)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_variants_meet_within_the_radius(radius):
    rng = random.Random(radius)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, radius)):
            b ^= 1 << bit
        x, y = (set(simhash.variants(np.array([v], np.uint64), radius)[0].tolist()) for v in (a, b))
        assert x & y


@pytest.mark.parametrize("limit", [1, 16])
def test_links_of_one_key_join_what_brute_force_joins(limit, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_RUN", limit)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fp = np.unique(np.array([centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)], np.uint64))
    a, b = simhash.verified(np.zeros(len(fp), np.uint64), fp, 3)
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b))
    place = {int(x): i for i, x in enumerate(fp)}
    linked = {(place[int(x)], place[int(y)]) for x, y in zip(a, b)}
    got = least_reachable(list(range(len(fp))), lambda i, j: (i, j) in linked or (j, i) in linked)
    assert got == least_reachable([int(x) for x in fp], lambda x, y: (x ^ y).bit_count() <= 3)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_near_copies_of_few_edits_go_and_others_stay(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(10, " ".join(base))]
    for i in range(8):  # each has three edits of its own: a similarity of about 0.9 to the first
        own = list(base)
        for at in rng.sample(range(300), 3):
            own[at] = f"edit{i}x{at}"
        rows.append((11 + i, " ".join(own)))
    rows += [(30 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(10)]
    rows += [(50, rows[-1][1]), (50, rows[-1][1]), (60, ""), (61, None), (62, "two words")]
    kept = simhash.drop_near_copies(frame(spark, rows), shingle=5, similarity=0.8)
    assert kept.columns[:3] == ["doc_id", "text", "id"]
    assert sorted(r.doc_id for r in kept.collect()) == [10, *range(30, 40), 60, 62]


def star(seed, copies, edits=5, length=300):
    """An original, of the largest id, and copies with edits in their own places."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(length)]
    rows = []
    for i in range(copies):
        own = list(base)
        for j in range(edits):
            own[(i * 37 + j * 59) % length] = f"edit{seed}x{i}x{j}"
        rows.append(" ".join(own))
    return [*rows, " ".join(base)]


def test_copies_that_only_the_original_is_close_to_are_one_group(spark):
    rows = [(100 * s + i, t) for s in range(6) for i, t in enumerate(star(s, 8))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    group = range(9)
    assert all(alike(sets[i], sets[8]) for i in group) and not any(alike(sets[i], sets[j]) for i in range(8) for j in range(i))
    assert sorted(r.doc_id for r in simhash.drop_near_copies(frame(spark, rows), shingle=5, similarity=0.8).collect()) == [100 * s for s in range(6)]


def test_near_copies_match_brute_force_over_all_pairs(spark):
    rng = random.Random(4)
    line = "this one line is in very many of the texts of this table and says nothing new at all"
    rows = []
    for s in range(12):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.randint(6, 120))]
        for i in range(12):
            own = [w if rng.random() > 0.02 else f"e{rng.randrange(9)}" for w in base]
            rows.append((len(rows), " ".join(own) + (" " + line if rng.random() < 0.5 else "")))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    roots = least_reachable(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    found = sorted(r.doc_id for r in simhash.drop_near_copies(frame(spark, rows), shingle=5, similarity=0.8).collect())
    assert found == sorted(set(roots))


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    rows = [(i, f"text number {i} of a few that all share a hash {'x ' * i}") for i in range(30)] + [(40, "text number 3 of a few that all share a hash " + "x " * 3)]
    monkeypatch.setattr(simhash, "text_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(4)))
    found = sorted(r.doc_id for r in simhash.drop_near_copies(frame(spark, rows), shingle=5, similarity=1.0).collect())
    assert set(range(20)) <= set(found) and 40 not in found


def test_columns_of_any_name_stay(spark):
    names = ["k", "i", "key", "__key", "__id", "row", "least", "a.b", "c`d", "at", "text hash"]
    docs = spark.createDataFrame([(1, "one text here", *names), (2, "one text here", *names), (3, None, *names)], ["doc_id", "text", *names])
    found = simhash.drop_near_copies(docs)
    assert found.columns == docs.columns
    assert sorted(found.collect()) == [(1, "one text here", *names), (3, None, *names)]


def test_parity_maps_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        assert simhash.differ(simhash.parity(a), simhash.parity(b)) <= len(np.setxor1d(a, b))
