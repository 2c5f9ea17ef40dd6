"""Components and cycles against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skeinbase.operators import circles


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def closure(rows):
    reach = {(a, b) for a, b in rows if a is not None and b is not None and a != b}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            return reach
        reach = more


def brute_components(rows):
    reach = closure(rows)
    both = {(a, b) for a, b in reach if (b, a) in reach}
    return {(a, min(y for x, y in both if x == a)) for a, b in both if a != b}


def brute_cycles(rows):
    own = {(a, b) for a, b in rows if a != b}
    nodes = sorted({x for r in own for x in r})
    out = set()
    for n in range(2, len(nodes) + 1):
        for group in itertools.combinations(nodes, n):
            for rest in itertools.permutations(group[1:]):
                c = (group[0], *rest)
                if all((c[i], c[(i + 1) % n]) in own for i in range(n)):
                    out.add(c)
    return out


def shifted(graphs):
    """Many graphs as one, each in its own numbers."""
    return [(a + 100 * i, b + 100 * i) for i, g in enumerate(graphs) for a, b in g]


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(7)
    return [[(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 3 * n))] for n in [2, 3, 4, 5, 6, 7, 7, 7, 7, 7] * 4]


def test_components_of_random_graphs(spark, graphs):
    rows = shifted(graphs) + [(None, 1), (1, None), (None, None)]
    assert set(map(tuple, circles.strong_components(pairs(spark, rows)).collect())) == set().union(*(brute_components([(a + 100 * i, b + 100 * i) for a, b in g]) for i, g in enumerate(graphs)))


def test_a_ring_of_ten_thousand_in_few_rounds(spark):
    n = 10_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    ways, rounds = circles.spread_labels(ring)
    assert rounds < 30
    assert ways.select("above.node", "below.node").distinct().count() == 1
    assert circles.strong_components(ring).groupBy("component").count().collect() == [(0, n)]


def test_a_long_path_has_none(spark):
    path = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert circles.strong_components(path).count() == 0
    assert circles.strong_components(pairs(spark, [])).count() == 0


def test_rings_joined_one_way(spark):
    rows = [(i, (i + 1) % 12) for i in range(12)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(7, 103), (106, 900), (900, 901)]
    found = circles.strong_components(pairs(spark, rows)).groupBy("component").count().collect()
    assert sorted(map(tuple, found)) == [(0, 12), (100, 7)]


def test_cycles_of_random_graphs(spark, graphs):
    found, told = circles.elementary_cycles(pairs(spark, shifted(graphs)), budget=None)
    want = set().union(*(brute_cycles([(a + 100 * i, b + 100 * i) for a, b in g]) for i, g in enumerate(graphs)))
    got = [tuple(r["files"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(r["length"] == len(r["files"]) for r in found.collect())
    rows = told.collect()
    assert sum(r["n_cycles"] for r in rows) == len(want) and not any(r["truncated"] for r in rows)
    assert all(r["complete_to"] == r["n_files"] for r in rows)


def test_a_ring_of_twelve_beside_a_clique_that_ends_with_its_budget(spark):
    ring = [(100 + i, 100 + (i + 1) % 12) for i in range(12)]
    clique = [(a, b) for a in range(15) for b in range(15) if a != b]
    found, told = circles.elementary_cycles(pairs(spark, ring + clique))
    of = {r["component"]: r for r in told.collect()}
    assert [tuple(r["files"]) for r in found.where("component = 100").collect()] == [tuple(range(100, 112))]
    assert not of[100]["truncated"] and of[100]["complete_to"] == 12
    assert of[0]["truncated"] and 3 <= of[0]["complete_to"] < 15
    lengths = dict(found.where("component = 0").groupBy("length").count().collect())
    assert lengths[2] == 105 and lengths[3] == 15 * 14 * 13 // 3 and max(lengths) == of[0]["complete_to"]


def test_a_longest_length(spark):
    ring = [(i, (i + 1) % 4) for i in range(4)] + [(1, 0)]
    found, told = circles.elementary_cycles(pairs(spark, ring), longest=3)
    assert [r["files"] for r in found.collect()] == [[0, 1]]
    assert told.first()["truncated"] and told.first()["complete_to"] == 3
    found, told = circles.elementary_cycles(pairs(spark, ring), longest=4)
    assert sorted(r["length"] for r in found.collect()) == [2, 4] and not told.first()["truncated"]


def test_no_cycles(spark):
    found, told = circles.elementary_cycles(pairs(spark, [(1, 2), (2, 3), (4, 4)]))
    assert found.count() == 0 and told.count() == 0


def test_order_by_importance(spark):
    found, _ = circles.elementary_cycles(pairs(spark, [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (6, 7), (7, 6)]))
    weight = spark.createDataFrame([(1, 5.0), (4, 9.04), (6, 5.0)], "file long, importance double")
    rows = circles.by_importance(found, weight).collect()
    assert [(r["files"], r["importance"]) for r in rows] == [([3, 4, 5], 9.0), ([1, 2], 5.0), ([6, 7], 5.0)]
