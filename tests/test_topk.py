"""The bounded search against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from skeinbase.operators import retrieval, topk
from skeinbase.plans import bindings as B

WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]


def corpus(spark, seed, n=300):
    rng = random.Random(seed)
    common = lambda: WORDS[min(int(rng.expovariate(0.06)), len(WORDS) - 1)]
    facets = [[], ["security"], ["docs", "plan"], ["chore"], ["nothing"], None]
    rows = [(i, " ".join(common() for _ in range(rng.randint(1, 90))), rng.choice(facets)) for i in range(n)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)] + [(2000, "", []), (2001, None, None), (2002, "a b c", ["plan"])]
    asked = [(q, " ".join(common() for _ in range(rng.randint(1, 40)))) for q in range(25)] + [(100, rows[5][1]), (101, "nothing that stands anywhere"), (102, None), (103, WORDS[-1])]
    return spark.createDataFrame(rows, "node_id long, body string, facets array<string>"), spark.createDataFrame(asked, "qid long, text string")


@pytest.mark.parametrize(("seed", "k", "floor"), [(0, 3, 2), (1, 1, 1), (2, 10, 3), (3, 400, 2)])
def test_same_rows_as_scoring_everything(spark, seed, k, floor):
    nodes, asked = corpus(spark, seed)
    index = topk.impact_index(nodes)
    terms = retrieval.rarest(retrieval.query_terms(asked), index.counts)
    want = sorted(map(tuple, retrieval.retrieve(asked, nodes, k, floor).collect()))
    assert sorted(map(tuple, topk.top_nodes(terms, index, k, floor).collect())) == want and want


def test_small_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 7)
    nodes, asked = corpus(spark, 4)
    index = topk.impact_index(nodes)
    assert index.blocks.agg(F.max(F.size("held"))).first()[0] < 60
    terms = retrieval.rarest(retrieval.query_terms(asked), index.counts)
    assert sorted(map(tuple, topk.top_nodes(terms, index).collect())) == sorted(map(tuple, retrieval.retrieve(asked, nodes).collect()))


def test_blocks_have_their_greatest_factor_and_all_postings(spark):
    nodes, _ = corpus(spark, 5)
    index = topk.impact_index(nodes)
    assert index.blocks.where(F.array_max(F.transform("held", lambda p: p["factor"])) != F.col("top")).count() == 0
    assert index.blocks.select("term", F.explode("held.node_id")).exceptAll(retrieval.postings(nodes).select("term", "node_id")).count() == 0
    assert index.counts.agg(F.sum("df")).first()[0] == retrieval.postings(nodes).count()


def test_nothing_to_find(spark):
    nodes, asked = corpus(spark, 6)
    for n, q in ((nodes.limit(0), asked), (nodes, asked.limit(0))):
        index = topk.impact_index(n)
        assert topk.top_nodes(retrieval.rarest(retrieval.query_terms(q), index.counts), index).count() == 0


def test_under_a_third_of_the_rows(spark):
    folder = "/root/testdata/sf0.01"
    index = topk.impact_index(B.nodes(spark, folder))
    terms = topk.weighed_terms(retrieval.rarest(retrieval.query_terms(B.queries(spark, folder)), index.counts), index).cache()
    first = terms.where((F.col("at") <= 2) | (F.col("read") * topk.LEAD <= F.col("whole"))).agg(F.sum("df")).first()[0]
    second, scored = topk.candidates(terms, topk.threshold(terms, index, 3, 2), index).agg(F.sum("rows"), F.count("*")).first()
    assert 3 * (first + second + scored) < terms.agg(F.sum("df")).first()[0]


def test_only_terms_asked_for_are_in_blocks(spark):
    nodes, asked = corpus(spark, 7)
    terms = retrieval.query_terms(asked.where("qid < 3"))
    whole, index = topk.impact_index(nodes), topk.impact_index(nodes, asked=terms)
    assert sorted(index.counts.collect()) == sorted(whole.counts.join(terms.select("term").distinct(), "term", "left_semi").collect()) != sorted(whole.counts.collect())
    assert sorted(index.forward.select("node_id", "factor", F.size("terms")).collect()) == sorted(whole.forward.select("node_id", "factor", F.size("terms")).collect())
    want = sorted(map(tuple, retrieval.retrieve(asked.where("qid < 3"), nodes).collect()))
    assert sorted(map(tuple, topk.top_nodes(retrieval.rarest(terms, index.counts), index).collect())) == want and want
