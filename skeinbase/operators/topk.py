"""The exact first k of a ranking without scoring every posting of every term.

A node's score is its own factor (length and loudest facet) times the sum of the weights of the query's
terms that it has. Postings are packed into blocks of like factors, each with its greatest one. A first
phase scores what the rarest terms find; its k-th score is a threshold. In the second, a block is only
opened where its greatest factor, with all of the query's terms from that one on, can reach the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .graph import written
from .retrieval import top_rows

#: Blocks of one term hold the nodes of one chunk at most; there are as many chunks as the nodes need.
CHUNK = 65_536
#: Factors within one part in so many of a doubling share a block.
LEVELS = 8
#: The first phase reads one part in so many of a query's postings, and two terms at least.
LEAD = 16
#: As many nodes for each one asked for are scored to find the threshold.
SCORED = 8
#: Scores are rounded to four places: what is this close below the threshold may still be as good.
SLACK = 1e-4


@dataclass
class ImpactIndex:
    blocks: DataFrame  # (term, top, held: (node_id, factor)...)
    forward: DataFrame  # (node_id, factor, terms)
    counts: DataFrame  # (term, df)
    nodes: int


def impact_index(nodes: DataFrame, id_col: str = "node_id", text_col: str = "body", asked: DataFrame | None = None) -> ImpactIndex:
    """Blocks of postings and terms by node, written out. Nodes need ``facets``; those without terms are not in it.

    If the terms that will be asked for are known (``asked``: term), blocks and counts have these only; lengths are
    of all terms of all nodes. A node's terms move together, as one row.
    """
    terms = nodes.select(F.col(id_col).alias("node_id"), text.anchors(F.col(text_col)).alias("terms"))
    own = terms.groupBy("node_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)
    listed = written(own.join(nodes.select(F.col(id_col).alias("node_id"), scores.facet_weight(F.col("facets")).alias("weight")), "node_id"))
    stats = listed.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("average")).first()
    factor = F.col("weight") * scores.norm(F.lit(1), F.size("terms"), F.lit(stats["average"] or 1.0))
    forward = listed.select("node_id", factor.alias("factor"), "terms")
    level = F.floor(F.log2("factor") * LEVELS)
    chunk = F.pmod(F.xxhash64("node_id"), F.lit(-(-stats["n"] // CHUNK) or 1))
    each = forward.select("node_id", "factor", level.alias("level"), chunk.alias("chunk"), F.explode("terms").alias("term"))
    if asked is not None:
        each = each.join(written(asked.select("term").distinct()), "term", "left_semi")  # its size is known, so that it goes to the postings
    blocks = written(each.groupBy("term", "level", "chunk").agg(F.max("factor").alias("top"), F.collect_list(F.struct("node_id", "factor")).alias("held")).select("term", "top", "held"))
    counts = blocks.groupBy("term").agg(F.sum(F.size("held")).alias("df"))
    return ImpactIndex(blocks, forward, counts, stats["n"])


def weighed_terms(terms: DataFrame, index: ImpactIndex) -> DataFrame:
    """(qid, term, df, idf, at, rest, read, whole) of a query's known terms (qid, term, df), the rarest first: ``rest``
    is the weight of it and all later ones, ``read`` the postings up to it, ``whole`` those of all."""
    order = Window.partitionBy("qid").orderBy("df", "term")
    known = terms.where("df > 0").withColumn("idf", scores.idf(F.col("df"), F.lit(index.nodes)))
    later, earlier = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    return known.select("qid", "term", "df", "idf", F.row_number().over(order).alias("at"), F.sum("idf").over(later).alias("rest"), F.sum("df").over(earlier).alias("read"), F.sum("df").over(Window.partitionBy("qid")).alias("whole"))


def opened(wanted: DataFrame, index: ImpactIndex) -> DataFrame:
    """(qid, node_id, factor, sum): what the postings of (qid, term, idf, need) whose factor is at least ``need`` add
    up to, the blocks that have none being left closed."""
    held = wanted.join(index.blocks, "term").where("top >= need").select("qid", "idf", "need", F.explode("held").alias("p")).where("p.factor >= need")
    return held.groupBy("qid", F.col("p.node_id").alias("node_id")).agg(F.first("p.factor").alias("factor"), F.sum("idf").alias("sum"), F.count("*").alias("rows"))


def completed(found: DataFrame, terms: DataFrame, index: ImpactIndex, floor: int) -> DataFrame:
    """(qid, node_id, hits, score) of each (qid, node_id) by all terms of both; those of fewer than ``floor`` hits go."""
    asked = terms.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("asked"))
    both = found.select("qid", "node_id").join(index.forward, "node_id").join(asked, "qid")
    met = both.select("qid", "node_id", "factor", "asked", F.array_intersect("terms", F.col("asked.term")).alias("met")).where(F.size("met") >= floor)
    total = F.aggregate(F.filter("asked", lambda t: F.array_contains(F.col("met"), t["term"])), F.lit(0.0), lambda s, t: s + t["idf"])
    return met.select("qid", "node_id", F.size("met").cast("long").alias("hits"), F.round(F.col("factor") * total, 4).alias("score"))


def threshold(terms: DataFrame, index: ImpactIndex, k: int, floor: int) -> DataFrame:
    """(qid, least): the k-th score among the best of what a query's rarest terms find; no row where there are fewer."""
    first = terms.where((F.col("at") <= 2) | (F.col("read") * LEAD <= F.col("whole"))).withColumn("need", F.lit(0.0))
    best = top_rows(opened(first, index).withColumn("part", F.col("factor") * F.col("sum")), ["qid"], [F.desc("part"), "node_id"], SCORED * k)
    return top_rows(completed(best, terms, index, floor), ["qid"], [F.desc("score"), "node_id"], k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))


def candidates(terms: DataFrame, least: DataFrame, index: ImpactIndex) -> DataFrame:
    """(qid, node_id, rows): all that can be as good as a query's threshold; ``rows`` are the postings it was found by.

    A node whose rarest term is the i-th scores its factor times ``rest`` of that term at most, so it is found
    under it if it counts; terms that it was not found by add to what it has, at most.
    """
    bound = terms.join(least, "qid", "left").withColumn("least", F.coalesce(F.col("least") - SLACK, F.lit(0.0)))
    need = bound.withColumn("need", F.greatest(F.col("least"), F.lit(0.0)) / F.col("rest"))
    closed = need.groupBy("qid").agg(F.first("least").alias("least"), F.collect_list(F.struct("need", "idf")).alias("all"))
    found = opened(need, index).join(closed, "qid")
    unread = F.aggregate(F.filter("all", lambda t: t["need"] > F.col("factor")), F.lit(0.0), lambda s, t: s + t["idf"])
    return found.where(F.col("factor") * (F.col("sum") + unread) >= F.col("least")).select("qid", "node_id", "rows")


def top_nodes(terms: DataFrame, index: ImpactIndex, k: int = 3, floor: int = 2) -> DataFrame:
    """(qid, rank, node_id, hits, score): the same as scoring everything: the k best of the nodes that have at least
    ``floor`` of a query's (qid, term, df), by score, then hits, then id. Queries without any have no rows."""
    weighed = written(weighed_terms(terms, index))
    found = candidates(weighed, written(threshold(weighed, index, k, floor)), index)
    return top_rows(completed(found, weighed, index, floor), ["qid"], [F.desc("score"), F.desc("hits"), "node_id"], k).select("qid", "rank", "node_id", "hits", "score")
