"""Lexical retrieval: batches of queries against an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .graph import cut, written

TOKEN_CAP = 32


def postings(nodes: DataFrame, id_col: str = "node_id", text_col: str = "body") -> DataFrame:
    """(node_id, term): each node's distinct anchor terms."""
    return nodes.select(F.col(id_col).alias("node_id"), F.explode(text.anchors(F.col(text_col))).alias("term"))


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(id_col).alias("qid"), F.explode(text.query_tokens(F.col(text_col))).alias("term"))


def top_rows(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered; ``order`` should be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_best(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row for each key."""
    return top_rows(df, by, order, 1, "__rank").drop("__rank")


def rarest_terms(terms: DataFrame, index: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """(qid, term, df): each query's rarest terms, known ones first, at most ``cap``."""
    return rarest(terms, index.groupBy("term").agg(F.count("*").alias("df")), cap)


def rarest(terms: DataFrame, df: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """The same with the terms' counts (term, df) at hand."""
    known = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return top_rows(known, ["qid"], [(F.col("df") == 0).cast("int"), "df", "term"], cap).select("qid", "term", "df")


def bm25(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, node_id, hits, relevance) for (qid, term, df) against (node_id, term).

    Lengths and counts are aggregated once; the only rows joined are a query's terms and their
    postings.
    """
    length = index.groupBy("node_id").agg(F.count("*").alias("length"))
    stats = length.agg(F.count("*").alias("documents"), F.avg("length").alias("average"))
    hits = terms.join(index, "term").join(length, "node_id").crossJoin(F.broadcast(stats))  # one row of totals
    part = scores.bm25(F.lit(1), F.col("df"), F.col("length"), F.col("documents"), F.col("average"))
    return hits.groupBy("qid", "node_id").agg(F.count("*").alias("hits"), F.sum(part).alias("relevance"))


def retrieve(queries: DataFrame, nodes: DataFrame, k: int = 3, floor: int = 2) -> DataFrame:
    """(qid, rank, node_id, hits, score): the best nodes of each query.

    Nodes with fewer than ``floor`` hits are silent; relevance is weighted by the node's loudest
    facet. A query without any such node has no rows.
    """
    index = cut(postings(nodes))  # the anchors are found once
    found = bm25(rarest_terms(query_terms(queries), index), index).where(F.col("hits") >= floor)
    weighted = found.join(nodes.select("node_id", "facets"), "node_id").withColumn("score", F.round(F.col("relevance") * scores.facet_weight(F.col("facets")), 4))
    return top_rows(weighted, ["qid"], [F.desc("score"), F.desc("hits"), "node_id"], k).select("qid", "rank", "node_id", "hits", "score")


def phrases(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(qterm, term): the different terms of ``known`` (term) that have a term of ``asked`` (term) as a run of their
    words. They meet by the first word of what is asked; then the whole run is looked for."""
    run = lambda c: F.concat(F.lit("-"), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("-"))
    own = known.select("term").distinct().select("term", run("term").alias("run")).withColumn("word", F.explode(F.array_distinct(F.split(F.expr("substring(run, 2, length(run) - 2)"), "-"))))
    asked = asked.select("term").distinct().select(F.col("term").alias("qterm"), run("term").alias("wanted")).where("wanted <> '--'").withColumn("word", F.split("wanted", "-")[1])
    return asked.join(own, "word").where(F.col("run").contains(F.col("wanted"))).select("qterm", "term")


def phrase_hits(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, qterm, node_id, term): the anchors (node_id, term) that have a query's term (qid, term) as a phrase."""
    met = terms.select("qid", F.col("term").alias("qterm")).join(phrases(terms, index), "qterm")
    return met.join(index.select("node_id", "term"), "term").select("qid", "qterm", "node_id", "term")


def bm25_counted(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, node_id, hits, relevance) with term counts: a term counts once for each anchor of the node that
    has it as a phrase; ``hits`` are the node's anchors that any of the query's terms is in.

    Different terms meet once, not each posting; counts are those of a term, whichever queries ask for it.
    """
    length = index.groupBy("node_id").agg(F.count("*").alias("length"))
    stats = length.agg(F.count("*").alias("documents"), F.avg("length").alias("average"))
    asked = terms.select("qid", F.col("term").alias("qterm")).distinct()
    met = written(phrases(terms, index))  # its size is known, so that it goes to the postings and not they to it
    raw = asked.join(met, "qterm").select("qid", "term").distinct().join(index, "term").groupBy("qid", "node_id").agg(F.countDistinct("term").alias("hits"))
    tf = written(met.join(index, "term").groupBy("qterm", "node_id").agg(F.count("*").alias("tf")))
    df = tf.groupBy("qterm").agg(F.count("*").alias("df"))
    part = scores.bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("documents"), F.col("average"))
    rows = asked.join(tf, "qterm").join(df, "qterm").join(length, "node_id").crossJoin(F.broadcast(stats))  # one row of totals
    return rows.groupBy("qid", "node_id").agg(F.sum(part).alias("relevance")).join(raw, ["qid", "node_id"]).select("qid", "node_id", "hits", "relevance")


def found_sets(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(node_id, found) for the terms (term): for each of a node's anchors that has some of them as phrases, which
    ones, as sorted lists in order. Term counts and hits of any query follow from them: a term counts as often
    as lists have it, and a query hits as many anchors as lists have one of its terms."""
    each = phrase_hits(terms.select(F.lit(0).alias("qid"), "term").distinct(), index).groupBy("node_id", "term").agg(F.array_sort(F.collect_set("qterm")).alias("s"))
    return each.groupBy("node_id").agg(F.array_sort(F.collect_list("s")).alias("found"))


def precedents(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Past decisions and lessons for a situation, with what replaced them: (qid, rank, node_id,
    relevance, superseded_by)."""
    index = postings(nodes.where(F.col("kind").isin("decision", "lesson")))
    found = bm25(rarest_terms(query_terms(queries), index), index).withColumn("relevance", F.round("relevance", 4))
    later = edges.where("kind = 'supersedes'").groupBy(F.col("dst").alias("node_id")).agg(F.max("src").alias("superseded_by"))
    return top_rows(found, ["qid"], [F.desc("relevance"), "node_id"], k).join(later, "node_id", "left").select("qid", "rank", "node_id", "relevance", "superseded_by")


def title_pairs(words: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of (node_id, words) that can overlap by ``least``, and few others.

    Pairs meet under a title's rarest words, as many as are needed so that similar titles share one. Where they
    meet, lengths, what is left behind the word, and parity maps of all words say which pairs can be similar:
    words that only one of two titles has are at least as many as the bits that their maps differ in. Only
    such pairs leave the join.
    """
    parity = F.array(*(F.expr(f"aggregate(words, 0L, (m, w) -> m ^ if(pmod(xxhash64(w), 256) div 64 = {lane}, shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)), 0L))") for lane in range(4)))
    each = words.select("node_id", F.size("words").alias("n"), parity.alias("parity"), F.explode("words").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("df"))
    rare = each.join(rarity, "word").withColumn("at", F.row_number().over(Window.partitionBy("node_id").orderBy("df", "word")))
    keys = rare.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("node_id", "word", "n", "at", "parity")
    both = F.col("x.n") + F.col("y.n")
    alike = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least - 1e-6
    enough = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= both * (least / (1 + least)) - 1e-6
    apart = sum(F.bit_count(F.col("x.parity")[lane].bitwiseXOR(F.col("y.parity")[lane])) for lane in range(4))
    near = alike & enough & (apart <= both * ((1 - least) / (1 + least)) + 1e-6)
    return keys.alias("x").join(keys.alias("y"), (F.col("x.word") == F.col("y.word")) & (F.col("x.node_id") < F.col("y.node_id")) & near).select(F.col("x.node_id").alias("a"), F.col("y.node_id").alias("b")).distinct()


def near_titles(nodes: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs (a, b) of nodes whose titles' words overlap by a Jaccard similarity of ``least``. Nodes of one
    title are one, by the least id."""
    nodes = nodes.groupBy(text.title_key(F.col("title")).alias("title")).agg(F.min("node_id").alias("node_id"))
    words = nodes.select("node_id", F.array_distinct(F.filter(F.split(text.title_key(F.col("title")), " "), lambda w: w != "")).alias("words")).where(F.size("words") > 0)
    met = title_pairs(words, least)
    pairs = met.join(words.select(F.col("node_id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("node_id").alias("b"), F.col("words").alias("wb")), "b")
    return pairs.withColumn("similarity", text.jaccard(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= least).select("a", "b", F.round("similarity", 6).alias("similarity"))
